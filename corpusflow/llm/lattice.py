"""Sums over all segmentations of words into pieces of a fixed vocabulary.

Words are processed in NumPy batches of similar length.  The piece trie is
walked from all starts of all words of a batch at once; the forward recursion
adds, in log space, the weight of each piece found to the score of the prefix
before it.  Several weightings of the same vocabulary (one per language) are
columns of one matrix.  Work per word is its length times the longest piece;
memory is a batch, whatever the number of words.
"""

from __future__ import annotations

import numpy as np
import sentencepiece

MARK = "▁"                   # stands before each word
_BATCH_CHARS = 50_000
_SCALE = 2.5                 # log of what a character is scaled by in plain numbers
_EMPTY = -1


def normal_pieces(model: bytes) -> tuple[list[str], np.ndarray]:
    """The ordinary pieces of a sentencepiece model and their scores (control,
    unknown and byte pieces left out)."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size())
           if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in ids], np.array([sp.get_score(i) for i in ids])


class PieceTrie:
    """The vocabulary as a trie in one open-addressed hash table, so that a
    step for a whole batch is a few array operations."""

    def __init__(self, pieces: list[str]):
        edges: dict[int, int] = {}
        ends = [_EMPTY]
        self.max_len = max(map(len, pieces), default=1)
        for p, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(ends)
                    ends.append(_EMPTY)
                node = nxt
            ends[node] = p
        self.ends = np.array(ends, np.int64)
        self.n_pieces = len(pieces)
        bits = max(4, int(np.ceil(np.log2(8 * max(1, len(edges))))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.int64)
        self.next = np.zeros(1 << bits, np.int64)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        values = np.fromiter(edges.values(), np.int64, len(edges))
        at = self._slot(keys)
        while len(keys):                       # linear probing, all keys at once
            free = self.keys[at] == _EMPTY
            slot, first = np.unique(at[free], return_index=True)
            pick = np.flatnonzero(free)[first]
            self.keys[slot], self.next[slot] = keys[pick], values[pick]
            rest = np.ones(len(keys), bool)
            rest[pick] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node along each character, or -1."""
        keys = nodes << 21 | chars
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.next[at], _EMPTY)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


def _batches(words: list[str]):
    """Index batches of words of similar length, with a bounded sum of lengths."""
    lens = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lens, kind="stable")
    cut = (np.cumsum(lens[order] + 1) - 1) // _BATCH_CHARS
    for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
        if len(part):
            yield part


class _Lattice:
    """All pieces found in a batch of words, as arcs between cells: a word of n
    characters has the n + 1 cells ``first[w] .. last[w]``."""

    def __init__(self, trie: PieceTrie, words: list[str]):
        lens = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(lens) - lens
        self.first = begin + np.arange(len(lens))
        self.last = self.first + lens
        self.cells = int(lens.sum()) + len(lens)
        word = np.repeat(np.arange(len(lens)), lens)
        offset = np.arange(len(chars)) - begin[word]
        left = lens[word] - offset
        at, nodes = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, sizes, pieces = [], [], []
        for k in range(trie.max_len):                     # the k-th character after every start, at once
            nodes = trie.step(nodes, chars[at + k])
            alive = nodes >= 0
            if k == 0:
                single = alive & (trie.ends[nodes] >= 0)
                lost = at[~single]                        # characters that are no piece: arcs of weight `floor`
                starts.append(lost)
                sizes.append(np.ones(len(lost), np.int64))
                pieces.append(np.full(len(lost), trie.n_pieces))
            at, nodes = at[alive], nodes[alive]
            ends = trie.ends[nodes]
            done = ends >= 0
            starts.append(at[done])
            sizes.append(np.full(int(done.sum()), k + 1))
            pieces.append(ends[done])
            more = left[at] > k + 1
            at, nodes = at[more], nodes[more]
            if not len(at):
                break
        starts, sizes, pieces = (np.concatenate(x) for x in (starts, sizes, pieces))
        by_start = offset[starts]
        order = np.argsort(by_start.astype(np.int32), kind="stable")
        starts, self.size, self.piece, by_start = starts[order], sizes[order], pieces[order], by_start[order]
        self.word = word[starts]
        self.src = starts + self.word                     # one cell more per word before it
        self.dst = self.src + self.size
        self.end = by_start + self.size
        edges = np.r_[0, np.flatnonzero(np.diff(by_start)) + 1, len(by_start)]
        self.steps = [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]

    def forward(self, arc_weights: np.ndarray) -> np.ndarray:
        """Per cell the log of the summed weights of all ways to it.  Arcs from
        one offset lead to distinct cells, so an offset is one array step."""
        alpha = np.full((self.cells, arc_weights.shape[1]), -np.inf)
        alpha[self.first] = 0.0
        for g in self.steps:
            dst = self.dst[g]
            alpha[dst] = np.logaddexp(alpha[dst], alpha[self.src[g]] + arc_weights[g])
        return alpha

    def forward_scaled(self, weights: np.ndarray) -> np.ndarray:
        """The words' log sums as ``forward`` gives them, from plain piece
        weights (not logs): each character is scaled up by a constant against
        underflow.  Words out of range come back as -inf or inf; the caller
        takes them through ``forward``."""
        w = weights[self.piece] * np.exp(np.arange(self.size.max(initial=0) + 1) * _SCALE)[self.size][:, None]
        alpha = np.zeros((self.cells, weights.shape[1]))
        alpha[self.first] = 1.0
        for g in self.steps:
            alpha[self.dst[g]] += alpha[self.src[g]] * w[g]
        last = alpha[self.last]
        with np.errstate(divide="ignore"):
            return np.where(last < 1e-280, -np.inf, np.log(last)) - (self.last - self.first)[:, None] * _SCALE

    def backward(self, arc_weights: np.ndarray) -> np.ndarray:
        """Per cell the log of the summed weights of all ways from it."""
        beta = np.full((self.cells, arc_weights.shape[1]), -np.inf)
        beta[self.last] = 0.0
        order = np.argsort(self.end.astype(np.int32), kind="stable")
        for g in reversed(np.split(order, np.flatnonzero(np.diff(self.end[order])) + 1) if len(order) else []):
            src = self.src[g]
            beta[src] = np.logaddexp(beta[src], beta[self.dst[g]] + arc_weights[g])
        return beta


def _with_floor(weights: np.ndarray, floor: float) -> np.ndarray:
    return np.vstack([weights, np.full((1, weights.shape[1]), floor)])


def log_marginals(trie: PieceTrie, weights: np.ndarray, words: list[str], floor: float,
                  scaled: bool = False) -> np.ndarray:
    """``(len(words), models)``: the natural log of each marked word's summed
    weight over all its segmentations.  ``weights`` is (pieces, models);
    ``floor`` is the log weight of a character outside the vocabulary.
    ``scaled`` sums in scaled plain numbers, faster for several models, and
    takes only the words that leave their range through log space."""
    out = np.zeros((len(words), weights.shape[1]))
    table = _with_floor(weights, floor)
    if scaled:
        table = np.exp(table)
    for index in _batches(words):
        lat = _Lattice(trie, [words[i] for i in index])
        if not scaled:
            out[index] = lat.forward(table[lat.piece])[lat.last]
            continue
        out[index] = lat.forward_scaled(table)
        bad = index[~np.isfinite(out[index]).all(axis=1)]
        if len(bad):
            out[bad] = log_marginals(trie, weights, [words[i] for i in bad], floor)
    return out


def expected_counts(trie: PieceTrie, weights: np.ndarray, words: list[str], counts: np.ndarray,
                    floor: float) -> np.ndarray:
    """Forward-backward under one weighting: how often each piece is expected
    over all segmentations of ``words``, each taken ``counts`` times.  The last
    element counts characters outside the vocabulary."""
    total = np.zeros(trie.n_pieces + 1)
    table = _with_floor(weights.reshape(-1, 1), floor)
    for index in _batches(words):
        lat = _Lattice(trie, [words[i] for i in index])
        w = table[lat.piece]
        alpha, beta = lat.forward(w), lat.backward(w)
        z = alpha[lat.last][lat.word]
        share = np.exp(alpha[lat.src] + w + beta[lat.dst] - z)[:, 0] * counts[index][lat.word]
        total += np.bincount(lat.piece, share, trie.n_pieces + 1)
    return total


def rank_weights(scores: np.ndarray) -> np.ndarray:
    """Log weights of the vocabulary before anything is learnt: its scores fall
    by one per rank, and weight falls with rank as 1 / (rank + 10)."""
    w = 1.0 / (np.maximum(0.0, -scores) + 10.0)
    return np.log(w / w.sum())


def smoothed_weights(counts: np.ndarray, prior: np.ndarray, strength: float = 1000.0) -> np.ndarray:
    """Log weights from expected counts (without the last, unknown, element),
    with ``strength`` pseudo-counts spread as ``exp(prior)``."""
    c = counts[:len(prior)] + strength * np.exp(prior)
    return np.log(c / c.sum())
