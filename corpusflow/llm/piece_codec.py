"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a space before it; spaces belong to the word behind them) and
cut to marked words where no piece of the vocabulary can cross.  The distinct
words that a task has not met yet are sorted, which lays out their trie in
depth-first order: from one word to the next only the characters behind the
common prefix are new, and the forward scores of that prefix are reused.
A character that is no piece is written as its UTF-8 byte pieces, so that
decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import crc32_of, give_back, read_bytes, table, text_slices, tokenizer_path
from corpusflow.llm.lattice import MARK

_UNKNOWN_PENALTY = 10.0           # fixed value of the format: below the lowest score
_CACHE_WORDS = 200_000            # words whose ids a Python worker keeps
_KEPT_WAYS = 100_000              # ways of the automaton kept beside its own
_SLICE_BYTES = 2 << 20            # text in work at a time


def word_pattern(pieces: list[str]) -> re.Pattern:
    """Cuts a marked text to words that no piece crosses: before spaces, around
    line ends, and between an ASCII letter or digit and those ASCII signs that
    no piece holds behind one."""
    signs = set(string.punctuation)
    behind = {c for p in pieces for a, c in zip(p, p[1:]) if a in string.ascii_letters + string.digits}
    every, cut = (re.escape("".join(sorted(x))) for x in (signs, signs - behind))
    return re.compile(f" *[^ \n{every}]++(?<=[A-Za-z0-9])(?=[ \n{cut}])| *[^ \n]+|\n| +".encode())


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a sentencepiece model.

    The pieces form an automaton: its state after a prefix is the longest end of
    the prefix that begins a piece, and knows all pieces that end there.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces: list[tuple[str, float, int]] = []
        self.bytes_of = [b""] * sp.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:-1], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace(MARK, " ")
                pieces.append((piece, sp.get_score(i), i))
                self.bytes_of[i] = piece.encode()
        self.unknown = min(s for _, s, _ in pieces) - _UNKNOWN_PENALTY
        self.words = word_pattern([p for p, _, _ in pieces])
        self._build(pieces)
        self.cache: dict[bytes, bytes] = {}

    def _build(self, pieces: list[tuple[str, float, int]]) -> None:
        children: list[dict[str, int]] = [{}]
        own: list[tuple | None] = [None]
        for piece, score, i in pieces:
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    own.append(None)
                node = children[node][c]
            own[node] = (len(piece), score, i)
        fall, self.ends = [0] * len(children), [()] * len(children)
        level = [0]
        while level:                            # by depth: a shorter end is known before a longer one
            below = []
            for node in level:
                self.ends[node] = ((own[node],) if own[node] else ()) + (self.ends[fall[node]] if node else ())
                for c, child in children[node].items():
                    at = fall[node]
                    while at and c not in children[at]:
                        at = fall[at]
                    fall[child] = children[at][c] if node and c in children[at] else 0
                    below.append(child)
            level = below
        self.children, self.fall = children, fall
        self.kept: list[tuple[int, str]] = []

    def _next(self, state: int, c: str) -> int:
        """The state after one more character; up to ``_KEPT_WAYS`` ways found by
        falling back are kept, then all of them are dropped."""
        at = state
        while at and c not in self.children[at]:
            at = self.fall[at]
        at = self.children[at].get(c, 0)
        if at:
            if len(self.kept) >= _KEPT_WAYS:
                for known, char in self.kept:
                    del self.children[known][char]
                self.kept.clear()
            self.children[state][c] = at
            self.kept.append((state, c))
        return at

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the sorted ``words``: the way of the highest sum
        of scores; of equal ways the one whose last piece is longest."""
        children, ends, step, unknown = self.children, self.ends, self._next, self.unknown
        best, back, states, before = [0.0], [(0, 0)], [0], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:], states[shared + 1:]
            state, end = states[shared], shared
            for c in word[shared:]:
                state = children[state].get(c) or step(state, c)
                end += 1
                top, way, size = -1e300, None, 0
                for size, score, i in ends[state]:
                    if best[end - size] + score > top:
                        top, way = best[end - size] + score, (size, i)
                if size != 1 and best[end - 1] + unknown > top:      # the character alone is no piece
                    top, way = best[end - 1] + unknown, (1, -1)
                best.append(top)
                back.append(way)
                states.append(state)
            before = word
            out, end = [], len(word)
            while end:
                size, i = back[end]
                if i >= 0:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode()))
                end -= size
            out.reverse()
            yield out

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers (none for a
        null or empty text)."""
        cut = [self.words.findall(b" " + t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = wanted.difference(self.cache)
        if len(self.cache) + len(new) > _CACHE_WORDS:
            self.cache, new = {}, wanted
        order = sorted(w.decode() for w in new)
        for word, ids in zip(order, self.encode_sorted(order)):
            self.cache[word.encode()] = array("i", ids).tobytes()
        got = [b"".join(map(self.cache.__getitem__, words)) for words in cut]
        for w in [w for w in new if len(w) > 64]:
            del self.cache[w]
        return got

    def decode(self, ids) -> bytes:
        """The text of ids (control pieces have none)."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


_codecs: dict[int, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    """The codec of a model, kept (with its words) from task to task."""
    key = xxhash.xxh3_64_intdigest(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


_CODED = pa.struct([("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def _coded(codec: PieceCodec, texts: list) -> pa.Array:
    rows = codec.encode(texts)
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    flat = np.frombuffer(b"".join(rows), "<i4")
    same = [codec.decode(np.frombuffer(r, "<i4").tolist()) == (t or b"") for r, t in zip(rows, texts)]
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
         pa.array(map(crc32_of, rows), pa.int64()), pa.array(same, pa.bool_())], fields=list(_CODED))


def coder(spark, model_path: str | None = None):
    """A column function text -> ``(ids, ids_crc32, round_trip)``: the ids of the
    whole text (none for null), their crc32 as little-endian 32-bit integers, and
    whether decoding the ids gives the text back (null: the empty text).  One
    worker does all three, so that one automaton is held."""
    model = spark.sparkContext.broadcast(read_bytes(model_path or tokenizer_path("piece_bpe_32k.model")))

    def code(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model.value)
        for column in texts:
            yield pa.concat_arrays([pa.array([], _CODED), *(_coded(codec, part) for _, part in text_slices(column, _SLICE_BYTES))])
        give_back()

    return F.arrow_udf(code, "struct<ids: array<int>, ids_crc32: long, round_trip: boolean>")


def decoder(spark, model_path: str | None = None):
    """A column function ids -> text."""
    model = spark.sparkContext.broadcast(read_bytes(model_path or tokenizer_path("piece_bpe_32k.model")))

    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model.value)
        for column in ids:
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [codec.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.array(texts, pa.binary()).cast(pa.string())

    return F.arrow_udf(decode, T.StringType())


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text, ids, n_tokens, ids_crc32, round_trip`` of every row: the ids
    of the whole text and whether decoding them gives it back.  A null text has no
    ids and decodes to an empty one.  Other columns are not carried on."""
    coded = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
                .withColumn("coded", coder(docs.sparkSession, model_path)("text"))
    return coded.select("doc_id", "text", "coded.ids", F.size("coded.ids").cast("long").alias("n_tokens"),
                        "coded.ids_crc32", "coded.round_trip")


def op2_piece_codec(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "ids_crc32", "round_trip")
