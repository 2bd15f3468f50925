"""Byte-level BPE: normalisation and pre-tokenisation (B23), the pre-token
histogram (E16) and merge learning on it (E17).

The heavy half — splitting the whole corpus into pre-tokens and counting them
— is one ``groupBy(pretoken).count()`` with partial aggregation.  Merge learning
(:func:`bpe_train`) then works on the *distinct* histogram, many merges a round;
words are arrays of symbol ids, and those that hold a tried pair are cut together.
Every round's tables are written to the shared checkpoint folder, so a lost
executor costs one round at most."""

from __future__ import annotations

import bisect
import heapq
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import materialize

# Special tokens placed before the byte alphabet.
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>"]
# GPT-2 style byte-level pre-tokenisation pattern (Unicode classes).
PRETOKEN_RE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BITS = 21                        # of a symbol's id and of a place among merges: a pair and a place are one long
_MASK = (1 << _BITS) - 1
_FLUSH = 1_000_000                # delta rows that a task holds before it sums them and passes them on


def byte_alphabet() -> list[str]:
    """The 256-symbol byte alphabet: printable Latin-1 bytes stand for
    themselves, every other byte b is shifted to chr(256 + n) in byte order."""
    keep = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) | set(range(ord("®"), 256))
    out, n = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def pretokens(docs: DataFrame, text: str = "text", lowercase: bool = False,
              add_prefix_space: bool = True) -> DataFrame:
    """NFKC (Arrow UDF), optional lowercase, prefix space, byte-level
    pre-tokenisation (JVM regex) -> one row per pre-token."""
    t = nfkc(F.col(text))
    if lowercase:
        t = F.lower(t)
    if add_prefix_space:
        t = F.when(t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))
    return docs.select(F.explode(F.regexp_extract_all(t, F.lit(PRETOKEN_RE), 0)).alias("pretoken"))


def to_byte_symbols(col) -> F.Column:
    """A string -> its UTF-8 bytes as byte-alphabet symbols (ARRAY<STRING>)."""
    table = F.array(*[F.lit(ch) for ch in byte_alphabet()])
    hx = F.hex(F.encode(col, "UTF-8"))
    n = F.length(hx) / 2
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")),
                       lambda i: F.element_at(table, F.conv(F.substring(hx, i * 2 + 1, 2), 16, 10).cast("int") + 1))


def pretoken_counts(docs: DataFrame, text: str = "text", min_frequency: int = 1, lowercase: bool = False) -> DataFrame:
    """``(pretoken, freq)`` with ``freq >= min_frequency``."""
    h = pretokens(docs, text, lowercase).groupBy("pretoken").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))
    return h.where(F.col("freq") >= min_frequency)


def _table(merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The merges ``(left, right, merged)``, ranks from 1, for :func:`_segmented`: sorted
    longs of pair and rank, and the merged symbol by rank."""
    m = np.array([(0, 0, 0), *merges], np.int64)
    keys = (m[:, 0] << 2 * _BITS) | (m[:, 1] << _BITS) | np.arange(len(m))
    return np.sort(keys[1:]), m[:, 2]


def _segmented(symbols: np.ndarray, sizes: np.ndarray, freq: np.ndarray, table, seen=None):
    """Words (their symbols one after the other) after the merges of ``table``, taken
    in rank order in each word; at each rank all places of its pair are merged from
    the left.  Every pass takes the next merge of every word that still has one; words
    that have none left are given back as ``(symbols, sizes, freq)``.

    ``seen(rank, pair, change)`` is told of the pairs that each merge takes or makes."""
    keys, merged = table
    s, n, f, now = symbols, sizes, freq, np.zeros(len(sizes), np.int64)
    none = len(merged)
    left, right = (np.zeros(_MASK + 1, bool) for _ in range(2))
    left[keys >> 2 * _BITS] = right[keys >> _BITS & _MASK] = True
    while len(n):
        word = np.repeat(np.arange(len(n)), n)
        inner = word[:-1] == word[1:]
        rank = np.full(len(s), none, np.int64)
        at = np.flatnonzero(inner & left[s[:-1]] & right[s[1:]])
        pair = (s[at] << 2 * _BITS) | (s[at + 1] << _BITS)
        i = np.searchsorted(keys, pair | (now[word[at]] + 1))
        found = np.append(keys, -1)[i]
        ok = found >> _BITS == pair >> _BITS
        rank[at[ok]] = found[ok] & _MASK
        now = np.minimum.reduceat(rank, np.cumsum(n) - n)
        going = now < none
        if not going.all():
            stay = going[word]
            yield s[~stay], n[~going], f[~going]
            s, rank, n, f, now = s[stay], rank[stay], n[going], f[going], now[going]
            if not len(n):
                return
            word = np.repeat(np.arange(len(n)), n)
            inner = word[:-1] == word[1:]
        hit = np.flatnonzero(rank == now[word])
        k = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, k, 0))
        hit = hit[(k - run) % 2 == 0]                       # of places that overlap every other one, from the left
        def tell(s, word, inner, at, sign):
            touched = np.zeros(len(s), bool)
            for a in at:
                touched[a[a >= 0]] = True
            at = np.flatnonzero(touched[:-1] & inner)
            seen(now[word[at]], (s[at] << _BITS) | s[at + 1], sign * f[word[at]])

        if seen is not None:
            tell(s, word, inner, (hit - 1, hit, hit + 1), -1)
        s = s.copy()
        s[hit] = merged[now[word[hit]]]
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        s, word = s[keep], word[keep]
        n = np.bincount(word, minlength=len(n))
        if seen is not None:
            hit = hit - np.arange(len(hit))
            tell(s, word, word[:-1] == word[1:], (hit - 1, hit), 1)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch ``(w, freq)``: symbols of all words, their numbers, frequencies."""
    w = batch.column(0)
    ends = np.frombuffer(w.buffers()[1], np.int32)[w.offset:w.offset + len(w) + 1] // 4
    symbols = np.frombuffer(w.buffers()[2], "<i4", count=ends[-1]) if len(w) and ends[-1] else np.empty(0, "<i4")
    return symbols[ends[0]:].astype(np.int64), np.diff(ends).astype(np.int64), batch.column(1).to_numpy()


def _word_batch(symbols: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    """The same back; words of one symbol have no pairs and go."""
    symbols, more = symbols[np.repeat(sizes > 1, sizes)], sizes > 1
    ends = np.r_[0, np.cumsum(sizes[more])].astype(np.int32) * 4
    w = pa.Array.from_buffers(pa.binary(), int(more.sum()), [None, pa.py_buffer(ends), pa.py_buffer(symbols.astype("<i4"))])
    return pa.record_batch([w, pa.array(freq[more])], names=["w", "freq"])


def _from_bytes(kept: np.ndarray):
    """Words ``(pretoken, freq)`` as arrays of their bytes, those of the alphabet kept."""
    def run(batches):
        for batch in batches:
            b = [np.frombuffer(x, np.uint8) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, b), np.int64, len(b))
            flat = np.concatenate(b) if b else np.empty(0, np.uint8)
            stay = kept[flat]
            sizes = np.bincount(np.repeat(np.arange(len(b)), sizes)[stay], minlength=len(b))
            yield _word_batch(flat[stay], sizes, batch.column(1).to_numpy())

    return run


def _rewritten(plan):
    """The words with the merges done since they were written last."""
    def run(batches):
        for batch in batches:
            for part in _segmented(*_words(batch), plan.value):
                yield _word_batch(*part)

    return run


def _summed(parts: list) -> pa.RecordBatch:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    d = np.zeros(len(keys), np.int64)
    np.add.at(d, place, np.concatenate([d for _, d in parts]))
    return pa.record_batch([pa.array(keys >> _BITS), pa.array((keys & _MASK).astype(np.int32)), pa.array(d)],
                           names=["pair", "t", "d"])


def _pair_rows(batches):
    """``(pair, 0, d)``: the pairs of the words as they are, summed in parts."""
    for batch in batches:
        s, n, f = _words(batch)
        word = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(word[:-1] == word[1:])
        yield _summed([((s[at] << 2 * _BITS) | (s[at + 1] << _BITS), f[word[at]])])


def _delta_rows(plan):
    """``(pair, t, d)``: by how much each merge ``t`` of the tried ones (those after the
    first ``n_done`` of the table) changes the count of each pair, summed in parts.
    Only words that hold a pair of the table are cut anew."""
    def run(batches):
        table, n_done = plan.value
        parts, held = [], 0

        def seen(rank, pair, change):
            nonlocal held
            new = rank > n_done
            parts.append(((pair[new] << _BITS) | (rank[new] - n_done), change[new]))
            held += int(new.sum())

        for batch in batches:
            for _ in _segmented(*_words(batch), table, seen):
                pass
            if held > _FLUSH:
                yield _summed(parts)
                parts, held = [], 0
        if parts:
            yield _summed(parts)

    return run


def _course(row, base: int):
    """A pair's course along the tried merges: ``(t, count, birth)`` after each change."""
    count, birth = 0, row["birth"]
    for e in sorted(row["events"]):
        if count == 0 and e["t"]:
            birth = base + e["t"]
        count += e["d"]
        yield e["t"], count, birth


def _taken(rows, bound, tried: list, base: int, names: list, min_frequency: int) -> list[int]:
    """The counts of those first tried merges that are the next ones of the one-by-one
    algorithm.  A merge's key is (-count, birth, left, right) at its turn; keys must
    ascend, stay before ``bound`` (what is not among ``rows`` is not before it), and
    no pair may have a smaller key at that turn."""
    def key(pair, count, birth):
        return -count, birth, names[pair >> _BITS], names[pair & _MASK]

    course = {r["pair"]: list(_course(r, base)) for r in rows}
    keys: list = []
    for j, pair in enumerate(tried, 1):
        before = [x for x in course.get(pair, ()) if x[0] < j]
        if not before or before[-1][1] < min_frequency:
            break
        k = key(pair, *before[-1][1:])
        if bound is not None and k[:2] >= bound or keys and k <= keys[-1]:
            break
        keys.append(k)
    take = len(keys)
    for pair, steps in course.items():
        for i, (t, count, birth) in enumerate(steps):
            if count > 0 and t < take:
                j = max(t + 1, bisect.bisect_right(keys, key(pair, count, birth)) + 1)
                if j <= (steps[i + 1][0] if i + 1 < len(steps) else take):
                    take = min(take, j - 1)
    return [-k[0] for k in keys[:take]]


def _guess(rows, bound, tried: list, take: int, base: int, names: list, merge, min_frequency: int, most: int) -> list[int]:
    """The pairs that are likely to come next: the one-by-one algorithm on ``rows``
    alone, where a pair that was tried changes the others as it did then.  Where two
    pairs share places and come in the other order than they were tried in, the
    later one loses as many to the earlier as the other way round."""
    counts, births, effects, losers, heap = {}, {}, {}, {}, []

    def push(pair):
        if counts[pair] >= min_frequency:
            heapq.heappush(heap, (-counts[pair], births[pair], names[pair >> _BITS], names[pair & _MASK], pair))

    def change(pair, d):
        if counts.get(pair, 0) <= 0 < counts.get(pair, 0) + d:
            births[pair] = base + take + len(out)
        counts[pair] = counts.get(pair, 0) + d
        if pair in births:
            push(pair)

    for r in rows:
        pair, now = r["pair"], (0, 0, r["birth"])
        for step in _course(r, base):
            if step[0] > take:
                break
            now = step
        counts[pair], births[pair] = now[1:]
        for e in r["events"]:
            if e["t"] > take:
                by = tried[e["t"] - 1]
                effects.setdefault(by, {})[pair] = e["d"]
                if e["d"] < 0:
                    losers.setdefault(pair, []).append(by)
        push(pair)
    out: list = []
    used = set()
    while heap and len(out) < most:
        k = heapq.heappop(heap)
        pair = k[4]
        if -k[0] != counts[pair] or k[1] != births[pair] or pair in used:
            continue
        if bound is not None and k[:2] >= bound:
            break
        out.append(pair)
        used.add(pair)
        mine = effects.setdefault(pair, {})
        for q in losers.get(pair, ()):                       # q was tried before this pair and took places of it
            d = effects[q].get(pair, 0)
            if q in used or q in mine or d >= 0:
                continue
            a, b, m = merge(pair)
            left, right, joined = merge(q)
            mine[q], effects[q][pair] = d, 0
            new, old = ((m << _BITS) | right, (a << _BITS) | joined) if left == b else ((left << _BITS) | m, (joined << _BITS) | b)
            mine[new] = mine.get(new, 0) - d
            effects[q][old] = effects[q].get(old, 0) + d
        for other, d in mine.items():
            if other not in used and d:
                change(other, d)
    return out


def bpe_train(histogram: DataFrame, vocab_size: int = 300, min_frequency: int = 2, limit_alphabet: int = 0,
              rewrite_every: int = 4, most_tried: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Learn merges on the pre-token histogram.

    Pair counts are a stored table that is kept by deltas.  Each round tries a guess of
    the next merges (at most ``most_tried``, twice as many as the last round took, 64 at
    least): one scan of the distinct words gives, for every pair, by how much each
    tried merge changes its count.  The first of them that are exactly the next ones
    of the one-by-one algorithm are taken, and the deltas up to there added; what the
    others did makes the next guess.  The first merge of a guess is always right, so
    each round takes one at least.  The words are rewritten every ``rewrite_every``
    rounds.  What the driver holds is the merges, the output, and the courses of the
    best pairs, a few for each tried merge.

    Of pairs with equal counts the older one goes first (the one that came to be by
    an earlier merge), then the smaller left, then the smaller right symbol.
    ``limit_alphabet`` keeps only the most frequent byte symbols (ties: in order of
    the alphabet); others are left out of words and vocabulary.

    Returns ``(merges(rank, left, right, count), vocab(token, id))``; ids: specials,
    then the byte symbols, then merged symbols in merge order."""
    if min_frequency < 1:
        raise ValueError("min_frequency must be >= 1")
    spark = histogram.sparkSession
    names = byte_alphabet()                                  # by symbol id; the first 256 are bytes
    alphabet = names[:]
    if 0 < limit_alphabet < len(alphabet):
        used = histogram.select(F.explode(to_byte_symbols(F.col("pretoken"))).alias("c"), "freq") \
            .groupBy("c").agg(F.sum("freq").alias("n")).collect()
        n = {r["c"]: r["n"] for r in used}                   # 256 rows at most
        alphabet = sorted(sorted(alphabet, key=lambda c: -n.get(c, 0))[:limit_alphabet], key=alphabet.index)
    ids = {c: i for i, c in enumerate(names)}
    kept = np.isin(np.array(names), alphabet)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    word_shape, shape = "w binary, freq bigint", "pair bigint, t int, d bigint"
    words = histogram.select("pretoken", F.col("freq").cast("bigint").alias("freq")).repartition(tasks)
    words = materialize(words.mapInArrow(_from_bytes(kept), word_shape), "bpe-words")
    base = SPECIAL_TOKENS + alphabet
    n_merges, merges, done, tried, rounds = max(0, vocab_size - len(base)), [], [], [], 0
    send = spark.sparkContext.broadcast
    to_try, take = min(64, most_tried), 0

    def merge(pair):
        a, b = pair >> _BITS, pair & _MASK
        m = ids.setdefault(names[a] + names[b], len(names))
        if m == len(names):
            if m > _MASK:
                raise ValueError(f"more than {_MASK} symbols")
            names.append(names[a] + names[b])
        return a, b, m

    def courses(changes, start):
        """Every pair's changes, stored, with a bound of its count along them."""
        sums = changes.repartition("pair").groupBy("pair", "t").agg(F.sum("d").alias("d"), F.min("birth").alias("birth"))
        first = F.min(F.when(F.col("d") > 0, F.col("t"))) + F.lit(start)
        return materialize(sums.groupBy("pair").agg(
            F.array_sort(F.collect_list(F.struct("t", "d"))).alias("events"), F.sum(F.greatest("d", F.lit(0))).alias("most"),
            F.coalesce(F.min("birth"), first).alias("birth")), "bpe-deltas")

    every = courses(words.mapInArrow(_pair_rows, shape).withColumn("birth", F.lit(0)), 0)
    while len(merges) < n_merges:
        start, wide, fresh, guess = len(merges), 4 * to_try + 64, True, []
        while not guess:
            rows = every.where(F.col("most") >= min_frequency).orderBy(F.desc("most"), "birth", "pair").limit(wide).collect()
            bound = (-rows[-1]["most"], rows[-1]["birth"]) if len(rows) == wide else None
            if tried and fresh:
                counts = _taken(rows, bound, tried, start, names, min_frequency)
                take, fresh = len(counts), not counts
                merges += [(start + t, names[p >> _BITS], names[p & _MASK], c) for t, (p, c) in enumerate(zip(tried, counts))]
                done = done + [merge(p) for p in tried[:take]]
            if not (tried and fresh):
                most = min(most_tried, n_merges - len(merges))
                guess = _guess(rows, bound, tried, take, start, names, merge, min_frequency, most)
            if bound is None or len(merges) >= n_merges:
                break
            wide *= 2
        if not guess:
            break
        last = F.aggregate(F.filter("events", lambda e: e["t"] <= take), F.struct(F.lit(0).cast("bigint").alias("d"), F.col("birth").alias("birth")),
                           lambda x, e: F.struct((x["d"] + e["d"]).alias("d"), F.when((x["d"] == 0) & (e["t"] > 0), F.lit(start) + e["t"])
                                                 .otherwise(x["birth"]).cast("int").alias("birth")))
        pairs = every.select("pair", F.lit(0).alias("t"), last.alias("_l")).select("pair", "t", "_l.d", "_l.birth").where("d > 0")
        rounds += 1
        if rounds % rewrite_every == 0:
            words, done = materialize(words.mapInArrow(_rewritten(send(_table(done))), word_shape), "bpe-words"), []
        tried, to_try, take = guess, len(guess), 0
        table = _table(done + [merge(p) for p in tried])
        deltas = words.mapInArrow(_delta_rows(send((table, len(done)))), shape).withColumn("birth", F.lit(None).cast("int"))
        every = courses(pairs.unionByName(deltas), len(merges))
    merge_df = spark.createDataFrame(merges, "rank int, left string, right string, count bigint")
    vocab = [(t, i) for i, t in enumerate(base)] + [(a + b, len(base) + i) for i, (_, a, b, _) in enumerate(merges)]
    return merge_df, spark.createDataFrame(vocab, "token string, id int")
