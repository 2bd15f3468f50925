"""Line dedup with two Bloom filters.

1. Every line key's 64-bit hash goes, pre-aggregated per task, to the shard of
   the hash space it belongs to.  A shard streams its hashes through two Bloom
   filters: a hash already in the once-seen filter enters the twice-seen one.
2. The twice-seen filters of all shards, at most ``max_filter_bytes`` together,
   are broadcast.  Only lines that they may hold (suspected repeats) are
   shuffled, with their full key, for the exact count of documents and the
   choice of the document that keeps the line.
3. Each document drops its confirmed lines.

A Bloom filter has no false negatives, so the result is exact at any filter
size: a corpus too large for ``max_filter_bytes`` only shuffles more suspects.
A key that a third of all documents hold is counted with partial aggregation,
and its rows meet the confirmed keys in a join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import give_back, table, text_slices
from corpusflow.session import materialize

_PROBES = 6                       # bits set per hash
_FLUSH = 100_000                  # hashes that a task holds before it passes them on


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased (``bytes``
    methods know ASCII white space and letters only)."""
    return line.strip().lower()


def _eligible(text: bytes | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text with at least ``min_chars`` code points."""
    keys = set()
    if text:
        for line in text.split(b"\n"):
            if len(line) >= min_chars:
                key = line_key(line)
                if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                    keys.add(key)
    return keys


def _bit_places(h: np.ndarray, bits: int) -> np.ndarray:
    """``_PROBES`` places per hash by double hashing; ``bits`` is a power of two."""
    u = h.astype(np.uint64)
    a = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    b = ((u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(21)) | np.uint64(1)
    steps = np.arange(_PROBES, dtype=np.uint64)[:, None]
    return ((a[None, :] + steps * b[None, :]) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    """A Bloom filter over 64-bit hashes; ``bits`` is a power of two."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at = _bit_places(h, self.bits).ravel()
        np.bitwise_or.at(self.words, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _bit_places(h, self.bits)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _power_of_two(n: float, least: int = 1 << 13) -> int:
    return max(least, 1 << int(np.ceil(np.log2(max(2.0, n)))))


def _hash_rows(min_chars: int):
    schema = pa.schema([("h", pa.int64()), ("c", pa.int8())])

    def rows(seen: dict) -> pa.RecordBatch:
        h = np.fromiter(seen.keys(), np.uint64, len(seen)).astype(np.int64)
        return pa.record_batch([pa.array(h), pa.array(np.fromiter(seen.values(), np.int8, len(seen)))], schema=schema)

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for text in texts:
                    for key in _eligible(text, min_chars):
                        h = xxhash.xxh3_64_intdigest(key)
                        seen[h] = 2 if h in seen else 1
                    if len(seen) >= _FLUSH:
                        yield rows(seen)
                        seen = {}
        yield rows(seen)
        give_back()

    return run


def twice_seen(hashes: DataFrame, bits_per_hash: int = 10, shard_hashes: int = 1 << 20,
               max_filter_bytes: int = 16 << 20) -> tuple[int, int, dict[int, bytes]]:
    """Shard count, bits per shard and each shard's twice-seen filter, for a
    table ``(h, c)`` of hashes (c >= 2: seen more than once by its task)."""
    n = hashes.count()
    shards = max(1, -(-n // shard_hashes))
    once_bits = _power_of_two(bits_per_hash * n / shards)
    # never more than max_filter_bytes over all shards
    twice_bits = min(once_bits, 1 << int(np.floor(np.log2(max(64, max_filter_bytes * 8 / shards)))))

    def build(batches):
        filters: dict[int, tuple[Bloom, Bloom]] = {}
        for batch in batches:
            h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
            if not len(first):
                continue
            h, c = h[first], np.add.reduceat(c.astype(np.int64), first)
            shard = np.mod(h, shards)
            for s in np.unique(shard):
                once, twice = filters.setdefault(int(s), (Bloom(once_bits), Bloom(twice_bits)))
                mine = h[shard == s]
                again = once.has(mine) | (c[shard == s] >= 2)
                twice.add(mine[again])
                once.add(mine)
        for s, (_, twice) in filters.items():
            yield pa.record_batch([pa.array([s], pa.int64()), pa.array([twice.words.tobytes()], pa.binary())],
                                  names=["shard", "bits"])

    rows = hashes.repartition(shards, F.pmod("h", F.lit(shards))).mapInArrow(build, "shard long, bits binary").collect()
    return shards, twice_bits, {r["shard"]: bytes(r["bits"]) for r in rows}


def _suspect_rows(min_chars: int, filters):
    def run(batches):
        shards, bits, data = filters.value
        blooms = {s: Bloom(bits, d) for s, d in data.items()}
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                at, keys = [], []
                for i, text in enumerate(texts, first):
                    mine = _eligible(text, min_chars)
                    at.extend([i] * len(mine))
                    keys.extend(mine)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)).astype(np.int64)
                shard, keep = np.mod(h, shards), np.zeros(len(h), bool)
                for s in np.unique(shard):
                    here = np.flatnonzero(shard == s)
                    if int(s) in blooms:
                        keep[here] = blooms[int(s)].has(h[here])
                places = np.flatnonzero(keep)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(np.asarray(at, np.int64)[places])),
                     pa.array([keys[i].decode() for i in places], pa.string())], names=["doc_id", "key"])
        give_back()

    return run


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_hash: int = 10,
                   max_filter_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, keys)``: for each document the keys of the lines it loses.

    A key counts once per distinct non-null doc_id; the largest keeps it.  A
    row without a doc_id is no document of its own, but loses the lines that
    the others prove to be repeated.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = materialize(narrow.select("text").mapInArrow(_hash_rows(min_chars), "h long, c tinyint"), "line-hashes")
    filters = docs.sparkSession.sparkContext.broadcast(
        twice_seen(hashes, bits_per_hash, max_filter_bytes=max_filter_bytes))
    suspects = materialize(narrow.mapInArrow(_suspect_rows(min_chars, filters), "doc_id long, key string"),
                           "line-suspects")
    confirmed = materialize(
        suspects.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("key", "keeper"), "line-repeats")
    return suspects.join(confirmed, "key") \
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))) \
        .groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                      T.StructField("n_dropped", T.LongType())])


def _kept_lines(texts: list, drops: list) -> pa.Array:
    kept, n_lines, n_dropped = [], [], []
    for t, keys in zip(texts, drops):
        t = t or b""
        if keys is None:
            kept.append(t)
            n_lines.append(t.count(b"\n") + 1)
            n_dropped.append(0)
            continue
        gone, lines = {k.encode() for k in keys}, t.split(b"\n")
        stay = [x for x in lines if line_key(x) not in gone]
        kept.append(b"\n".join(stay))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
        names=["text", "n_lines", "n_dropped"])


@F.arrow_udf(_KEPT)
def _keep_lines(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, drop in columns:
        yield pa.concat_arrays([_kept_lines([], []), *(_kept_lines(texts, drop.slice(first, len(texts)).to_pylist())
                                                       for first, texts in text_slices(text))])
    give_back()


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_hash: int = 10,
                max_filter_bytes: int = 16 << 20) -> DataFrame:
    """``(row, kept)``: every row of ``docs`` as a struct (so that no column
    name can clash) and ``kept = (text, n_lines, n_dropped)``.

    Texts are split at ``\\n``; a null or empty text is one empty line.  Lines
    whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, except from the document with the largest
    doc_id that holds it (there all its occurrences stay).
    """
    drops = repeated_lines(docs, min_chars, min_docs, bits_per_hash, max_filter_bytes)
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(drops, F.col("row.doc_id").eqNullSafe(drops["doc_id"]), "left") \
               .select("row", _keep_lines(F.col("row.text"), F.col("keys")).alias("kept"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "kept.n_lines", "kept.n_dropped",
                      F.sha2(F.col("kept.text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, i, ls[i] AS line FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, rep.key IS NOT NULL AND k.doc_id IS DISTINCT FROM rep.keeper AS gone
      FROM k LEFT JOIN rep ON k.key = rep.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
