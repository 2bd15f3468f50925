"""Token ids in wavelet-matrix files.

Documents are dealt to ranges of doc_id and sorted; each task encodes its range
and cuts it to shards of about ``shard_tokens`` ids.  A shard is one row of a
compressed file: one bit plane per bit of the vocabulary, each with the number
of its zeros and a rank directory, and the document ends.  From a shard any id
can be read, any id counted up to any place, and its k-th occurrence found,
without decoding the rest.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.llm.common import crc32_of, give_back, read_bytes, row_slices, table, tokenizer_path
from corpusflow.llm.word_tokens import tokenizer_of
from corpusflow.session import checkpoint_dir

END_ID = 1                        # fixed value: closes each document
_RANK_BITS = 512                  # bits between two entries of a rank directory
_SLICE_BYTES = 4 << 20            # text in work at a time
_BLOCK = 4096                     # ranges whose offsets are summed together

SHARD_SCHEMA = ("part long, seq long, n_tokens long, bits int, doc_ids array<bigint>, ends array<bigint>, "
                "planes array<binary>, zeros array<bigint>, ranks array<binary>")


class WaveletMatrix:
    """Bit planes of a sequence, most significant first; below each plane the
    sequence is parted stably into zeros and ones."""

    def __init__(self, n: int, bits: int, planes: list, zeros: list, ranks: list):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for level in reversed(range(bits)):
            one = (values & values.dtype.type(1 << level)) != 0
            packed = np.packbits(one)
            planes.append(packed.tobytes())
            z = len(one) - int(np.count_nonzero(one))
            parted = np.empty_like(values)
            np.compress(~one, values, out=parted[:z])
            np.compress(one, values, out=parted[z:])
            values = parted
            zeros.append(z)
            per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _RANK_BITS // 8),
                                  dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            ranks.append(np.r_[0, np.cumsum(per)].astype("<u4").tobytes())
        return cls(len(values), bits, planes, zeros, ranks)

    def values(self, dtype=np.uint32) -> np.ndarray:
        """The whole sequence, joined from the lowest plane up."""
        now = np.zeros(self.n, dtype)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(now)
            up[~one] = now[:z]
            up[one] = now[z:] | dtype(1 << level)
            now = up
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        plane, block = self.planes[level], i // _RANK_BITS
        count, at = int(self.ranks[level][block]), block * _RANK_BITS // 8
        count += int(np.bitwise_count(plane[at:i // 8]).sum())
        if i % 8:
            count += (int(plane[i // 8]) >> (8 - i % 8)).bit_count()
        return count

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The value at place ``i``."""
        value = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            value = value << 1 | one
            i = self.zeros[level] + self._ones(level, i) if one else i - self._ones(level, i)
        return value

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before place ``i``."""
        lo, hi = self._range(value, i)
        return hi - lo

    def _range(self, value: int, i: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def _place_of(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            n = self._ones(level, mid + 1)
            if (n if one else mid + 1 - n) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) ``value``; -1 if there are fewer."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in reversed(range(self.bits)):
            one = value >> (self.bits - 1 - level) & 1
            i = self._place_of(level, one, i - self.zeros[level] if one else i)
        return i


def _shard_rows(data, shard_tokens: int):
    """Encodes a task's sorted documents and yields its shards."""

    def run(batches):
        tok = tokenizer_of(data.value)
        bits = max(1, (tok.vocab - 1).bit_length())
        part, seq = TaskContext.get().partitionId(), 0
        ids, ends, docs, size = [], [], [], 0

        def shard():
            values = np.concatenate(ids)
            wm = WaveletMatrix.build(values, bits)
            return pa.record_batch([
                pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(values)], pa.int64()),
                pa.array([bits], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([ends], pa.list_(pa.int64())),
                pa.array([[p.tobytes() for p in wm.planes]], pa.list_(pa.binary())),
                pa.array([wm.zeros], pa.list_(pa.int64())),
                pa.array([[r.tobytes() for r in wm.ranks]], pa.list_(pa.binary()))],
                names=["part", "seq", "n_tokens", "bits", "doc_ids", "ends", "planes", "zeros", "ranks"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last in row_slices(batch.column(1), _SLICE_BYTES):
                flat, sizes = tok.encode_column(batch.column(1).slice(first, last - first))
                flat = np.insert(flat, np.cumsum(sizes), END_ID)
                cuts = np.cumsum(np.r_[0, sizes + 1]).tolist()
                for doc_id, a, b in zip(names[first:last], cuts, cuts[1:]):
                    ids.append(flat[a:b])
                    size += b - a
                    docs.append(doc_id)
                    ends.append(size)
                    if size >= shard_tokens:
                        yield shard()
                        seq += 1
                        ids, ends, docs, size = [], [], [], 0
        if docs:
            yield shard()
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None,
                 range_bytes: int = 16 << 20, shard_tokens: int = 1 << 20) -> str:
    """Encodes every row of ``docs`` (a null text is empty), appends the end id
    and writes the ids to ``path`` in ascending order of doc_id (null ids first;
    rows that repeat one in order of their texts).  Returns the path, by default
    a new one in the shared checkpoint folder.  Other columns are not looked at."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    data = spark.sparkContext.broadcast(read_bytes(tokenizer or tokenizer_path("word_bpe_49k.json")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(_shard_rows(data, shard_tokens), SHARD_SCHEMA) \
        .write.option("compression", "zstd").parquet(path)
    return path


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["zeros"], row["ranks"])


def _each_shard(batches):
    """Shards one by one: an Arrow batch may hold many."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _document_rows(batches):
    for row in _each_shard(batches):
        dtype = np.uint16 if row["bits"] <= 16 else np.uint32
        values = _matrix(row).values(dtype).astype("<u4")
        ends = np.array(row["ends"], np.int64)
        begins = np.r_[0, ends[:-1]]
        yield pa.record_batch([
            pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(ends), pa.int64()),
            pa.array([row["seq"]] * len(ends), pa.int64()), pa.array(begins, pa.int64()),
            pa.array(ends - begins, pa.int64()),
            pa.array([crc32_of(values[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64())],
            names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])


class TokenStore:
    """Reads the files that ``write_tokens`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def offsets(self) -> DataFrame:
        """``(part, seq, shard_start)``: ids of all shards before each.  Sums are
        taken within a range, within a block of ranges, and over the blocks."""
        s = self.shards.select("part", "seq", "n_tokens")
        before = lambda w: F.coalesce(F.sum("n_tokens").over(
            w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        inside = s.withColumn("in_part", before(W.partitionBy("part").orderBy("seq")))
        parts = s.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")) \
            .withColumn("block", F.floor(F.col("part") / _BLOCK))
        blocks = parts.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens")) \
            .withColumn("in_all", before(W.orderBy("block"))).drop("n_tokens")
        parts = parts.withColumn("in_block", before(W.partitionBy("block").orderBy("part"))).join(blocks, "block")
        return inside.join(parts.select("part", (F.col("in_block") + F.col("in_all")).alias("p")), "part") \
            .select("part", "seq", (F.col("p") + F.col("in_part")).alias("shard_start"))

    def documents(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` of every document, from its
        decoded ids; ``start`` is the number of ids before it."""
        docs = self.shards.mapInArrow(
            _document_rows, "doc_id long, part long, seq long, at long, n_tokens long, ids_crc32 long")
        return docs.join(self.offsets(), ["part", "seq"]).select(
            "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

    def count(self, ids: list[int]) -> DataFrame:
        """``(id, n)``: how often each of ``ids`` (a caller's short list) occurs."""
        def run(batches):
            for row in _each_shard(batches):
                wm = _matrix(row)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([wm.rank(i, wm.n) for i in ids], pa.int64())],
                                      names=["id", "n"])
        return self.shards.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    def occurrences(self, token: int) -> DataFrame:
        """``(doc_id, i)``: every place of ``token``, counted from its document's begin."""
        def run(batches):
            for row in _each_shard(batches):
                wm = _matrix(row)
                at = np.array([wm.select(token, k) for k in range(wm.rank(token, wm.n))], np.int64)
                ends = np.array(row["ends"], np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.record_batch([pa.array([row["doc_ids"][d] for d in doc], pa.int64()),
                                       pa.array(at - np.r_[0, ends][doc], pa.int64())], names=["doc_id", "i"])
        return self.shards.mapInArrow(run, "doc_id long, i long")

    def access(self, doc_id: int, i: int) -> DataFrame:
        """``(id)``: the ``i``-th id of a document (no row if it has fewer)."""
        def run(batches):
            for row in _each_shard(batches):
                for d, (a, b) in enumerate(zip([0, *row["ends"]], row["ends"])):
                    if row["doc_ids"][d] == doc_id and 0 <= i < b - a:
                        yield pa.record_batch([pa.array([_matrix(row).access(a + i)], pa.int64())], names=["id"])
        return self.shards.where(F.array_contains("doc_ids", doc_id)).mapInArrow(run, "id long")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"))
    return TokenStore(spark, path).documents()
