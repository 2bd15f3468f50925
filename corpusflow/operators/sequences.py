"""Token streams, training blocks and batches.

The flat token stream of the reference (one list over all documents) is a
DataFrame ``(g, token_id)`` where ``g`` = document offset + position; the
document offsets are a two-level prefix sum over per-document token counts.
Training windows are put together from slices of arrays that overlap them: every
group holds exactly ``B+1`` tokens in a few slices, so no group grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import py_strip
from corpusflow.operators.keys import global_position, global_prefix_sum, range_bucket, with_quantile_bucket
from corpusflow.session import materialize


def _stream_documents(encoded: DataFrame, ids: str) -> DataFrame:
    """The documents that add to a stream: a blank one does not, not even with
    its begin and end ids."""
    docs = encoded.where(F.size(ids) > 0)
    if "blank" in encoded.columns:
        docs = docs.where(~F.col("blank"))
    elif "text" in encoded.columns:
        docs = docs.where(py_strip(F.col("text")) != "")
    return docs


def flat_token_stream(encoded: DataFrame, ids: str = "ids", order: str = "doc_id",
                      bounds: tuple[int, int] | None = None) -> DataFrame:
    """``(g, token_id)`` — all documents' ids concatenated in ``order``;
    documents without ids and blank ones (marked by the encoders) add nothing.
    ``bounds`` = (min, max) of ``order`` (read from ``encoded`` when not given)."""
    docs = _stream_documents(encoded, ids)
    if bounds:
        docs = docs.withColumn("_qb", range_bucket(encoded, order, bounds=bounds))
    else:
        docs = with_quantile_bucket(docs, order, "_qb")
    with_off = global_prefix_sum(docs, [F.col(order)], F.col("_qb"), F.size(ids), "_doc_off")
    tokens = with_off.select("_doc_off", F.posexplode(ids).alias("_pos", "token_id"))
    return tokens.select((F.col("_doc_off") + F.col("_pos")).cast("bigint").alias("g"),
                         F.col("token_id").cast("bigint"))


def word_stream(docs: DataFrame, vocab: DataFrame, text: str = "text", order: str = "doc_id",
                bounds: tuple[int, int] | None = None) -> tuple[DataFrame, int]:
    """F4 for whitespace tokens, without materialising per-document id arrays:
    per-document token counts (a narrow projection) -> two-level prefix sum ->
    the small offsets table ``(order, offset)`` is checkpointed (it is read
    twice: joined to the documents and summed for the total) -> tokens
    exploded with their global position ``g`` -> vocabulary ids by a lookup
    join.  Returns ``((g, token_id), n_tokens)``."""
    from corpusflow.functions.text import word_tokens
    from corpusflow.operators.vocab import lookup_ids
    toks = word_tokens(F.col(text))
    counts = docs.select(order, F.size(toks).alias("_n")).where(F.col("_n") > 0)
    if bounds:
        counts = counts.withColumn("_qb", range_bucket(docs, order, bounds=bounds))
    else:
        counts = with_quantile_bucket(counts, order, "_qb", source=docs.select(order))
    offs = global_prefix_sum(counts, [F.col(order)], F.col("_qb"), F.col("_n"), "_doc_off").select(order, "_doc_off", "_n")
    offs = materialize(offs, "token-offsets")
    n_tokens = offs.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = docs.join(offs.select(order, "_doc_off"), order) \
        .select("_doc_off", F.posexplode(toks).alias("_pos", "_tok"))
    rows = rows.select((F.col("_doc_off") + F.col("_pos")).cast("bigint").alias("g"), "_tok")
    return lookup_ids(rows, vocab, "_tok", "token_id").select("g", "token_id"), int(n_tokens)


def block_starts(n_tokens: int, block_size: int, stride: int) -> tuple[int, int, bool]:
    """Validate and return ``(max_start, last_regular_start, has_tail)``."""
    if block_size < 2:
        raise ValueError(f"block_size {block_size}: blocks hold two tokens or more")
    if stride < 1:
        raise ValueError(f"stride {stride}: blocks must move on")
    if n_tokens < block_size + 1:
        raise ValueError(f"{n_tokens} tokens do not fill one block of {block_size} and its next token")
    max_start = n_tokens - (block_size + 1)
    last = (max_start // stride) * stride
    return max_start, last, last != max_start


def _windows(slices: DataFrame, block_size: int) -> DataFrame:
    """Windows from their slices ``(start, at, part)``: a few arrays each."""
    blocks = slices.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_w"))
    ids = F.flatten(F.col("_w.part"))
    return blocks.select("start", F.slice(ids, 1, block_size).alias("x"), F.slice(ids, 2, block_size).alias("y"))


def _cut(rows: DataFrame, at: str, ids: str, max_start: int, last: int, has_tail: bool, block_size: int, stride: int) -> DataFrame:
    """Arrays that begin at place ``at`` of the stream, cut to the slices
    ``(start, at, part)`` that overlap each window."""
    first, end = F.col(at), F.col(at) + F.size(ids)
    k_lo = F.greatest(F.lit(0), F.ceil((first - block_size) / F.lit(float(stride)))).cast("bigint")
    k_hi = F.least(F.floor((end - 1) / F.lit(float(stride))), F.lit(last // stride)).cast("bigint")
    starts = F.when(k_hi >= k_lo, F.transform(F.sequence(k_lo, k_hi), lambda k: k * stride)) \
        .otherwise(F.array().cast("array<bigint>"))
    if has_tail:
        overlaps = (end > max_start) & (first <= max_start + block_size)
        starts = F.concat(starts, F.when(overlaps, F.array(F.lit(max_start).cast("bigint")))
                          .otherwise(F.array().cast("array<bigint>")))

    def part(start):
        lo, hi = F.greatest(start, first), F.least(start + block_size + 1, end)
        return F.struct(start.alias("start"), lo.alias("at"),
                        F.slice(F.col(ids), (lo - first + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    return rows.select(F.explode(F.transform(starts, part)).alias("_s")).select("_s.start", "_s.at", "_s.part")


def pack_blocks(stream: DataFrame, block_size: int = 256, stride: int = 128,
                n_tokens: int | None = None) -> DataFrame:
    """windows of ``block_size + 1`` tokens at ``stride``, plus a tail
    window anchored at the end; ``x`` = first B ids, ``y`` = the same shifted
    by one.  Windows cross document boundaries.

    ``stream`` has a row ``(g, token_id)`` per token: tokens are gathered once to
    cells of a stride's length, and windows take slices of cells.  Documents that
    are arrays already go through :func:`pack_documents` without any such rows."""
    if n_tokens is None:
        n_tokens = stream.count()
    max_start, last, has_tail = block_starts(n_tokens, block_size, stride)
    cells = stream.groupBy(F.floor(F.col("g") / stride).cast("bigint").alias("_c")).agg(
        F.sort_array(F.collect_list(F.struct("g", "token_id"))).alias("_t"))
    cells = cells.select((F.col("_c") * stride).alias("_at"), F.col("_t.token_id").alias("_ids"))
    return _windows(_cut(cells, "_at", "_ids", max_start, last, has_tail, block_size, stride), block_size)


def pack_documents(encoded: DataFrame, block_size: int = 256, stride: int = 128, ids: str = "ids",
                   order: str = "doc_id") -> DataFrame:
    """F4 + F5 on encoded documents: each document's id array is cut to the slices
    that overlap each window, and a window is put together from a few slices by
    their place.  No row per token at any point; what is shuffled is the arrays
    (once, to their places) and ``(block_size + 1) / stride`` times as slices."""
    docs = materialize(_stream_documents(encoded, ids).select(order, ids), "stream-documents")
    n_tokens = docs.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()[0]
    max_start, last, has_tail = block_starts(int(n_tokens), block_size, stride)
    placed = global_prefix_sum(with_quantile_bucket(docs, order, "_qb"), [F.col(order)], F.col("_qb"), F.size(ids), "_at")
    return _windows(_cut(placed, "_at", ids, max_start, last, has_tail, block_size, stride), block_size)


def assign_batches(df: DataFrame, order: str = "doc_id", batch_size: int = 32,
                   out: str = "batch", bounds: tuple[int, int] | None = None) -> DataFrame:
    """consecutive rows in ``order`` -> batch ids (dense two-level index)."""
    if bounds:
        df = df.withColumn("_qb", range_bucket(df, order, bounds=bounds))
    else:
        df = with_quantile_bucket(df, order, "_qb")
    idx = global_position(df, [F.col(order)], F.col("_qb"), "_idx")
    return idx.withColumn(out, F.floor(F.col("_idx") / batch_size).cast("bigint")).drop("_idx", "_qb")


def pad_batches(df: DataFrame, ids: str = "ids", batch: str = "batch", max_length: int = 512,
                pad_id: int = 0) -> DataFrame:
    """truncate at ``max_length``, pad every row to its batch's longest
    sequence, attention mask of ones then zeros.  Batches are bounded by the
    batch size, so the per-batch window is small."""
    t = F.slice(F.col(ids), 1, max_length)
    longest = F.max(F.size(t)).over(Window.partitionBy(batch))
    out = df.withColumn("_t", t).withColumn("_L", longest)
    pad_n = F.col("_L") - F.size("_t")
    return (out.withColumn("input_ids", F.concat("_t", F.array_repeat(F.lit(pad_id).cast("bigint"), pad_n)))
            .withColumn("attention_mask", F.concat(F.transform("_t", lambda x: F.lit(1)),
                                                   F.array_repeat(F.lit(0), pad_n)))
            .drop("_t", "_L"))
