"""Benchmark decontamination with a broadcast hash set of test n-grams.

Every benchmark item is cut to its word windows; the distinct windows (64-bit
hash, words, item ids) form the broadcast hash set.  Training documents are
scanned in place: the hashes of all their windows are built by doubling
(hashes of 2, 4, 8, ... words from two shorter ones), probed in the hash set,
and each probe that hits is verified word by word.  DataFrame functions only.

The hash set is broadcast in blocks of at most ``block_windows`` windows, so
what is broadcast stays bounded however many test items there are: a larger
benchmark takes more scans, not a larger broadcast.  Only hits and one row per
document are shuffled, never the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lower_ascii, text_key
from corpusflow.session import materialize

#: separators of the words of documents and test items (after lower-casing A-Z)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: the same in a text whose A-Z are still in place
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: a word with the separators before it
RAW_PIECE = RAW_SEPARATORS + "*[^" + RAW_SEPARATORS[1:] + "+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS + "+"), "")


def _joined(left: str, shift: int, right: str) -> Column:
    """At i the hash of ``left[i]`` and ``right[i + shift]``."""
    return F.transform(F.col(left), lambda x, i: F.xxhash64(x, F.get(F.col(right), i + shift)))


def _with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``h<L>``: for each length L the hashes of all L-word windows of
    ``words``, in order.  Hashes of 2^k words come from two of 2^(k-1)."""
    df = df.withColumn("p1", F.transform("words", lambda w: F.xxhash64(w)))
    size = 1
    while 2 * size <= max(lengths):
        df = df.withColumn(f"p{2 * size}", _joined(f"p{size}", size, f"p{size}"))
        size *= 2
    for n in lengths:
        powers = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
        have, at = powers[0], f"p{powers[0]}"
        for p in powers[1:]:
            df = df.withColumn(f"s{n}_{have + p}", _joined(at, have, f"p{p}"))
            at, have = f"s{n}_{have + p}", have + p
        df = df.withColumn(f"h{n}", F.slice(F.col(at), F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0))))
    return df


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``(h, wlen, wtext, items)``: one row per distinct window.  An item with
    fewer words than ``window`` (but some) is one window; a null item_id or an
    item without words has none."""
    items = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words")) \
        .where(F.col("item").isNotNull() & (F.size("words") > 0)) \
        .withColumn("wlen", F.least(F.size("words"), F.lit(window)))
    cut = items.select("item", "wlen", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("wlen") + 1),
        lambda i: F.slice(F.col("words"), i, F.col("wlen")))).alias("words"))
    cut = cut.groupBy("wlen", "words").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    lengths = [r[0] for r in cut.select("wlen").distinct().collect()]      # at most `window` values
    if not lengths:
        return cut.select(F.lit(0).cast("long").alias("h"), "wlen", F.lit("").alias("wtext"), "items")
    hashed = _with_window_hashes(cut, sorted(lengths))
    by_length = F.coalesce(*[F.when(F.col("wlen") == n, F.get(F.col(f"h{n}"), F.lit(0))) for n in lengths])
    return hashed.select(by_length.alias("h"), "wlen", F.array_join("words", " ").alias("wtext"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13,
                  block_windows: int = 250_000) -> DataFrame:
    """One row per distinct ``(doc_id, text)``: ``doc_id, text_key, n_rows``
    (rows of ``docs`` that are equal in both), ``n_words``, ``n_hit`` (words
    inside any occurrence of a window), ``spans`` (the occurrences as
    ``(pos, wlen)``, words from 0, sorted) and ``items`` (sorted ids, as
    strings, of the items with occurring windows).

    A null or empty text has no words; a null doc_id is a value like any
    other.  Other columns of ``docs`` are not looked at.
    """
    bench = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    found = bench.groupBy("wlen").count().collect()                        # at most `window` rows
    lengths, n_windows = sorted((r["wlen"] for r in found), reverse=True), sum(r["count"] for r in found)
    n_blocks = max(1, -(-n_windows // block_windows))
    base = docs.select("doc_id", "text").select("doc_id", text_key(F.col("text")).alias("text_key"),
                                                words_of(F.col("text")).alias("words"))
    n = F.size("words")
    if not lengths:
        lengths = [window]
    hashed = _with_window_hashes(base, lengths)
    # element 0 stands for the document itself, so that documents without hits stay
    every = F.concat(F.array(F.lit(None).cast("long")), *[F.col(f"h{k}") for k in lengths])
    probes = hashed.select("doc_id", "text_key", "words", F.posexplode(every).alias("at", "h"))
    pos, wlen, before = None, None, F.lit(0)
    for k in lengths:                                                      # place in `every` -> word position
        here = F.col("at") <= before + F.greatest(n - (k - 1), F.lit(0))
        pos = F.when(here, F.col("at") - 1 - before) if pos is None else pos.when(here, F.col("at") - 1 - before)
        wlen = F.when(here, F.lit(k)) if wlen is None else wlen.when(here, F.lit(k))
        before = before + F.greatest(n - (k - 1), F.lit(0))
    parts = []
    for b in range(n_blocks):
        block = bench if n_blocks == 1 else bench.where(F.pmod(F.col("h"), F.lit(n_blocks)) == b)
        block = block.select("h", F.col("wlen").alias("want_len"), "wtext", F.col("items").alias("window_items"))
        hit = probes.join(F.broadcast(block), "h", "left")
        same = (F.col("want_len") == wlen) & \
               (F.col("wtext") == F.array_join(F.slice(F.col("words"), pos + 1, F.col("want_len")), " "))
        first = (F.col("at") == 0) if b == 0 else F.lit(False)
        real = F.col("wtext").isNotNull() & same
        parts.append(hit.where(first | real).select(
            "doc_id", "text_key", F.when(F.col("at") == 0, n).alias("n_words"),
            F.when(F.col("at") > 0, F.struct(pos.alias("pos"), F.col("want_len").alias("wlen"))).alias("span"),
            "window_items"))
    hits = reduce(DataFrame.unionByName, parts)
    per_doc = hits.groupBy("doc_id", "text_key").agg(
        F.count("n_words").alias("n_rows"), F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("window_items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["wlen"] - F.greatest(s["pos"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["pos"] + s["wlen"]).alias("end")),
        lambda acc: acc["n"].cast("long"))
    return per_doc.withColumn("n_hit", covered)


def is_contaminated(min_share_of: int = 20) -> Column:
    """At least one in ``min_share_of`` words is inside an occurrence."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share_of >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = 13,
                  min_share_of: int = 20, block_windows: int = 250_000) -> DataFrame:
    """``docs`` (all its columns) without benchmark passages.

    ``mode="documents"`` drops the contaminated documents; ``mode="spans"``
    keeps every document and cuts the hit words, each with the separators
    before it, out of its text.
    """
    found = contamination(docs, benchmark, window, block_windows)
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    if mode == "documents":
        bad = materialize(found.where(is_contaminated(min_share_of)).select("doc_id", "text_key"), "contaminated")
        return row.join(bad, row["id"].eqNullSafe(bad["doc_id"]) & (row["key"] == bad["text_key"]), "left_anti") \
                  .select("row.*")
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents or spans")
    hit = materialize(found.where(F.col("n_hit") > 0).select(
        "doc_id", "text_key", F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["wlen"] - 1)))
        .alias("hit_words")), "contaminated-spans")
    both = row.join(hit, row["id"].eqNullSafe(hit["doc_id"]) & (row["key"] == hit["text_key"]), "left")
    text = F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(RAW_PIECE), F.lit(0))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("hit_words")),
        lambda i: F.get(F.col("pieces"), i))
    tail = F.regexp_extract(text, RAW_SEPARATORS + "*$", 0)
    out = both.withColumn("pieces", F.when(F.col("hit_words").isNotNull(), pieces)) \
              .withColumn("cut", F.when(F.col("hit_words").isNotNull(), F.concat(F.array_join(kept, ""), tail))
                          .otherwise(text))
    return out.select(F.col("row").withField("text", F.col("cut")).alias("row")).select("row.*")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    from corpusflow.llm.common import table
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # rows that repeat a document come back as often as they were
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        is_contaminated().alias("contaminated"),
                        F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int"))).alias("copy")).drop("copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT rid, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
