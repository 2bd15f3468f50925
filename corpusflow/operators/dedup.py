"""Deduplication operators (D1, D2, D5) and the corpus reduction report.

Plan shape (see ``explain``): the only text-bearing shuffle is the one that
co-locates documents by ``order`` for the final reassembly; the hash-keyed
"first wins" steps shuffle only ``(hash, order[, pos])`` rows, and each of
them is a ``row_number() = 1`` window that Spark plans as a partial
WindowGroupLimit before the exchange, so a hot duplicate (a boilerplate line
in a third of all documents) is cut to one row per map task before shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import is_long_enough, py_strip, split_lines
from corpusflow.operators.keys import first_wins
from corpusflow.session import materialize


def _digest(col) -> F.Column:
    """md5 as 16 bytes: a narrow key for texts."""
    return F.unhex(F.md5(col))


def dedup_documents(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Exact-content dedup; the first document in ``order`` wins.

    Winners are found on the narrow ``(md5, order)`` projection, then the
    documents are semi-joined back on ``order`` (so the text is shuffled once,
    by the document key that downstream operators group on)."""
    hashes = docs.select(order, _digest(F.col(text)).alias("_h"))
    winners = first_wins(hashes, "_h", [F.col(order)]).select(order)
    return docs.join(winners, order, "left_semi")


def distinct_keep_first(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``list(dict.fromkeys(texts))`` — ordered distinct of the texts.

    The window runs on ``(md5, order)`` alone; rows come back by a semi-join on
    both, so no exchange or sort is keyed by a text.  Rows that repeat text and
    order are reduced to one (the one with the least hash of all columns) in the
    partitioning of that join."""
    keyed = df.withColumn("_h", _digest(F.col(text)))
    winners = first_wins(keyed.select(order, "_h"), "_h", [F.col(order)])
    winners = winners.select(F.col(order).alias("_wo"), F.col("_h").alias("_wh"))
    same = F.col("_h").eqNullSafe(F.col("_wh")) & F.col(order).eqNullSafe(F.col("_wo"))
    kept = keyed.join(winners, same, "left_semi")
    return first_wins(kept, [order, "_h"], [F.xxhash64(*[f"`{c}`" for c in df.columns])]).drop("_h")


def narrow_documents(docs: DataFrame, text: str = "text", order: str = "doc_id", min_length: int = 0,
                     sequence_min_len: int = 50) -> DataFrame:
    """What dedup needs of each document, from one scan without an exchange:
    ``(order, n_chars, long_enough, doc_hash, lines(pos, hash))``; ``lines`` are
    those whose stripped form has at least ``sequence_min_len`` code points."""
    stripped = F.transform(split_lines(F.col(text)), lambda x: py_strip(x))
    hashed = F.transform(stripped, lambda x, i: F.when(F.length(x) >= sequence_min_len, F.struct(
        i.cast("int").alias("pos"), _digest(x).alias("hash"))))
    return docs.select(order, F.length(text).cast("bigint").alias("n_chars"),
                       is_long_enough(text, min_length).alias("long_enough"), _digest(F.col(text)).alias("doc_hash"),
                       F.filter(hashed, lambda x: x.isNotNull()).alias("lines"))


def keep_lists(narrow: DataFrame, order: str = "doc_id") -> DataFrame:
    """Positions of the long lines each document keeps, ``(order, keep_pos)``.

    Among equal stripped long lines the first by ``(order, pos)`` corpus-wide
    wins (repeats inside one document are removed too)."""
    lines = narrow.select(order, F.explode("lines").alias("_l")).select(order, "_l.pos", F.col("_l.hash").alias("_lh"))
    winners = first_wins(lines, "_lh", [F.col(order), F.col("pos")])
    return winners.groupBy(order).agg(F.collect_list("pos").alias("keep_pos"))


def apply_keep_lists(docs: DataFrame, keep: DataFrame, text: str = "text", order: str = "doc_id",
                     sequence_min_len: int = 50, how: str = "left") -> DataFrame:
    """Rebuild each document from its short lines plus its winning long lines,
    in line order; documents with no line left are dropped.  With ``how="inner"``
    so are documents that ``keep`` does not list.

    Per document the work is linear: positions are combined with a hash-set
    ``array_union`` and sorted, then gathered by index."""
    # the split is materialised below the join, so the lambdas index an
    # attribute (O(1) per access) instead of re-splitting the text
    with_lines = docs.withColumn("_lines", split_lines(F.col(text)))
    lines = F.col("_lines")
    idx = F.sequence(F.lit(0), F.size(lines) - 1)
    short_idx = F.filter(idx, lambda i: F.length(py_strip(F.element_at(lines, i + 1))) < sequence_min_len)
    keep_idx = F.array_sort(F.array_union(short_idx, F.coalesce(F.col("keep_pos"),
                                                                F.array().cast("array<int>"))))
    kept = F.transform(keep_idx, lambda i: F.element_at(lines, i + 1))
    out = with_lines.join(keep, order, how).withColumn("_kept", kept)
    return (out.where(F.size("_kept") > 0)
            .withColumn(text, F.array_join("_kept", "\n"))
            .drop("_kept", "keep_pos", "_lines"))


def dedup_paragraphs(docs: DataFrame, text: str = "text", order: str = "doc_id",
                     sequence_min_len: int = 50) -> DataFrame:
    """Corpus-wide dedup of stripped lines (see :func:`keep_lists`)."""
    narrow = materialize(narrow_documents(docs, text, order, 0, sequence_min_len), "narrow-documents")
    keep = materialize(keep_lists(narrow, order), "line-winners")
    return apply_keep_lists(docs, keep, text, order, sequence_min_len)


def stored_winners(narrow: DataFrame, order: str = "doc_id", lines: bool = True) -> DataFrame:
    """D1 and D2 winners as one narrow stored table ``(order, keep_pos)``: the
    documents that stay and the long lines that each of them keeps."""
    gated = narrow.where("long_enough")
    first = materialize(first_wins(gated.select(order, "doc_hash"), "doc_hash", [F.col(order)]).select(order), "document-winners")
    if not lines:
        return first
    kept = keep_lists(gated.join(first, order, "left_semi"), order)
    return materialize(first.join(kept, order, "left"), "stored-winners")


def reduction_report(docs_in: DataFrame, docs_out: DataFrame, text: str | None = "text",
                     min_length: int = 100) -> DataFrame:
    """Documents / characters in and out and the reduction percentages.

    ``docs_in`` counts every input row; ``chars_in`` only those passing the
    length gate (duplicates included).  One aggregate over tagged rows.  Without
    ``text`` the tables hold lengths (``n_chars``) already."""
    length = F.length(F.col(text)).cast("bigint") if text else F.col("n_chars")
    tagged = (docs_in.select(F.lit(0).alias("_side"), length.alias("_len"))
              .unionByName(docs_out.select(F.lit(1).alias("_side"), length.alias("_len"))))
    agg = tagged.agg(
        F.count_if(F.col("_side") == 0).cast("bigint").alias("docs_in"),
        F.count_if(F.col("_side") == 1).cast("bigint").alias("docs_out"),
        F.coalesce(F.sum(F.when((F.col("_side") == 0) & (F.col("_len") >= min_length), F.col("_len"))),
                   F.lit(0)).cast("bigint").alias("chars_in"),
        F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("_len"))), F.lit(0)).cast("bigint").alias("chars_out"),
    )
    return agg.select(
        "docs_in", "docs_out", "chars_in", "chars_out",
        F.round(100 * (1 - F.col("docs_out") / F.greatest(F.lit(1), F.col("docs_in"))), 6).alias("doc_reduction_pct"),
        F.round(100 * (1 - F.col("chars_out") / F.greatest(F.lit(1), F.col("chars_in"))), 6).alias("char_reduction_pct"),
    )
