"""D3: the corpus preprocessing job — length gate, exact document dedup,
optional corpus-wide paragraph dedup, length re-check.  All columns other than
the text are passed through unchanged (the reference rewrites only ``text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import dedup
from corpusflow.session import materialize


def _preprocess(docs: DataFrame, text: str, order: str, min_length: int, dedup_mode: str,
                sequence_min_len: int) -> tuple[DataFrame, DataFrame]:
    """The narrow table of all documents and the preprocessed ones.

    One scan writes hashes, lengths and line hashes; the winners of both dedup
    steps are found on that table and stored by document key; a second scan joins
    the texts to them, the only exchange that carries texts."""
    if dedup_mode not in ("document", "paragraph"):
        raise ValueError("dedup_mode must be 'document' or 'paragraph'")
    narrow = materialize(dedup.narrow_documents(docs, text, order, min_length, sequence_min_len), "narrow-documents")
    if dedup_mode == "document":
        return narrow, docs.join(dedup.stored_winners(narrow, order, lines=False), order, "left_semi")
    # a document dropped by the re-check below still claims its lines,
    # so the line winners are found before the re-check
    out = dedup.apply_keep_lists(docs, dedup.stored_winners(narrow, order), text, order, sequence_min_len, "inner")
    return narrow, out.where(F.length(F.col(text)) >= min_length)


def preprocess_corpus(docs: DataFrame, text: str = "text", order: str = "doc_id",
                      min_length: int = 100, dedup_mode: str = "paragraph",
                      sequence_min_len: int = 50) -> DataFrame:
    return _preprocess(docs, text, order, min_length, dedup_mode, sequence_min_len)[1]


def preprocess_report(docs: DataFrame, text: str = "text", order: str = "doc_id",
                      min_length: int = 100, dedup_mode: str = "paragraph",
                      sequence_min_len: int = 50) -> DataFrame:
    """D4 over D3; the input side is read from the narrow table."""
    narrow, out = _preprocess(docs, text, order, min_length, dedup_mode, sequence_min_len)
    return dedup.reduction_report(narrow.select("n_chars"), out.select(F.length(text).cast("bigint").alias("n_chars")),
                                  None, min_length)
