"""Vocabularies and encoding.

First-seen ids: each document contributes its distinct tokens in
first-occurrence order (``array_distinct`` keeps that order), the corpus-wide
first occurrence of every token wins (a partial minimum per task), and
the winners are numbered by their ``(order, k)`` key with the two-level global
position.  Encoding words joins token rows to the vocabulary; AQE picks broadcast
or a shuffle join from the vocabulary's measured size (see :func:`_vocab_side`).
A character vocabulary is bounded by Unicode and is looked up in place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import char_tokens, py_strip, word_tokens
from corpusflow.operators.keys import global_position, with_quantile_bucket
from corpusflow.session import materialize as materialize_df

# Reserved tokens and their ids.
WORD_SPECIALS = ["<PAD>", "<UNK>"]                   # ids 0, 1
CHAR_SPECIALS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]  # ids 0..3
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
_MAX_CHARS = 0x110000 + len(CHAR_SPECIALS)
_NOTHING, _OTHER = 0x110000, 0x110001                # no code points: ids that add nothing, or are looked up one by one
_SLICE = 1 << 20                                     # characters or ids of an Arrow batch that are worked on at a time


def _first_seen_vocab(docs: DataFrame, tokens, order: str, specials: list[str],
                      materialize: bool = True) -> DataFrame:
    """The winners (one row per distinct token) are checkpointed to the shared
    checkpoint folder before they are numbered: they feed both the bucket
    offsets and the local ranks, and the vocabulary is an artifact that every
    later encode joins against, so it is computed exactly once."""
    spark = docs.sparkSession
    per_doc = docs.select(order, F.posexplode(F.array_distinct(tokens)).alias("_k", "token"))
    # two primitive buffers: a hash aggregate with partial results, no sort by token
    first = per_doc.groupBy("token").agg(F.min_by("_k", order).alias("_k"), F.min(order).alias(order))
    # bucket boundaries from the input's key, not from the derived rows
    first = with_quantile_bucket(first, order, "_bkt0", source=docs)
    if materialize:
        first = materialize_df(first, "vocab-first")
    ranked = global_position(first, [F.col(order), F.col("_k")], F.col("_bkt0"), "_idx")
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id bigint")
    vocab = sp.unionByName(ranked.select("token", (F.col("_idx") + len(specials)).alias("id")))
    return materialize_df(vocab, "vocab") if materialize else vocab


def build_word_vocab(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``(token, id)``; ``<PAD>`` 0, ``<UNK>`` 1, words from 2 in
    first-seen order of ``text.lower().split()``.  Text ``<PAD>`` is
    lowercased to ``<pad>`` and gets its own id."""
    return _first_seen_vocab(docs, word_tokens(F.col(text)), order, WORD_SPECIALS)


def build_char_vocab(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Four specials 0..3, then code points (case kept) in first-seen order."""
    return _first_seen_vocab(docs, char_tokens(F.col(text)), order, CHAR_SPECIALS)


def _vocab_side(vocab: DataFrame) -> DataFrame:
    """The vocabulary side of a lookup join.  No broadcast hint: the
    vocabulary grows with the corpus, so the strategy is chosen by AQE from
    the vocabulary's measured size at run time (broadcast below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``, a shuffle join with
    skew splitting for hot tokens above it)."""
    return vocab


def lookup_ids(token_rows: DataFrame, vocab: DataFrame, token: str = "token", out: str = "id",
               default: int = UNK_ID) -> DataFrame:
    """``dict.get(token, <UNK>)`` as a left equi-join."""
    v = _vocab_side(vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_vid")))
    return (token_rows.join(v, token_rows[token] == v["_tok"], "left")
            .withColumn(out, F.coalesce(F.col("_vid"), F.lit(default)).cast("bigint"))
            .drop("_tok", "_vid"))


def _with_blank(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, with ``blank``: nothing but white space in it
    (such a document is encoded, but adds nothing to a token stream)."""
    keep = [c for c in docs.columns if c not in (text, "blank")]
    return docs.select(*keep, (py_strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank"))


def _encode(docs: DataFrame, text: str, vocab: DataFrame, order: str, max_len: int | None) -> DataFrame:
    """Word ids per document.  Only the first ``max_len`` words are exploded; the
    ids come back as one array per document and task (partial ``collect_list``),
    so a broadcast vocabulary leaves no exchange with a row per word."""
    tokens = word_tokens(F.col(text))
    if max_len is not None:
        tokens = F.slice(tokens, 1, max_len)
    ids = lookup_ids(docs.select(order, F.posexplode(tokens).alias("_pos", "_tok")), vocab, "_tok", "_id")
    per_doc = ids.groupBy(order).agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_p"))
    enc = _with_blank(docs, text).join(per_doc, order, "left")
    return enc.withColumn("ids", F.coalesce(F.col("_p._id"),
                                            F.array().cast("array<bigint>"))).drop("_p")


def encode_fixed(docs: DataFrame, vocab: DataFrame, max_len: int = 64, text: str = "text",
                 order: str = "doc_id") -> DataFrame:
    """word ids truncated to ``max_len`` and right-padded with 0."""
    enc = _encode(docs, text, vocab, order, max_len)
    pad = F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_len) - F.size("ids"))
    return enc.withColumn("ids", F.concat("ids", pad))


def encode_truncated(docs: DataFrame, vocab: DataFrame, max_length: int = 512, text: str = "text",
                     order: str = "doc_id", label: str | None = "label") -> DataFrame:
    """Ids truncated at ``max_length``, no padding, attention mask of ones;
    the label is carried along."""
    enc = _encode(docs, text, vocab, order, max_length)
    return enc.withColumn("attention_mask", F.transform("ids", lambda x: F.lit(1)))


def _char_table(vocab: DataFrame) -> list:
    """The vocabulary as rows on the driver: at most one per Unicode code point
    (0x110000) and special token, whatever the corpus; more is refused."""
    rows = vocab.select("token", "id").where((F.char_length("token") == 1) | F.col("token").isin(CHAR_SPECIALS)) \
        .limit(_MAX_CHARS + 1).collect()
    if len(rows) > _MAX_CHARS:
        raise ValueError(f"a character vocabulary has at most {_MAX_CHARS} entries")
    return rows


def encode_chars(docs: DataFrame, vocab: DataFrame, text: str = "text", order: str = "doc_id",
                 add_special_tokens: bool = False) -> DataFrame:
    """code-point ids, optionally wrapped in BOS / EOS; no truncation.  The
    vocabulary is broadcast as one array indexed by code point and looked up in
    place: no exchange, no row per character.  A null text has no characters."""
    rows = _char_table(vocab)
    table = np.full(0x110000, UNK_ID, np.int32)
    for r in rows:
        if len(r["token"]) == 1:
            table[ord(r["token"])] = r["id"]
    held = docs.sparkSession.sparkContext.broadcast(table)
    wrap = 1 if add_special_tokens else 0

    @F.arrow_udf("array<bigint>")
    def ids(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * wrap
        ends = np.r_[0, np.cumsum(sizes)]
        flat = np.empty(int(ends[-1]), np.int64)
        at = 0
        while at < len(texts):                        # a bounded number of characters at a time, a row at least
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, "right")) - 1)
            chars = np.frombuffer("".join(t or "" for t in texts.slice(at, end - at).to_pylist()).encode("utf-32-le"), "<u4")
            part = flat[ends[at]:ends[end]]
            inner = np.ones(len(part), bool)
            if wrap:
                first, last = ends[at:end] - ends[at], ends[at + 1:end + 1] - ends[at] - 1
                inner[first] = inner[last] = False
                part[first], part[last] = BOS_ID, EOS_ID
            part[inner] = held.value[chars]
            at = end
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return _with_blank(docs.withColumn("ids", ids(F.col(text))), text)


def decode_chars(encoded: DataFrame, vocab: DataFrame, ids: str = "ids", order: str = "doc_id",
                 skip_special_tokens: bool = True) -> DataFrame:
    """ids -> text; specials skipped (or kept); an unknown id decodes to
    the literal ``<UNK>``.  In place, as :func:`encode_chars`."""
    tokens = {r["id"]: r["token"] for r in _char_table(vocab)}
    if skip_special_tokens:
        tokens.update(dict.fromkeys((PAD_ID, UNK_ID, BOS_ID, EOS_ID), ""))
    table = np.full(max(tokens, default=0) + 1, _OTHER, np.uint32)       # code point by id
    for i, t in tokens.items():
        if i >= 0 and len(t) < 2:
            table[i] = ord(t) if t else _NOTHING
    held = encoded.sparkSession.sparkContext.broadcast((tokens, table))

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        known, table = held.value
        ends = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int32)
        values, there = column.values, column.is_valid().to_numpy(zero_copy_only=False)
        parts, at = [], 0
        while at < len(column):                       # a bounded number of ids at a time, a row at least
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, "right")) - 1)
            part = values.slice(ends[at], ends[end] - ends[at])
            ids = pc.fill_null(part, -1).to_numpy(zero_copy_only=False)
            inside = (ids >= 0) & (ids < len(table))
            chars = np.where(inside, table[np.where(inside, ids, 0)], np.uint32(_OTHER))
            rows = []
            for i in range(at, end):
                lo, hi = ends[i] - ends[at], ends[i + 1] - ends[at]
                c = chars[lo:hi]
                if not there[i]:
                    rows.append("")
                elif (c == _OTHER).any():
                    rows.append("".join(known.get(x, "<UNK>") for x in ids[lo:hi].tolist()))
                else:
                    rows.append(c[c != _NOTHING].astype("<u4").tobytes().decode("utf-32-le"))
            parts.append(pa.array(rows, pa.string()))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return encoded.select(order, text(F.col(ids)).alias("text"))


def save_vocab(vocab: DataFrame, path: str, max_len: int | None = None) -> None:
    """I8: the vocabulary as a parquet table (``max_len`` kept as a column)."""
    out = vocab if max_len is None else vocab.withColumn("max_len", F.lit(max_len))
    out.write.mode("overwrite").parquet(path)


def load_vocab(spark, path: str) -> DataFrame:
    """I8: read a saved vocabulary back as ``(token, id[, max_len])``."""
    return spark.read.parquet(path)
