"""Language-model scores from a subword lattice.

Two scores for each text, both learnt from the training documents:

* ``base_score``: smoothed unigram probability of its words and its end;
* ``score``: marginal probability over all segmentations of its words into
  pieces of an existing vocabulary.  The vocabulary's scores are the first piece
  weights; expected counts over the training words (forward-backward) renew
  them; a log-space forward recursion sums the segmentations.

Both are sums over words, so everything is computed per distinct word: one
shuffled count of words, one table of word scores.  The ``head_words`` most
frequent words (a bounded table) are broadcast and scored in place; only the
rest of the words is shuffled to meet its scores, counted per document.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import byte_list, crc_mod, read_bytes, table, tokenizer_path
from corpusflow.llm.lattice import (MARK, PieceTrie, expected_counts, log_marginals, normal_pieces, rank_weights,
                                    smoothed_weights)
from corpusflow.session import materialize

_FLOOR = -18.0                    # log weight of a character outside the vocabulary
_FLUSH = 300_000                  # words that a task counts before it passes them on
_SMOOTH = 0.1                     # fixed value of the base score


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def _count_rows(batches):
    """``(word, c)``: words of a task's texts; c counts training texts only."""
    seen: Counter = Counter()

    def rows():
        return pa.record_batch([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                               names=["word", "c"])

    for batch in batches:
        for text, train in zip(byte_list(batch.column(0)), batch.column(1).to_pylist()):
            if train:
                seen.update(words_of(text))
            else:
                for w in words_of(text):
                    seen[w] += 0
            if len(seen) > _FLUSH:
                yield rows()
                seen = Counter()
    yield rows()


def _expected_rows(model):
    def run(batches):
        trie, weights = model.value
        total = np.zeros(trie.n_pieces + 1)
        for batch in batches:
            words = [MARK + w.decode() for w in batch.column(0).to_pylist()]
            total += expected_counts(trie, weights, words, batch.column(1).to_numpy().astype(float), _FLOOR)
        at = np.flatnonzero(total > 0)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["piece", "c"])

    return run


def _word_score_rows(model):
    def run(batches):
        trie, weights = model.value
        for batch in batches:
            words = [MARK + w.decode() for w in batch.column(0).to_pylist()]
            logs = log_marginals(trie, weights[:, None], words, _FLOOR)[:, 0] / math.log(10)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(logs)], names=["word", "c", "lattice"])

    return run


def _document_rows(head, log_p, end):
    """Per document one row of sums over its end and head words (word null), and
    one row per distinct other word with its count (n_tokens)."""

    def run(batches):
        index, counts, lattice = head.value
        base = log_p(counts)
        for batch in batches:
            rid, rows, tail_at, tail_words, tail_n = batch.column(0), [], [], [], []
            for i, text in enumerate(byte_list(batch.column(1))):
                words = words_of(text)
                at = [index.get(w) for w in words]
                known = np.array([a for a in at if a is not None], np.int64)
                rows.append((len(words) + 1, int((counts[known] > 0).sum()) + end[0],
                             float(base[known].sum()) + end[1], float(lattice[known].sum()) + end[2]))
                if len(known) < len(words):
                    for w, n in Counter(w for w, a in zip(words, at) if a is None).items():
                        tail_at.append(i)
                        tail_words.append(w)
                        tail_n.append(n)
            n, k, b, s = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0),) * 4
            take = pa.array(tail_at, pa.int64())
            docs, tail = len(rows), len(tail_at)
            yield pa.record_batch(
                [pa.concat_arrays([rid, rid.take(take)]),
                 pa.concat_arrays([batch.column(2), pa.nulls(tail, pa.int64())]),
                 pa.array([None] * docs + tail_words, pa.binary()),
                 pa.array(np.r_[n, tail_n].astype(np.int64)),
                 pa.array(np.r_[k, np.zeros(tail)].astype(np.int64)),
                 pa.array(np.r_[b, np.zeros(tail)].astype(float)), pa.array(np.r_[s, np.zeros(tail)].astype(float))],
                names=["rid", "doc_id", "word", "n", "k", "base", "lattice"])

    return run


class LatticeModel:
    """What is learnt from the rows of ``docs (text, train)``."""

    def __init__(self, docs: DataFrame, model_path: str | None = None, rounds: int = 2, head_words: int = 1 << 16):
        spark = docs.sparkSession
        pieces, scores = normal_pieces(read_bytes(model_path or tokenizer_path("piece_bpe_32k.model")))
        trie, weights = PieceTrie(pieces), rank_weights(scores)
        prior = weights
        counts = materialize(docs.select("text", "train").mapInArrow(_count_rows, "word binary, c long")
                             .groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
        self.n_texts = docs.where("train").count()
        sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
        #: training tokens and distinct training tokens, ends included
        self.n_tokens = (sums[0] or 0) + self.n_texts
        self.n_distinct = (sums[1] or 0) + (self.n_texts > 0)
        total = 0.0
        for _ in range(rounds):
            model = spark.sparkContext.broadcast((trie, weights))
            got = counts.where(F.col("c") > 0).mapInArrow(_expected_rows(model), "piece long, c double") \
                .groupBy("piece").agg(F.sum("c").alias("c")).collect()      # at most one row per piece
            learnt = np.zeros(len(pieces) + 1)
            for r in got:
                learnt[r["piece"]] = r["c"]
            total = float(learnt.sum())
            weights = smoothed_weights(learnt, prior)
        # a text ends once, after all its pieces
        p_end = (self.n_texts + 1) / (self.n_texts + 1 + total + 1)
        self.log_end = math.log10(p_end)
        weights = weights + math.log1p(-p_end)
        model = spark.sparkContext.broadcast((trie, weights))
        self.words = materialize(counts.mapInArrow(_word_score_rows(model), "word binary, c long, lattice double"),
                                 "lm-word-scores")
        head = self.words.orderBy(F.desc("c"), "word").limit(head_words).toArrow()
        self.head = ({w: i for i, w in enumerate(head.column("word").to_pylist())},
                     head.column("c").to_numpy(), head.column("lattice").to_numpy())


def score_texts(docs: DataFrame, train: Column, model_path: str | None = None, rounds: int = 2,
                head_words: int = 1 << 16) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``, one row
    per row of ``docs``.

    ``train`` says which rows to learn from; all are scored.  A null text is
    empty: its only token is the end.  Rows are scored each on its own, repeated
    ones too.  Other columns are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    model = LatticeModel(rows.select("text", "train"), model_path, rounds, head_words)
    z = model.n_tokens + _SMOOTH * (model.n_distinct + 1)
    log_p = lambda c: np.log10((c + _SMOOTH) / z)
    end = (int(model.n_texts > 0), float(log_p(model.n_texts)), model.log_end)
    head = spark.sparkContext.broadcast(model.head)
    parts = materialize(
        rows.select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id").mapInArrow(
            _document_rows(head, log_p, end),
            "rid long, doc_id long, word binary, n long, k long, base double, lattice double"), "lm-parts")
    tail = parts.where(F.col("word").isNotNull()).select("rid", "word", "n") \
        .join(model.words.withColumnRenamed("lattice", "w"), "word") \
        .select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"),
                F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"),
                (F.col("n") * F.log10((F.col("c") + F.lit(_SMOOTH)) / F.lit(z))).alias("base"),
                (F.col("n") * F.col("w")).alias("lattice"))
    sums = parts.where(F.col("word").isNull()).drop("word").unionByName(tail).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("k").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("lattice").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
                       "base_score", "score")


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
