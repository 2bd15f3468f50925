"""Language identification with segmentation-marginalised unigrams.

For each language a unigram model over the pieces of a fixed public vocabulary
is learnt: expected piece counts over all segmentations of its training words
(forward-backward, two rounds).  A text's score under a language is the sum of
its words' marginal log probabilities, each summed over all segmentations by
the forward algorithm; the best language wins.  Learning reads text and lang
of the training rows only; a prediction reads text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import LETTER_BYTES, crc_mod, give_back, read_bytes, table, text_slices, tokenizer_path
from corpusflow.llm.lattice import (MARK, PieceTrie, expected_counts, log_marginals, normal_pieces, rank_weights,
                                    smoothed_weights)
from corpusflow.session import materialize

UNKNOWN = "und"
_FLOOR = -18.0                    # log weight of a character outside the vocabulary
_CACHE_WORDS = 200_000            # words whose scores a task keeps
_FLUSH = 100_000                  # words that a task holds before it passes them on
_SLICE_BYTES = 1 << 20            # text in work at a time


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(LETTER_BYTES).split() if text else []


def has_letter(word: bytes) -> bool:
    """ASCII words are letters only; others need one alphabetic character."""
    return word.isascii() or any(c.isalpha() for c in word.decode())


def _marked(word: bytes) -> str:
    return MARK + word.decode().lower()


def _word_rows(batches):
    """Word counts per language, pre-aggregated in the task."""
    counts: dict = {}

    def rows():
        keys = list(counts)
        return pa.record_batch([pa.array([k[0] for k in keys], pa.string()),
                                pa.array([k[1].decode() for k in keys], pa.string()),
                                pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in text_slices(batch.column(1)):
            for lang, text in zip(langs[first:], texts):
                for w in words_of(text):
                    key = (lang, w)
                    counts[key] = counts.get(key, 0) + 1
                if len(counts) > _FLUSH:
                    yield rows()
                    counts = {}
    yield rows()
    give_back()


def training_words(train: DataFrame, max_docs: int) -> DataFrame:
    """``(lang, word, n)`` over the training sample: per language a share of
    the rows, drawn by a hash of id and text, that is ``max_docs`` rows on
    average (all rows, if there are fewer)."""
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()                    # one row per language
    if not sizes:
        return rows.select("lang", F.col("text").alias("word"), F.lit(0).cast("long").alias("n"))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < 
        F.element_at(share, F.col("lang")) * (1 << 20))
    return drawn.select("lang", "text").mapInArrow(_word_rows, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_pieces(model):
    def run(batches):
        trie, weights = model.value
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words = [MARK + w.lower() for w in batch.column(1).to_pylist()]
            n = batch.column(2).to_numpy().astype(float)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                w = weights[lang] if lang in weights else weights[None]
                got = expected_counts(trie, w, [words[i] for i in at], n[at], _FLOOR)
                total[lang] = total.get(lang, 0) + got
        for lang, c in total.items():
            at = np.flatnonzero(c[:-1] > 0)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                   pa.array(c[at], pa.float64())], names=["lang", "piece", "c"])

    return run


class LanguageModel:
    """Languages (sorted) and their piece log weights, one column each."""

    def __init__(self, trie: PieceTrie, langs: list[str], weights: np.ndarray):
        self.trie, self.langs, self.weights = trie, langs, weights

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        return log_marginals(self.trie, self.weights, [_marked(w) for w in words], _FLOOR, scaled=True)


def train(train_rows: DataFrame, model_path: str | None = None, max_docs: int = 4000, rounds: int = 2) -> LanguageModel:
    """Learns from rows ``doc_id, text, lang`` (null text or lang: ignored).
    ``max_docs`` bounds the sample per language (see ``training_words``); what
    reaches the driver is the piece table, one number per language and piece."""
    pieces, scores = normal_pieces(read_bytes(model_path or tokenizer_path("piece_bpe_32k.model")))
    trie, prior = PieceTrie(pieces), rank_weights(scores)
    spark = train_rows.sparkSession
    words = materialize(training_words(train_rows, max_docs), "langid-words")
    weights: dict = {None: prior}
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((trie, weights))
        rows = words.repartition(F.xxhash64("word") % 64).mapInArrow(
            _count_pieces(model), "lang string, piece long, c double") \
            .groupBy("lang", "piece").agg(F.sum("c").alias("c")).collect()
        counts: dict = {}
        for r in rows:
            counts.setdefault(r["lang"], np.zeros(len(pieces)))[r["piece"]] = r["c"]
        weights = {None: prior} | {lang: smoothed_weights(c, prior) for lang, c in counts.items()}
        model.unpersist()
    langs = sorted(x for x in weights if x is not None)
    matrix = np.stack([weights[x] for x in langs], axis=1) if langs else np.zeros((len(pieces), 0))
    return LanguageModel(trie, langs, matrix)


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class _Scorer:
    """Scores texts; keeps the scores of recent words (a bounded cache)."""

    def __init__(self, model: LanguageModel):
        self.model, self.index = model, {}
        self.scores = np.zeros((0, len(model.langs)))       # grows by half, rows beyond len(index) are free

    def score(self, texts: list) -> list[tuple[str, float]]:
        docs = [words_of(t) for t in texts]
        wanted = set().union(*docs) if docs else set()
        new = [w for w in wanted if w not in self.index]
        if len(self.index) + len(new) > _CACHE_WORDS:
            new, self.index = list(wanted), {}
        if new:
            at, end = len(self.index), len(self.index) + len(new)
            self.index.update(zip(new, range(at, end)))
            if end > len(self.scores):
                more = np.zeros((end - len(self.scores) + end // 2, self.scores.shape[1]))
                self.scores = np.concatenate([self.scores, more])
            self.scores[at:end] = self.model.word_scores(new)
        out = []
        for words in docs:
            if not self.model.langs or not any(map(has_letter, words)):
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            total = self.scores[rows].sum(axis=0)
            best = int(total.argmax())
            # words are far from independent: their evidence counts by the root of their number
            share = np.exp((total - total[best]) / np.sqrt(len(words)))
            out.append((self.model.langs[best], float(1.0 / share.sum())))
        return out


def predictor(spark, model: LanguageModel):
    """A column function text -> (lang_pred, score).  ``und`` with score 0 for a
    null text, a text without any letter, or a model that learnt no language.
    Ties go to the language that sorts first."""
    held = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(held.value)
        for column in batches:
            got = [x for _, part in text_slices(column, _SLICE_BYTES) for x in scorer.score(part)]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=["lang_pred", "score"])
        del scorer
        give_back()

    return F.arrow_udf(predict, _RESULT)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(row, found)``: each row of ``docs`` as a struct, so that no column
    name can clash, and ``found = (lang_pred, score)``."""
    return docs.select(F.struct("*").alias("row"),
                       predictor(docs.sparkSession, model)(F.col("text").cast("string")).alias("found"))


def train_on_documents(docs: DataFrame) -> LanguageModel:
    """Learns from every row of ``docs`` that is not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_on_documents(docs))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "found.lang_pred", "found.score")
