"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: compatibility forms and look-alike letters of other
scripts become Latin ones, invisible characters and stray accents go, digits and
signs that stand for letters inside a word become those letters, and ``i``, ``l``
and their substitutes become one (so both readings of ``1`` meet).  A folded
text is its words between single spaces; a term is a space and a word beginning
(a stem), or a whole word between spaces.

The lexicon is learnt from labelled documents: stems and words that toxic
documents hold far oftener (a likelihood ratio test on document counts) and in
as many different contexts as documents, which words of one often copied text
lack, weighted by the log ratio of their rates.  Exception phrases are longer phrases (a whole
word, or two words) that hold a term but are no more common in toxic documents;
a match inside one does not count.  One automaton finds all terms and exceptions
in one pass over a text.  The sum of the weights found, once as it is and once
normalised by the length of the text, gives the score through a logistic fit.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import crc_mod, table, text_key
from corpusflow.session import materialize

_STEM = range(3, 9)               # lengths of stems
_LONGEST = 40                     # words beyond are no lexicon words
_PER_DOC = 8                      # occurrences of a term that count for its weight, per document
_CONTEXTS = 60                    # bits of a term's sketch of neighbouring words
_CACHE_WORDS = 200_000
_FLUSH = 200_000

# fixed values: letters of other scripts that look like Latin ones
_LOOK_ALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ſ": "s", "ʏ": "y",
})
# fixed values: digits and signs written for letters
_FOR_LETTERS = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                              "@": "a", "$": "s", "!": "l", "|": "l", "i": "l"})
_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!|]+[^\W_]+)*")
_UNSEEN = re.compile("[­̀-ͯ​-‏⁠﻿]+")


def _skeleton(word: str) -> str:
    if not word.isascii():
        word = "".join(unicodedata.normalize("NFKC", word).lower().translate(_LOOK_ALIKES).split())
    if any(c.isalpha() for c in word):
        return word.translate(_FOR_LETTERS)
    return word


class Folder:
    """Folds texts; keeps the folded forms of recent words (a bounded cache)."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.lower()
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = _UNSEEN.sub("", text)
        cut = _WORD.findall(text)
        new = set(cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > _CACHE_WORDS:
                new, self.known = set(cut), {}
            self.known.update((w, _skeleton(w)) for w in new)
        return list(map(self.known.__getitem__, cut))


def joined(words: list[str]) -> str:
    return f" {' '.join(words)} " if words else ""


@dataclass
class Lexicon:
    """``terms`` (folded; value: weight), ``exceptions`` (folded phrases with a
    space at both ends) and the ``fit``: a constant and the factors of the sum of
    weights (as log1p) and of that sum by the root of the length."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    fit: tuple[float, float, float] = (-3.0, 2.0, 0.0)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        self.fit = lexicon.fit
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight, term))
        for phrase in lexicon.exceptions:                   # the same string as a term: the exception wins
            self.automaton.add_word(phrase, (len(phrase), None, phrase))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[float, str]]:
        """The heaviest term at each place, places inside an exception phrase left out."""
        found: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        if folded and len(self.automaton):
            for end, (size, weight, term) in self.automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    excused.append((start, end))
                elif start not in found or (weight, term) > found[start]:
                    found[start] = (weight, term)
        if excused and found:
            covered = {s for a, b in excused for s in range(a, b) if s in found}
            found = {s: hit for s, hit in found.items() if s not in covered}
        return found

    def score(self, total: float, n_words: int) -> float:
        x = float(np.dot(self.fit, _features(np.array([total]), np.array([n_words]))[0]))
        return 1.0 / (1.0 + float(np.exp(-x))) if x > -700 else 0.0


def _features(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), total / np.sqrt(n_words + 20.0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton's method (the constant goes free)."""
    beta, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def _with_places(words: list[str], toxic: int) -> dict[str, tuple[int, int]]:
    """Each word's number and, for toxic texts, a bit for the neighbours of its first places."""
    if not toxic:
        return {w: (n, 0) for w, n in Counter(words).items()}
    seen: dict[str, tuple[int, int]] = {}
    around = ["", *words, ""]
    for i, w in enumerate(words):
        n, bits = seen.get(w, (0, 0))
        if n < 2:
            bits |= 1 << zlib.crc32(f"{around[i]} {around[i + 2]}".encode()) % _CONTEXTS
        seen[w] = n + 1, bits
    return seen


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term the toxic and other documents that hold it, its places there and
    its contexts, pre-aggregated in the task."""
    folder, counts = Folder(), {}

    def rows():
        c = np.array(list(counts.values()), np.int64).reshape(-1, 5)
        return pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array(c[:, i]) for i in range(5))],
                               names=["term", "pos", "neg", "pos_places", "neg_places", "contexts"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            mine: dict[str, tuple[int, int]] = {}
            for word, (n, bits) in _with_places(folder.words(text.as_py()), toxic).items():
                if len(word) <= _LONGEST:
                    for term in [f" {word} ", *(" " + word[:k] for k in _STEM if k < len(word))]:
                        m, old = mine.get(term, (0, 0))
                        mine[term] = m + n, old | bits
            for term, (n, bits) in mine.items():
                c = counts.setdefault(term, [0, 0, 0, 0, 0])
                c[1 - toxic] += 1
                c[3 - toxic] += min(n, _PER_DOC)
                c[4] |= bits
            if len(counts) >= _FLUSH:
                yield rows()
                counts = {}
    yield rows()


def _phrase_rows(lexicon):
    """``(phrase, docs)`` of toxic and other documents for the phrases around each match."""
    def run(batches):
        folder, matcher, counts = Folder(), Matcher(lexicon.value), {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                folded = joined(folder.words(text.as_py()))
                mine = set()
                for start in matcher.matches(folded):
                    end = folded.index(" ", start + 1)
                    mine.add(folded[start:end + 1])
                    if start:
                        mine.add(folded[folded.rindex(" ", 0, start):end + 1])
                    if end + 1 < len(folded):
                        mine.add(folded[start:folded.index(" ", end + 1) + 1])
                for phrase in mine:
                    if len(phrase) <= 2 * _LONGEST + 3:
                        counts.setdefault(phrase, [0, 0])[1 - toxic] += 1
            if len(counts) >= _FLUSH:
                yield _phrase_batch(counts)
                counts = {}
        yield _phrase_batch(counts)

    return run


def _phrase_batch(counts: dict) -> pa.RecordBatch:
    c = np.array(list(counts.values()), np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(c[:, 0]), pa.array(c[:, 1])],
                           names=["phrase", "pos", "neg"])


def draw(rows: DataFrame, max_docs: int) -> DataFrame:
    """Rows ``doc_id, toxic, ...`` drawn by a hash of the id so that each class has
    ``max_docs`` rows on average (all, if there are fewer), with a ``weight`` that
    makes up for it.  Null labels are left out; any label but 0 is toxic."""
    rows = rows.where(F.col("toxic").isNotNull()).withColumn("toxic", (F.col("toxic") != 0).cast("int"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = (min(1.0, max_docs / max(1, sizes.get(c, 0))) for c in (0, 1))
    share = F.when(F.col("toxic") == 1, F.lit(toxic)).otherwise(F.lit(clean))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("weight", 1.0 / share)


def _distinct_texts(drawn: DataFrame) -> DataFrame:
    """Copies count once, as toxic if any of them is; null texts are left out."""
    text = F.col("text").cast("string")
    return drawn.where(text.isNotNull()).groupBy(text_key(text).alias("key"), F.octet_length(text).alias("size")) \
        .agg(F.max("toxic").alias("toxic"), F.min(text).alias("text"), F.max("weight").alias("weight")) \
        .select("toxic", "text", "weight")


def _log_ratio(pos: Column, n_pos: float, neg: Column, n_neg: float) -> Column:
    return F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))


def _evidence(pos: Column, n_pos: int, neg: Column, n_neg: int) -> Column:
    """Likelihood ratio statistic of a term's document counts in two classes."""
    total, n = pos + neg, float(n_pos + n_neg)
    expected = [total * n_pos / n, total * n_neg / n]
    return 2 * sum(F.when(c > 0, c * F.log(c / e)).otherwise(0.0) for c, e in zip((pos, neg), expected))


def _least_terms(terms: dict[str, tuple[int, float]], same: float = 0.95, gain: float = 0.3) -> dict[str, float]:
    """The weights of ``term -> (toxic documents, weight)`` without terms that others
    say better: stems that a longer term replaces in nearly all their documents, then
    terms that weigh little more than a kept stem they begin with."""
    def stems(term: str) -> list[str]:
        return [term[:k] for k in range(_STEM[0] + 1, len(term)) if term[:k] in terms]

    replaced = {s for t, (n, w) in terms.items() for s in stems(t) if n >= same * terms[s][0] and w >= terms[s][1] - 0.1}
    kept: dict[str, float] = {}
    for term in sorted(terms.keys() - replaced, key=lambda t: (len(t), t)):
        if terms[term][1] > max((kept[s] for s in stems(term) if s in kept), default=-1e9) + gain:
            kept[term] = terms[term][1]
    return kept


def learn(drawn: DataFrame, base_terms: dict[str, float] | None = None, base_exceptions: list[str] | None = None,
          max_terms: int = 4_000, least_evidence: float = 24.0, least_ratio: float = 1.1) -> Lexicon:
    """A lexicon from labelled rows ``doc_id, text, toxic, weight`` (see :func:`draw`).

    ``draw`` bounds the rows and ``max_terms`` the terms and the exceptions, so that
    neither the broadcast nor what reaches the driver (terms, and four numbers for
    each drawn text) grows with the corpus.  ``base_terms`` and ``base_exceptions``
    are the caller's own words and phrases.  Without rows of both classes nothing
    is learnt: a text without a base term then gets the share of toxic rows.
    """
    spark = drawn.sparkSession
    sample = materialize(_distinct_texts(drawn), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    folder = Folder()
    lexicon = Lexicon({f" {' '.join(folder.words(t))} ": w for t, w in (base_terms or {}).items()},
                      [joined(folder.words(p)) for p in base_exceptions or []])
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1.0) if n_pos + n_neg else 0.05
        lexicon.fit = (float(np.log(share / (1 - share))), 2.0, 0.0)
        return lexicon
    pos, neg = F.col("pos"), F.col("neg")
    terms = sample.select("toxic", "text").mapInArrow(
        _term_rows, "term string, pos long, neg long, pos_places long, neg_places long, contexts long") \
        .groupBy("term").agg(F.bit_count(F.bit_or("contexts")).alias("contexts"),
                             *(F.sum(c).alias(c) for c in ("pos", "neg", "pos_places", "neg_places"))) \
        .where((pos >= 3) & (F.col("contexts") >= 0.5 * _CONTEXTS * (1 - F.pow(F.lit(1 - 1 / _CONTEXTS), pos)))) \
        .withColumn("evidence", _evidence(pos, n_pos, neg, n_neg)) \
        .withColumn("ratio", _log_ratio(pos, n_pos, neg, n_neg)) \
        .where((F.col("evidence") >= least_evidence) & (F.col("ratio") >= least_ratio)) \
        .withColumn("weight", _log_ratio(F.col("pos_places"), n_pos, F.col("neg_places"), n_neg)) \
        .orderBy(F.desc("evidence"), "term").limit(max_terms).collect()
    lexicon.terms = _least_terms({r["term"]: (r["pos"], r["weight"]) for r in terms}) | lexicon.terms
    held = spark.sparkContext.broadcast(lexicon)
    lexicon.exceptions += [r["phrase"] for r in sample.select("toxic", "text").mapInArrow(
        _phrase_rows(held), "phrase string, pos long, neg long").groupBy("phrase")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((neg >= 5) & (_log_ratio(pos, n_pos, neg, n_neg) <= 0))
        .orderBy(F.desc("neg"), "phrase").limit(max_terms).collect()]
    seen = sample.select("toxic", "weight", scorer(spark, lexicon)("text").alias("found")) \
        .select("toxic", "weight", "found.total", "found.n_words").toPandas()
    lexicon.fit = _logistic(_features(seen["total"].to_numpy(), seen["n_words"].to_numpy()),
                            seen["toxic"].to_numpy().astype(float), seen["weight"].to_numpy())
    return lexicon


_HIT = pa.struct([("term", pa.string()), ("n", pa.int64()), ("weight", pa.float64())])
_FOUND = pa.struct([("score", pa.float64()), ("total", pa.float64()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT))])
_FOUND_DDL = "struct<score: double, total: double, n_words: long, hits: array<struct<term: string, n: long, weight: double>>>"


def scorer(spark, lexicon: Lexicon):
    """A column function text -> ``(score, total, n_words, hits)``; ``hits`` are the
    terms that counted, sorted, with their number and weight."""
    held = spark.sparkContext.broadcast(lexicon)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        folder, matcher = Folder(), Matcher(held.value)
        for column in texts:
            out = []
            for text in column:                               # one text in work at a time
                words = folder.words(text.as_py())
                found = matcher.matches(joined(words))
                total = float(sum(sorted(w for w, _ in found.values())))
                hits = Counter((term, weight) for weight, term in found.values())
                out.append({"score": matcher.score(total, len(words)), "total": total, "n_words": len(words),
                            "hits": [{"term": t.strip(), "n": n, "weight": w} for (t, w), n in sorted(hits.items())]})
            yield pa.array(out, _FOUND)

    return F.arrow_udf(judge, _FOUND_DDL)


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(row, found)``: every row of ``docs`` as a struct (so that no column name
    can clash) and ``found = (score, total, n_words, hits)``.  A null or empty text
    has no words and the score of a text without matches; repeated rows get the
    same score; an empty table gives an empty one."""
    return docs.select(F.struct("*").alias("row"),
                       scorer(docs.sparkSession, lexicon)(F.col("text").cast("string")).alias("found"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def learn_from_labels(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000) -> Lexicon:
    """Learns from the ``labels (doc_id, toxic)`` of documents that are not held
    out (null ids and labels are left out; of several labels of a document the
    largest counts).  The ids drawn, ``2 * max_docs`` on average, are broadcast to
    the documents, whose texts are not shuffled for it."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    return learn(docs.select("doc_id", "text").join(F.broadcast(draw(marks, max_docs)), "doc_id"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, learn_from_labels(docs, table(spark, sf_dir, "labels")))
    doc_id, score = F.col("row.doc_id"), F.col("found.score")
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score.alias("score"),
                      (score >= 0.3).cast("int").alias("predicted"))
