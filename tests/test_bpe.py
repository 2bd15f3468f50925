"""Merge learning in rounds against the one-by-one algorithm."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import bpe as B


def one_by_one(words, n_merges, min_frequency=1):
    """Counts all pairs anew for every merge; ties: older pair, then symbols."""
    words, birth, merges = [(list(w), f) for w, f in words], {}, []
    while len(merges) < n_merges:
        counts = {}
        for w, f in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + f
        birth = {p: birth.get(p, len(merges)) for p in counts}
        best = min(counts, key=lambda p: (-counts[p], birth[p], p), default=None)
        if best is None or counts[best] < min_frequency:
            break
        merges.append((len(merges), *best, counts[best]))
        for k, (w, f) in enumerate(words):
            new, i = [], 0
            while i < len(w):
                both = tuple(w[i:i + 2]) == best
                new.append("".join(best) if both else w[i])
                i += 2 if both else 1
            words[k] = (new, f)
    return merges


def learnt(spark, words, n_merges, **kw):
    hist = spark.createDataFrame(words, "pretoken string, freq long")
    merges, vocab = B.bpe_train(hist, vocab_size=261 + n_merges, min_frequency=1, **kw)
    return [tuple(r) for r in merges.orderBy("rank").collect()], vocab


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("ab" if seed % 2 else "abcdef") for _ in range(rnd.randint(1, 12))): rnd.randint(1, 9) for _ in range(40)}
    got, _ = learnt(spark, list(words.items()), 60, rewrite_every=3, most_tried=7 if seed < 2 else 4000)
    assert got == one_by_one(words.items(), 60)


def test_fixture_and_vocabulary(spark):
    words = [(" aaaa", 3), (" abab", 5), ("aaa", 2), (" banana$", 4), (" \u00fcber.", 4), ("bab", 1)]
    got, vocab = learnt(spark, words, 12)
    table = dict(zip(range(256), B.byte_alphabet()))
    assert got == one_by_one([([table[b] for b in w.encode()], f) for w, f in words], 12)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert ids["<mask>"] == 4 and ids["!"] == 5 + 33 and ids[got[0][1] + got[0][2]] == 261
    none, _ = learnt(spark, [("x", 5)], 10)
    assert none == []


def test_min_frequency_and_alphabet_cap(spark):
    words = [("abc", 10), ("abd", 5), ("xyz", 1)]
    hist = spark.createDataFrame(words, "pretoken string, freq long")
    merges, _ = B.bpe_train(hist, vocab_size=400, min_frequency=2)
    assert [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()] == [("a", "b"), ("ab", "c"), ("ab", "d")]
    merges, vocab = B.bpe_train(hist, vocab_size=400, min_frequency=1, limit_alphabet=3)
    assert [r["token"] for r in vocab.orderBy("id").collect()] == B.SPECIAL_TOKENS + ["a", "b", "c", "ab", "abc"]
    assert merges.count() == 2
    with pytest.raises(ValueError):
        B.bpe_train(hist, min_frequency=0)


def test_corpus_merges_equal_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hist = B.pretoken_counts(docs).where(F.col("freq") >= 5)
    merges, _ = B.bpe_train(hist, vocab_size=261 + 250)
    table = dict(zip(range(256), B.byte_alphabet()))
    words = [([table[b] for b in r["pretoken"].encode()], r["freq"]) for r in hist.collect()]
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == one_by_one(words, 250, 2)


def test_few_rounds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hist = B.pretoken_counts(docs).where(F.col("freq") >= 3)
    rounds, store = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name: (rounds.append(name), store(df, name))[1])
    merges, _ = B.bpe_train(hist, vocab_size=261 + 600)
    assert merges.count() == 600 and rounds.count("bpe-deltas") <= 15
