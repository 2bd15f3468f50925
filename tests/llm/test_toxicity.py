"""Toxicity: folding, matching against a plain search, learning, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from corpusflow.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("text, folded", [
    ("You IDIOT!!", "you ldlot"), ("1d10t", "ldlot"), ("idіot", "ldlot"), ("ＩＤＩＯＴ", "ldlot"),
    ("i​d­iot", "ldlot"), ("m0r0n tr@sh $cum", "moron trash scum"), ("могоn", "moгon"), ("2024 is 7th", "2024 ls tth"),
    ("", ""), (None, ""), ("été", "été"), ("!!! ... $$$", ""), ("$100", "$100")])
def test_folding(text, folded):
    assert " ".join(T.Folder().words(text)) == folded


def plain_search(folded, lexicon):
    """Every term at every place, exceptions looked up place by place."""
    found = {}
    for start in range(len(folded)):
        here = [(w, t) for t, w in lexicon.terms.items() if t not in lexicon.exceptions and folded.startswith(t, start)]
        if here and not any(folded.startswith(p, at) for p in lexicon.exceptions
                            for at in range(max(0, start - len(p) + 2), start + 1)):
            found[start] = max(here)
    return found


@pytest.mark.parametrize("seed", range(5))
def test_matches_equal_plain_search(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(30)]
    terms = {f" {w[:3]}": rnd.random() for w in words[:8]} | {f" {w} ": rnd.random() for w in words[8:14]}
    lexicon = T.Lexicon(terms, [f" {w} " for w in words[5:8]] + [f" {a} {b} " for a, b in zip(words, words[1:])])
    matcher = T.Matcher(lexicon)
    for _ in range(200):
        folded = T.joined([rnd.choice(words) for _ in range(rnd.randint(0, 12))])
        assert matcher.matches(folded) == plain_search(folded, lexicon)


def test_weaker_terms_give_way():
    terms = {" tra": (100, 8.0), " tras": (100, 8.0), " trash ": (99, 8.0), " low": (90, 6.0), " lowa": (40, 6.1), " lowb": (30, 6.5)}
    assert T._least_terms(terms) == {" trash ": 8.0, " low": 6.0, " lowb": 6.5}


def labelled(spark, n=600):
    """Toxic texts hold one of two bad words or a stem; `bad apple` and the word `stemma` are harmless."""
    rnd = random.Random(1)
    plain = ["".join(rnd.choice("lmnopqrstu") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        toxic = int(i % 3 == 0)
        at = rnd.randrange(len(words))
        if toxic:
            words[at:at] = [rnd.choice(["bad", "b4d", "vile", "stem" + rnd.choice(plain)])]
        elif i % 10 < 2:
            words[at:at] = ["bad", "apple"] if i % 10 else ["stemma"]
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learnt_terms_and_exceptions(spark):
    lexicon = T.learn(T.draw(labelled(spark), 10_000))
    assert {" bad ", " vlle "} <= set(lexicon.terms) and any(" stemlm".startswith(t) or t.startswith(" stem") for t in lexicon.terms)
    assert " bad apple " in lexicon.exceptions
    docs = spark.createDataFrame([(1, "so bad indeed"), (2, "a bad apple"), (3, "v1le"), (4, "nothing"), (5, None), (6, ""),
                                  (7, "a stemma")],
                                 "doc_id long, text string")
    got = {r.row.doc_id: r.found for r in T.score_documents(docs, lexicon).collect()}
    assert got[1].score > 0.3 and got[3].score > 0.3 and [h.term for h in got[3].hits] == ["vlle"]
    assert max(got[i].score for i in (2, 4, 5, 6, 7)) < 0.3 and not got[2].hits
    assert got[5].n_words == got[6].n_words == 0 and got[5].score == got[6].score == got[4].score


def test_length_lowers_the_score(spark):
    lexicon = T.Lexicon({" bad ": 2.0}, [], (-3.0, 0.0, 6.0))
    docs = spark.createDataFrame([(1, "bad " + "fine " * 10), (2, "bad " + "fine " * 20_000)], "doc_id long, text string")
    got = {r.row.doc_id: r.found for r in T.score_documents(docs, lexicon).collect()}
    assert got[1].score > 0.25 > got[2].score and got[2].n_words == 20_001


def test_one_class_or_no_rows(spark):
    rows = labelled(spark, 30)
    for some in (rows.limit(0), rows.where("toxic = 0"), rows.withColumn("toxic", T.F.lit(None).cast("int"))):
        lexicon = T.learn(T.draw(some, 100), base_terms={"Bad": 3.0}, base_exceptions=["not bad"])
        assert lexicon.terms == {" bad ": 3.0} and lexicon.exceptions == [" not bad "]
        scores = [r.found.score for r in T.score_documents(rows, lexicon).collect()]
        assert all(0 <= s <= 1 for s in scores)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, "bad", "x", 0.5), (1, "bad", "x", 0.5), (None, None, None, None), (2, "bad " * 100_000, "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, score double")
    got = T.score_documents(docs, T.Lexicon({" bad ": 1.0}))
    assert got.select("row.*").columns == docs.columns and got.count() == 4
    assert sorted(r.found.total for r in got.collect()) == [0.0, 1.0, 1.0, 100_000.0]
    assert T.score_documents(docs.limit(0), T.Lexicon({})).count() == 0


def test_held_out_accuracy(spark):
    name = next(n for n in E.queries() if n.startswith("op12_"))
    got = E.queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert set(got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]) == {True}
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]]
    toxic, clean = (held[held["toxic"] == c]["score"].to_numpy() for c in (1, 0))
    assert np.mean([(t > clean).mean() + (t == clean).mean() / 2 for t in toxic]) > 0.95
    assert (toxic >= 0.3).mean() > 0.9 and (clean >= 0.3).mean() < 0.01
