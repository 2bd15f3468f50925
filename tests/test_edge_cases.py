"""Inputs that the fixtures of the other tests do not hold."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.html import parse_page
from corpusflow.operators import sampling as S
from corpusflow.operators import sequences as Q
from corpusflow.operators import web as W


@pytest.mark.parametrize("html,text", [
    ("<div><header>Menu</div><p>Body text</p>", "Body text"),
    ("<div><nav><ul><li>a</div>kept", "kept"),
    ("<header>Menu<br>x</header>after", "after"),
    ("<p>a</header>b</p>", "a\nb"),
])
def test_removable_element_ends_with_its_parent(html, text):
    assert parse_page(html, "http://a/")["text"] == text


def test_bad_href_costs_only_its_link():
    got = parse_page('<a href="http://[::1">x</a><a href="/b">y</a>', "http://a.test/")
    assert got["links"] == [None, "http://a.test/b"]


def test_only_the_first_matching_robots_group_applies(spark):
    robots = spark.createDataFrame([("h", "corpus", 1, "/a/", False), ("h", "corpusbot", 2, "/b/", False),
                                    ("h", "*", 3, "/c/", False)], "host string, agent string, seq int, prefix string, allow boolean")
    urls = spark.createDataFrame([(f"http://h/{p}/1",) for p in "abc"], "url string")
    got = {r.url: r.robots_ok for r in W.robots_allowed(urls, robots, user_agent="CorpusBot").collect()}
    assert got == {"http://h/a/1": False, "http://h/b/1": True, "http://h/c/1": True}


@pytest.mark.parametrize("entry,rule", [
    ("Example.com", ("example.com", "")), (" https://a.b/ ", ("a.b", "")), ("a.b/en?q#f", ("a.b", "/en")),
    ("http://a.b:80/x;p", ("a.b:80", "/x")), ("/x", ("/x", "")),
])
def test_allow_entries(entry, rule):
    assert W.parse_allow_rules([entry]) == [rule]


def test_blank_documents_add_no_tokens(spark):
    df = spark.createDataFrame([(1, "a", [2, 9, 3]), (2, "", [2, 3]), (3, " \n", [2, 5, 3]), (4, "b", [2, 8, 3])],
                               "doc_id long, text string, ids array<int>")
    got = [r.token_id for r in Q.flat_token_stream(df).orderBy("g").collect()]
    assert got == [2, 9, 3, 2, 8, 3]


def test_splits_of_repeated_ids_have_exact_sizes(spark):
    df = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("n"))
    df = df.union(spark.range(100).select(F.lit(None).cast("long"), F.col("id") + 50_000))
    assert S.sample_n(df, 10, id_col="doc_id").count() == 10
    got = {r["split"]: r["count"] for r in S.split3(df).groupBy("split").count().collect()}
    assert got == {"train": 40_080, "validation": 5_010, "test": 5_010}


def test_split_counts_truth_table():
    for n in range(3, 40):
        for ratios in ((.8, .1, .1), (.98, .01, .01), (.01, .98, .01), (.4, .3, .3)):
            try:
                a, b, c = S.split3_counts(n, ratios)
            except ValueError:
                continue
            assert a + b + c == n and min(a, b, c) >= 1
            assert a in (max(1, int(n * ratios[0])), max(1, int(n * ratios[0])) - 1)
