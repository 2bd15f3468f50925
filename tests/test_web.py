from pyspark.sql import functions as F

from corpusflow.functions.html import parse_page
from corpusflow.functions.urls import normalize_url
from corpusflow.operators import web as W


def test_normalize_url_fixture(spark):
    cases = {"HTTP://Ex.com": "http://ex.com/", "example.com/x": "https://example.com/x",
             "http://a/b;c?d#e": "http://a/b?d", "http://A:80/p?": "http://a:80/p"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r[0]: r[1] for r in df.select("u", normalize_url("u")).collect()}
    assert got == cases


def test_parse_page():
    html = ("<html><head><title> T &amp; x </title><style>p{}</style></head><body><nav><a href='/n'>N</a></nav>"
            "<p>Hello <b>big</b> world</p><!-- c --><script>var a='</p>';</script><a href=\"p2\">l</a></body></html>")
    p = parse_page(html, "http://a.test/dir/x")
    assert p["title"] == "T & x"
    assert p["text"] == "T & x\nHello\nbig\nworld\nl"
    assert p["links"] == ["http://a.test/n", "http://a.test/dir/p2"]


def test_allow_rules(spark):
    rules = W.rules_frame(spark, W.parse_allow_rules(["a.test", "b.test/en"]))
    urls = ["http://a.test/x", "http://sub.a.test/", "http://xa.test/", "http://b.test/english", "http://b.test/fr"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(r[0] for r in W.allowed_urls(df, rules).collect()) == \
        ["http://a.test/x", "http://b.test/english", "http://sub.a.test/"]


def _page(text_words, links):
    body = "".join(f"<a href='{h}'>x</a>" for h in links)
    return f"<html><body><p>{text_words}</p>{body}</body></html>"


def test_crawl_edge_table(spark):
    long1, long2, long3 = "alpha " * 10, "beta " * 10, "gamma " * 10
    pages = [("http://a.test/", _page(long1, ["/p1#x", "http://b.test/q", "/short", "/dup"])),
             ("http://a.test/p1", _page(long2, ["p2", "/"])),
             ("http://a.test/p2", _page(long3, ["/p3"])),
             ("http://a.test/p3", _page("delta " * 10, [])),
             ("http://a.test/short", _page("tiny", ["/never"])),
             ("http://a.test/never", _page("omega " * 10, [])),
             ("http://a.test/dup", _page(long2, ["p2", "/"])),
             ("http://b.test/q", _page("zeta " * 10, []))]
    df = spark.createDataFrame(pages, "url string, html string")
    rules = W.rules_frame(spark, W.parse_allow_rules(["a.test"]))
    seeds = spark.createDataFrame([("http://a.test/",)], "url string")
    out = {r["url"]: r["depth"] for r in W.crawl_bfs(df, seeds, rules, max_depth=2, min_text_length=20,
                                                     max_pages=None).collect()}
    # /p1 and /dup share a text: /p1 stands first in the queue, p2 is reached through it
    assert out == {"http://a.test/": 0, "http://a.test/p1": 1, "http://a.test/p2": 2}
    df2 = df.where(F.col("url") != "http://a.test/p1")
    out2 = {r["url"]: r["depth"] for r in W.crawl_bfs(df2, seeds, rules, max_depth=2, min_text_length=20,
                                                      max_pages=None).collect()}
    assert out2 == {"http://a.test/": 0, "http://a.test/dup": 1, "http://a.test/p2": 2}


def _queue_crawl(pages, seeds, max_depth, min_chars, max_pages):
    """The crawl as a loop over a queue."""
    import hashlib
    from collections import deque
    queue, known, hashes, out = deque((u, 0) for u in sorted(seeds)), set(seeds), set(), []
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        if url not in pages:
            continue
        page = parse_page(pages[url], url)
        h = hashlib.md5(page["text"].encode()).hexdigest()
        if len(page["text"]) < min_chars or h in hashes:
            continue
        hashes.add(h)
        out.append((url, depth))
        for link in page["links"] if depth < max_depth else []:
            if link not in known:
                known.add(link)
                queue.append((link, depth + 1))
    return out


def test_crawl_takes_pages_first_in_first_out(spark):
    """Random link graphs with shared texts, cycles and a page cap."""
    import random
    rnd = random.Random(3)
    names = [f"http://a.test/{rnd.randrange(10 ** 6)}" for _ in range(60)]
    pages = {u: _page(f"text {i % 23} " + "word " * 6, rnd.sample(names, rnd.randint(0, 6))) for i, u in enumerate(names)}
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    rules = W.rules_frame(spark, W.parse_allow_rules(["a.test"]))
    seeds = spark.createDataFrame([(u,) for u in names[:3]], "url string")
    for cap in (10 ** 6, 17):
        got = {r["url"]: r["depth"] for r in W.crawl_bfs(df, seeds, rules, max_depth=4, min_text_length=5, max_pages=cap).collect()}
        assert got == dict(_queue_crawl(pages, names[:3], 4, 5, cap))
    assert max(got.values()) >= 1


def test_rules_are_matched_per_host(spark):
    """A host with nearly all URLs, also with broadcasts off: it is not shuffled with its rows."""
    urls = [f"http://big.test/{'en' if i % 2 else 'fr'}/{i}" for i in range(3000)] + ["http://x.y.z.test/q", "http://none.example/"]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, _path int")
    rules = W.rules_frame(spark, W.parse_allow_rules(["big.test/en", "z.test", "y.z.test/q"]))
    out = W.allowed_urls(df, rules)
    assert out.columns == df.columns and out.count() == 1501
    robots = spark.createDataFrame([("big.test", "*", 1, "/en/1", False), ("big.test", "*", 2, "/", True)],
                                   "host string, agent string, seq int, prefix string, allow boolean")
    got = W.robots_allowed(df.select("url"), robots)
    assert got.where("not robots_ok").count() == sum(u.startswith("http://big.test/en/1") for u in urls)
    assert got.count() == len(urls)
    assert W.allowed_urls(df.limit(0), rules).count() == 0
