"""Web pages as a stored table.

There is no HTTP client: a ``pages(url, html[, content_type])`` table stands
in for the web.  The crawl is a bounded breadth-first expansion over it — at
most ``max_depth + 1`` rounds of joins — with allow rules, robots rules,
content-type and length gates and content dedup, as in the reference's
crawler."""

from __future__ import annotations

import re


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.html import parse_pages
from corpusflow.functions.urls import host_suffixes, normalize_url, url_host, url_path
from corpusflow.operators.keys import first_wins, join_split_hot
from corpusflow.session import materialize

# Content types treated as HTML (substring match on the part before ';').
TEXT_LIKE_MIME = ("text/html", "application/xhtml+xml")
# an allow entry: scheme, host, path up to the last segment's parameters
_ALLOW_ENTRY = re.compile(r"(?:https?://)?(?P<host>[^/?#]*)(?P<path>[^?#]*?)(?:;[^/?#]*)?(?:[?#].*)?", re.DOTALL)


# ------------------------------------------------------------------ rules

def parse_allow_rules(entries: list[str]) -> list[tuple[str, str]]:
    """B11 rule parsing: entry lowercased, ``http://`` added when missing,
    ``(netloc, path)`` with a path of ``/`` meaning any."""
    found = [(e, _ALLOW_ENTRY.fullmatch(e)) for e in (entry.strip().lower() for entry in entries)]
    return [(m["host"], m["path"] if m["path"] != "/" else "") if m and m["host"] else (e, "") for e, m in found]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string")


def _with_host_index(df: DataFrame, index: DataFrame, url: str) -> DataFrame:
    """``df`` with ``_host``, ``_path`` and the columns of ``index`` (one row per
    ``_host``; null for other hosts).  Rows of hosts that a thousandth of all URLs
    or more belong to stay where they are (:func:`join_split_hot`)."""
    keyed = df.withColumn("_host", url_host(F.col(url))).withColumn("_path", url_path(F.col(url)))
    sizes = keyed.groupBy("_host").agg(F.count("*").alias("_n"))
    known = materialize(sizes.join(index, "_host"), "host-index")
    total = keyed.count()
    return join_split_hot(keyed, known, ["_host"], "_n", "left", total)


def allowed_urls(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Keep rows whose URL host equals or is a sub-domain of a rule
    host and whose path starts with the rule path (not segment-aware).

    Rules are matched per distinct host first, by an equi-join on the host's
    suffixes (``a.b.c`` -> ``a.b.c``, ``b.c``, ``c``); each host then has an array of
    path prefixes, and a URL is judged by its host's array, in place."""
    hosts = df.select(url_host(F.col(url)).alias("_host")).distinct()
    index = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("rule_host")).join(rules, "rule_host") \
        .groupBy("_host").agg(F.collect_set("rule_path").alias("_prefixes"))
    judged = _with_host_index(df, index, url)
    return judged.where(F.exists("_prefixes", lambda p: F.col("_path").startswith(p))) \
        .select(*df.columns)


def robots_allowed(df: DataFrame, robots: DataFrame, url: str = "url", user_agent: str = "*") -> DataFrame:
    """Add ``robots_ok``.  ``robots(host, agent, seq, prefix, allow)``:
    the rule group of the first agent (in ``seq`` order) that is a substring of
    the user agent's name is used, else the ``*`` group; the first rule of the
    group whose prefix starts the URL path decides; no match or no rules for
    the host = allowed.  A host's group is one array, looked up in place."""
    ua = user_agent.split("/")[0].lower()
    r = robots.withColumn("_specific", (F.col("agent") != "*") & F.lit(ua).contains(F.lower(F.col("agent"))))
    # per host: the first group that names the agent, else '*'
    groups = r.groupBy("host").agg(F.min_by("agent", F.when(F.col("_specific"), F.col("seq"))).alias("_group"))
    r = r.join(groups, "host").where(F.col("agent") == F.coalesce("_group", F.lit("*")))
    index = r.groupBy(F.col("host").alias("_host")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "prefix", "allow"))).alias("_rules"))
    judged = _with_host_index(df, index, url)
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    first = F.get(F.filter("_rules", lambda x: path.startswith(x["prefix"])), 0)
    return judged.select(*df.columns, F.coalesce(first["allow"], F.lit(True)).alias("robots_ok"))


# ------------------------------------------------------------------ pages

def html_gate(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """A10: content-type gate on the part before ';' (when the column exists)."""
    if content_type not in df.columns:
        return df
    ct = F.split(F.coalesce(F.col(content_type), F.lit("")), ";").getItem(0)
    return df.where(ct.contains(TEXT_LIKE_MIME[0]) | ct.contains(TEXT_LIKE_MIME[1]))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """B7 + B8 + B9: ``title``, ``text``, ``links`` (resolved, document order)."""
    parsed = pages.withColumn("_pg", parse_pages(F.col(html), F.col(url)))
    return parsed.select(*[c for c in pages.columns if c != html], F.col("_pg.title").alias("title"),
                         F.col("_pg.text").alias("text"), F.col("_pg.links").alias("links"))


def page_links(extracted: DataFrame, url: str = "url") -> DataFrame:
    """One row per anchor ``(src, pos, dst)``, ``dst`` normalised."""
    return extracted.select(F.col(url).alias("src"), F.posexplode("links").alias("pos", "raw")) \
        .select("src", "pos", normalize_url(F.col("raw")).alias("dst"))


# ------------------------------------------------------------------ crawl

def link_graph(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The stored pages parsed once: ``(store, edges)``.

    ``store``: one page per normalised URL (of several the one whose html has the
    least md5) with ``url, page_md5, title, text, text_md5, n_chars``; ``edges``: its
    anchors that a crawl may follow, ``(src, pos, dst)``, normalised, http(s), allowed."""
    parsed = extract_pages(html_gate(pages).select(
        normalize_url(F.col(url)).alias("url"), F.md5(F.col(html)).alias("page_md5"), F.col(html).alias("html")), "url", "html")
    parsed = materialize(parsed.withColumn("text_md5", F.md5("text")).withColumn("n_chars", F.length("text")), "crawl-pages")
    best = materialize(parsed.groupBy("url").agg(F.min("page_md5").alias("page_md5")), "crawl-urls")
    links = page_links(parsed.join(best, ["url", "page_md5"], "left_semi"), "url") \
        .where(F.col("dst").startswith("http://") | F.col("dst").startswith("https://"))
    links = materialize(links, "crawl-anchors")
    return parsed.join(best, ["url", "page_md5"], "left_semi"), materialize(allowed_urls(links, rules, "dst"), "crawl-edges")


def crawl_bfs(pages: DataFrame, seeds: DataFrame, rules: DataFrame, max_depth: int = 3,
              min_text_length: int = 200, max_pages: int | None = 250, robots: DataFrame | None = None,
              user_agent: str = "*", url: str = "url", html: str = "html") -> DataFrame:
    """Breadth-first expansion over the stored pages, first in, first out.

    Depth = first discovery; a URL is known from the moment it is enqueued;
    seeds outside the rules are dropped; pages that fail the fetch (absent from
    ``pages``), the content-type gate, the length gate or content dedup are
    dropped *and their links are not followed*; pages at ``max_depth`` are kept
    but not expanded.  Seeds are taken in URL order.  A discovered URL's place in
    the queue is its first parent's place and the position of the anchor there
    (``place``: the seed and the anchor positions on the way); it decides
    content-dedup ties and the ``max_pages`` cut.

    Html is read and parsed once (:func:`link_graph`); levels join narrow tables of
    URLs, hashes and edges, each written to the shared checkpoint folder; texts are
    joined to the kept URLs at the end.  Returns ``(url, depth, title, text)``."""
    store, edges = link_graph(pages, rules, url, html)
    narrow = store.select("url", "page_md5", "text_md5", "n_chars")
    start = seeds.select(normalize_url(F.col(url)).alias("url")).distinct()
    frontier = start.withColumn("place", F.struct(F.col("url").alias("seed"), F.array().cast("array<int>").alias("way")))
    known, kept_all = materialize(start, "crawl-known-0"), None
    frontier = allowed_urls(frontier, rules, "url")
    for depth in range(max_depth + 1):
        if robots is not None:
            frontier = robots_allowed(frontier, robots, "url", user_agent).where("robots_ok").drop("robots_ok")
        fetched = frontier.join(narrow, "url").where(F.col("n_chars") >= min_text_length)
        if kept_all is not None:
            fetched = fetched.join(kept_all.select("text_md5"), "text_md5", "left_anti")
        kept = first_wins(fetched, "text_md5", [F.col("place")]).withColumn("depth", F.lit(depth))
        kept = materialize(kept.select("url", "page_md5", "text_md5", "depth", "place"), f"crawl-kept-{depth}")
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        if depth >= max_depth:
            break
        way = F.struct("place.seed", F.concat("place.way", F.array("pos")).alias("way"))
        found = edges.join(kept.select(F.col("url").alias("src"), "place"), "src") \
            .groupBy(F.col("dst").alias("url")).agg(F.min(way).alias("place"))
        frontier = materialize(found.join(known, "url", "left_anti"), f"crawl-frontier-{depth + 1}")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.select("url"))
    if max_pages is not None:
        kept_all = kept_all.orderBy("depth", "place").limit(max_pages)   # the page cap is the feature
    return kept_all.select("url", "page_md5", "depth").join(store.select("url", "page_md5", "title", "text"), ["url", "page_md5"]) \
        .select("url", "depth", "title", "text")
