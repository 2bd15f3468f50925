"""Near-duplicate documents by MinHash.

1. One pass over the texts gives each document's number of distinct shingles, a
   128-bit fingerprint of its shingle set and its signature (minima of many
   universal hashes).  Documents with one fingerprint form a class; the smallest
   doc_id represents it, so thousands of copies cost one row from here on.
2. Signatures are cut to bands.  Representatives that agree in a band share a
   bucket.  In each bucket every member is paired with the smallest one only.
   Pairs are checked on signatures, then confirmed on the full shingle sets.
3. Components of the confirmed links are found by alternating large-star and
   small-star.  A bucket whose members all lie in one component is done.  In the
   others, every pair of members of different components is still compared (the
   members outside the bucket's largest component against all), on signatures
   and then on full sets, in blocks of bounded size; links join the components.

No pair that shares a bucket goes unexamined unless its two documents are
already known to be connected, and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import give_back, table, text_slices
from corpusflow.llm.components import connected_components
from corpusflow.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 512                      # documents of a block, two of which are compared in one task
_BLOCK_BYTES = 16 << 20           # and their sets and signatures


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text (words
    between ASCII white space, A-Z lower-cased).  A text of fewer words, but not
    none, has one shingle: all its words."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    acc = h[:n - size + 1] + np.uint64(size)
    for i in range(1, size):
        acc = (acc ^ (acc >> np.uint64(31))) * _MIX + h[i:n - size + 1 + i]
    return np.unique(acc ^ (acc >> np.uint64(29)))


class Universal:
    """``n`` multiply-add-shift hashes of 64-bit values to 32 bits."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)[:, None] | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)[:, None]

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 256):
            part = self.a * values[None, at:at + 256]
            part += self.b
            np.minimum(best, part.min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def _signature_rows(k: int, n_hashes: int):
    def run(batches):
        family = Universal(n_hashes)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                n, prints, signatures = [], [], []
                for text in texts:
                    s = shingle_set(text, k)
                    n.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signatures.append(family.minima(s).tobytes() if len(s) else None)
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()),
                                       pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
                                      names=["doc_id", "n_shingles", "print", "signature"])
        give_back()

    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                sets = [shingle_set(t, k).tobytes() for t in texts]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.binary())],
                                      names=["id", "shingles"])
        give_back()

    return run


def _agreement(a: list, b: list, n_hashes: int) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, n_hashes)
    y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, n_hashes)
    return (x == y).mean(axis=1)


@F.arrow_udf(T.DoubleType())
def _signature_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    a, b = a.to_pylist(), b.to_pylist()
    return pa.array(_agreement(a, b, len(a[0]) // 4) if a else [], pa.float64())


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = (np.frombuffer(v, np.uint64) for v in ((x, y) if len(x) <= len(y) else (y, x)))
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(int((y[at] == x).sum()))
    return pa.array(out, pa.int64())


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet ``100 * intersection >= percent * union``."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _block_links(n_hashes: int, least: float, percent: int):
    """Confirmed links between components, for a group of whole small areas or
    for two blocks (strays, all) of a large one."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        area, ids, comps, left = (group.column(c).to_numpy() for c in ("area", "id", "comp", "is_left"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, n_hashes)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found = []
        order = np.argsort(area, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(area[order])) + 1):
            strays, every = part[left[part]], part[~left[part]]
            in_big = comps[every] == area[every]
            for i in strays:
                near = every[(comps[every] != comps[i]) & (in_big | (ids[every] > ids[i]))]
                alike = (sig[near] == sig[i]).mean(axis=1)
                for j in near[alike >= least]:
                    a, b = top(int(comps[i])), top(int(comps[j]))
                    if a != b and _is_link(sets[i], sets[j], percent):
                        joined[max(a, b)] = min(a, b)
                        found.append((ids[i], ids[j]))
        return pa.table([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], schema=out)

    return run


class NearDuplicates:
    """The state of one run; ``labelled()`` gives the result."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, n_hashes: int = 128, rows_per_band: int = 4):
        self.k, self.percent, self.n_hashes, self.r = k, percent, n_hashes, rows_per_band
        # signatures estimate similarity with this standard error; four of them are allowed for
        p = percent / 100.0
        self.least = p - 4 * (p * (1 - p) / n_hashes) ** 0.5
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = materialize(self.docs.mapInArrow(
            _signature_rows(k, n_hashes), "doc_id long, n_shingles long, print binary, signature binary"), "signatures")
        classes = self.rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("print").agg(
            F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first"))
        self.classes = materialize(classes.select(
            "print", F.col("first.doc_id").alias("id"), F.col("first.n_shingles").alias("n"),
            F.col("first.signature").alias("signature")), "classes")

    def _buckets(self) -> DataFrame:
        """``(key, id, n_members, least)`` of buckets with two members or more."""
        width, n = 4 * self.r, self.n_hashes // self.r
        keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                           lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))))
        members = self.classes.select("id", F.explode(keys).alias("key"))
        shared = materialize(members.groupBy("key").agg(F.count("*").alias("n_members"), F.min("id").alias("least"))
                             .where(F.col("n_members") >= 2), "buckets")
        return materialize(members.join(shared, "key"), "bucket-members")

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that are links, as ``(u, v)``."""
        sig = self.classes.select("id", "signature")
        near = pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a") \
                    .join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b") \
                    .where(_signature_similarity("sa", "sb") >= self.least).select("a", "b")
        sets = self.sets
        both = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a") \
                   .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b") \
                   .select("a", "b", _common("xa", "xb").alias("common"),
                           ((F.octet_length("xa") + F.octet_length("xb")) / 8).cast("long").alias("total"))
        linked = 100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))
        return materialize(both.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def _with_component(self, df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
        r = roots.select(F.col("node").alias(column), F.col("root").alias("root_"))
        return df.join(r, column, "left").withColumn(name, F.coalesce("root_", column)).drop("root_")

    def _open_links(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between components that share buckets, beyond the star pairs.

        The buckets whose largest component is the same form one area, so that
        documents that share many buckets meet once.  The area's strays (its
        documents outside that component) are compared with all its documents,
        in blocks of bounded count and size."""
        placed = materialize(self._with_component(
            members.where(F.col("n_members") >= 3).select("key", "id"), roots, "id", "comp"), "placed")
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = materialize(sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("big"), F.count("*").alias("k"))
                            .where(F.col("k") >= 2).select("key", F.col("big.comp").alias("area")), "mixed-buckets")
        items = placed.join(mixed, "key").select("area", "id", "comp").distinct() \
            .join(self.classes.select("id", "n"), "id").withColumn("stray", F.col("comp") != F.col("area"))
        items = materialize(items, "open-items")
        size = F.col("n") * 8 + 4 * self.n_hashes
        blocks = lambda count, total: F.ceil(F.greatest(count / _BLOCK, total / _BLOCK_BYTES)).cast("int")
        areas = materialize(items.groupBy("area").agg(
            F.count("*").alias("count"), blocks(F.count("*"), F.sum(size)).alias("n_all"),
            blocks(F.count_if("stray"), F.sum(F.when(F.col("stray"), size))).alias("n_strays")), "open-areas")
        rows = items.join(areas, "area")
        place = F.xxhash64("id", F.lit(1))
        to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        every = rows.withColumn("is_left", F.lit(False)).withColumn("mb", F.pmod(place, "n_all").cast("int")) \
            .withColumn("sb", to_all("n_strays"))
        strays = rows.where("stray").withColumn("is_left", F.lit(True)) \
            .withColumn("sb", F.pmod(place, "n_strays").cast("int")).withColumn("mb", to_all("n_all"))
        n_groups = (areas.agg(F.sum("count")).first()[0] or 0) // _BLOCK + 1
        alone = (F.col("n_all") > 1) | (F.col("n_strays") > 1) | (F.col("count") > _BLOCK // 4)
        both = every.unionByName(strays).withColumn(
            "grp", F.when(alone, F.col("area")).otherwise(-1 - F.pmod(F.xxhash64("area"), F.lit(n_groups))))
        both = both.join(self.classes.select("id", "signature"), "id").join(self.sets, "id")
        return materialize(both.select("grp", "sb", "mb", "area", "id", "comp", "is_left", "signature", "shingles")
                           .groupBy("grp", "sb", "mb")
                           .applyInArrow(_block_links(self.n_hashes, self.least, self.percent), "u long, v long"),
                           "late-links")

    def roots(self) -> DataFrame:
        """``(node, root)`` of class representatives that are linked to a smaller one."""
        members = self._buckets()
        stars = materialize(members.where(F.col("id") != F.col("least"))
                            .select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
        ids = members.select("id").distinct()
        wanted = self.docs.where(F.col("doc_id").isNotNull()).join(ids, self.docs["doc_id"] == ids["id"], "left_semi")
        # rows that repeat a doc_id with another text: only the class that it represents is wanted
        sets = wanted.mapInArrow(_set_rows(self.k), "id long, shingles binary")
        own = self.classes.select("id", "n")
        self.sets = materialize(sets.join(own, "id").where(F.octet_length("shingles") == 8 * F.col("n"))
                                .select("id", "shingles").dropDuplicates(["id"]), "shingle-sets")
        first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = self._confirm(first)
        roots = connected_components(links)
        placed = self._with_component(self._with_component(stars, roots, "a", "ca"), roots, "b", "cb")
        rest = placed.where(F.col("ca") != F.col("cb")).select("a", "b").join(first, ["a", "b"], "left_anti")
        links = links.union(self._confirm(rest))
        roots = connected_components(links)
        more = self._open_links(members, roots)
        if more.isEmpty():
            return roots
        return connected_components(links.union(more))

    def labelled(self) -> DataFrame:
        """``doc_id, n_shingles, component_id, kept``, one row per row of the input."""
        roots = self.roots()
        names = materialize(self._with_component(self.classes.select("print", "id"), roots, "id", "component_id")
                            .select("print", "component_id"), "components")
        known = self.rows.select("doc_id", "n_shingles", "print")
        return known.join(names, "print", "left").select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")) \
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, n_hashes: int = 128,
                    rows_per_band: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if the intersection of their sets of ``k``-word
    shingles is at least ``percent`` % of the union; ``component_id`` is the
    smallest doc_id reachable.  A null or blank text has no shingles and is
    linked with nothing.  A row without doc_id takes no part (null component,
    kept).  Rows that repeat a doc_id are labelled each by its own text.
    """
    return NearDuplicates(docs, k, percent, n_hashes, rows_per_band).labelled()


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (all its columns) with one document of each group: the one with
    the smallest doc_id.  Rows that repeat the kept doc_id become one row."""
    found = near_duplicates(docs, k, percent).where(F.col("doc_id").isNotNull())
    per_id = materialize(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept-ids")
    gone = per_id.where(~F.col("kept")).select("doc_id")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    left = rows.join(gone, F.col("id") == gone["doc_id"], "left_anti")
    if not per_id.where(F.col("kept") & (F.col("n") > 1)).isEmpty():
        left = left.where(F.col("id").isNull()).unionByName(
            left.where(F.col("id").isNotNull()).dropDuplicates(["id"]))
    return left.select("row.*")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
