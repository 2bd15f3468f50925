"""Approximate nearest neighbours by inner product.

Equal vectors form a class, indexed once.  Vectors get one more component that
makes them equally long, so that the largest inner product is the smallest
distance.  NN-descent starts from the cells of a few random hyperplane trees and
from cells dealt by hash, which leave no node without ``k`` first neighbours, and
improves every node's list through Spark joins of neighbours of neighbours: the
lists of a node (its neighbours and a bounded draw of those that list it) bring
their vectors together, every new pair is compared, and what beats the end of a
list enters it, until hardly any list changes.  Queries walk the graph greedily
from their own node, the longest vectors and a few random ones: each round expands the best nodes not yet expanded and keeps
the best found so far, until all kept ones are expanded.  The
graph works on 8-bit vectors, each with a scale of its own; the added component
stays a float beside them, so that a few long vectors do not blunt the rest.
Scores and ranks come from the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.llm.common import table
from corpusflow.session import materialize


def _pack(x: np.ndarray, longest: float) -> list[bytes]:
    """Rows as 8-bit vectors, before them three floats: their scale, how far the
    added component is below that of a vector of no length, and half the square
    of the length with this distance as the added component."""
    scale = (np.abs(x).max(axis=1) / 127.0).astype("<f4")
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    square, most = (x * x).sum(axis=1), np.sqrt(longest)
    below = square / (most + np.sqrt(np.maximum(0.0, longest - square)))
    head = np.stack([scale, below, most * below], axis=1).astype("<f4")
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q)]


def _unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and the two floats after the scale."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    head = np.ascontiguousarray(raw[:, :12]).view("<f4")
    return np.ascontiguousarray(raw[:, 12:]).view(np.int8).astype(np.float32) * head[:, :1], head[:, 1:]


def _closeness(rows: list[bytes]) -> np.ndarray:
    """Minus half the squared distances, the added component included."""
    x, more = _unpack(rows)
    below, half = more[:, 0], more[:, 1]
    return x @ x.T + np.outer(below, below) - half[:, None] - half[None, :]


def _pack_rows(longest: float):
    def run(batches):
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), pa.array(_pack(v, longest) if len(v) else [], pa.binary())],
                                  names=["id", "x"])
    return run


def _cell_rows(trees: int, depth: int, dim: int, seed: int):
    """Rows in the cells of the trees, and once in a cell by chance (tree -1)."""
    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, trees * depth)).astype(np.float32)
        for batch in batches:
            ids, xs = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            yield pa.record_batch([ids, xs, pa.array(np.full(len(ids), -1), pa.int64()), batch.column(2)],
                                  names=["id", "x", "tree", "code"])
            bits = (_unpack(xs.to_pylist())[0] @ planes > 0).reshape(len(ids), trees, depth)
            codes = (bits.astype(np.int64) << np.arange(depth)).sum(axis=2)
            for t in range(trees):
                yield pa.record_batch([ids, xs, pa.array(np.full(len(ids), t), pa.int64()), pa.array(codes[:, t])],
                                      names=["id", "x", "tree", "code"])
    return run


def _near_in_cell(k: int, k_chance: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])

    def run(group: pa.Table) -> pa.Table:
        ids, s = group.column("id").to_numpy(), _closeness(group.column("x").to_pylist())
        np.fill_diagonal(s, -np.inf)
        n = min(k_chance if group.column("tree")[0].as_py() < 0 else k, len(ids) - 1)
        best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((len(ids), 0), np.int64)
        u = np.repeat(np.arange(len(ids)), best.shape[1])
        return pa.table([pa.array(ids[u]), pa.array(ids[best.ravel()]), pa.array(s[u, best.ravel()], pa.float32())],
                        schema=out)
    return run


def _local_join(batches):
    """For each node: pairs of its list of which one is new, both ways, where
    they beat the end of a list."""
    for batch in batches:
        entries, ends = batch.column(1).values, batch.column(1).offsets.to_numpy()
        ids, fresh = entries.field("v").to_numpy(), entries.field("fresh").to_numpy(zero_copy_only=False)
        worst, xs = entries.field("worst").to_numpy(), entries.field("x").to_pylist()
        got = []
        for a, b in zip(ends[:-1], ends[1:]):
            i, first = np.unique(ids[a:b], return_index=True)
            if len(i) < 2:
                continue
            new, end, s = fresh[a:b][first], worst[a:b][first], _closeness([xs[a + j] for j in first])
            np.fill_diagonal(s, -np.inf)
            u, v = np.nonzero((s > end[:, None]) & (new[:, None] | new[None, :]))
            got.append((i[u], i[v], s[u, v]))
        u, v, s = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.float32))],
                              names=["u", "v", "sim"])


def _similarities(batches):
    """Inner products: a query has no added component."""
    for batch in batches:
        s = (_unpack(batch.column(2).to_pylist())[0] * _unpack(batch.column(3).to_pylist())[0]).sum(axis=1) \
            if batch.num_rows else np.zeros(0)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))],
                              names=["q", "v", "sim"])


_BROADCAST_BYTES = 32 << 20
_SEEDS = 32                       # longest vectors, and as many random ones, from which each query starts too
_UPDATES = 0.002                  # share of new list entries in a round from which the graph is done


def _held(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows * row_bytes`` is within the bound;
    a larger table meets its rows in a shuffled join, with the same result."""
    return F.broadcast(df) if rows * row_bytes <= _BROADCAST_BYTES else df


def _top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best rows per key; cut in each task before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc("sim"), "v")
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_")


class Index:
    """An NN-descent graph over the vectors of ``rows (vec_id, embedding)``."""

    def __init__(self, rows: DataFrame, members: int = 21, k: int = 24, reverse: int = 24, trees: int = 10,
                 leaf: int = 512, rounds: int = 50, seed: int = 11):
        self.k, self.reverse, self.seed = k, reverse, seed
        v = F.col("embedding")
        fit = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(
            v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))) & \
            F.exists(v, lambda c: c != 0)
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.transform(v, lambda c: c.cast("double")).alias("embedding")).where(fit)
        size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.dim = size["n"] if size else 0
        same = rows.where(F.size("embedding") == self.dim).distinct()
        order = W.partitionBy("embedding").orderBy("vec_id")
        self.classes = materialize(
            same.withColumn("r", F.row_number().over(order)).where(F.col("r") <= members)
            .groupBy("embedding").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("members")),
            "ann-classes")
        self.rows = same
        square = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c * c)
        n, longest = self.classes.agg(F.count("*"), F.max(square)).first()
        self.n = n
        self.x = materialize(self.classes.select("id", "embedding").repartition("id")
                             .mapInArrow(_pack_rows(longest or 0.0), "id long, x binary"), "ann-vectors")
        drawn = self.classes.select("id", square.alias("square"), F.xxhash64("id", F.lit(seed + 1)).alias("draw"))
        drawn = drawn.orderBy(F.desc("square"), "id").limit(_SEEDS) \
            .union(drawn.orderBy("draw", "id").limit(_SEEDS)).select(F.col("id").alias("v")).distinct()
        self.seeds = materialize(self.x.withColumnRenamed("id", "v").join(F.broadcast(drawn), "v"), "ann-seeds")
        self.graph = self._descend(self._start(trees, leaf), rounds)

    def _start(self, trees: int, leaf: int) -> DataFrame:
        depth = max(1, int(np.ceil(np.log2(max(2.0, self.n / leaf)))))
        # of n / chance nodes or more, but for few of them: all in one cell
        chance = max(1, self.n // max(leaf, 8 * self.k))
        cells = materialize(self.x.withColumn("code", F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(chance))).mapInArrow(
            _cell_rows(trees, depth, self.dim, self.seed), "id long, x binary, tree long, code long"), "ann-cells")
        sizes = cells.groupBy("tree", "code").agg(F.when(F.col("tree") < 0, F.lit(1)).otherwise(
            F.ceil(F.count("*") / (2.0 * leaf))).alias("parts"))
        near = cells.join(sizes, ["tree", "code"]) \
            .withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts")) \
            .groupBy("tree", "code", "part").applyInArrow(_near_in_cell(max(4, self.k // 2), self.k), "u long, v long, sim float")
        near = near.groupBy("u", "v").agg(F.max("sim").alias("sim"))
        return materialize(_top(near, "u", self.k).withColumn("fresh", F.lit(True)), "ann-graph")

    def _lists(self, graph: DataFrame, turn: int) -> DataFrame:
        """``(u, v, fresh)``: neighbours, and a bounded draw of reverse ones."""
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
        w = W.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("v", F.lit(turn)))
        back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.reverse).drop("r")
        return graph.select("u", "v", "fresh").union(back)

    def _descend(self, graph: DataFrame, rounds: int) -> DataFrame:
        for turn in range(rounds):
            ends = graph.groupBy("u").agg(F.when(F.count("*") >= self.k, F.min("sim"))
                                          .otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
            known = self.x.join(ends.withColumnRenamed("u", "id"), "id", "left") \
                .select(F.col("id").alias("v"), "x", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
            lists = self._lists(graph, turn).join(_held(known, self.n, self.dim + 48), "v") \
                .groupBy("u").agg(F.collect_list(F.struct("v", "fresh", "worst", "x")).alias("entries")) \
                .where(F.exists("entries", lambda e: e["fresh"]))
            found = lists.mapInArrow(_local_join, "u long, v long, sim float").groupBy("u", "v") \
                .agg(F.max("sim").alias("sim"))
            found = _top(found, "u", self.k).withColumn("fresh", F.lit(True))
            both = graph.withColumn("fresh", F.lit(False)).unionByName(found) \
                .groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
            graph = materialize(_top(both, "u", self.k), "ann-graph")
            if graph.where("fresh").count() <= _UPDATES * self.n * self.k:
                return graph
        raise RuntimeError(f"the graph still changes after {rounds} rounds")

    def search(self, queries: DataFrame, top: int = 20, beam: int = 200, expand: int = 32,
               rounds: int = 200) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries (vec_id)``, which are
        rows of the index: the ``top`` nearest found, the query's own excluded.
        The walk ends by itself; more than ``rounds`` rounds are an error."""
        own = queries.select(F.col("vec_id").alias("query_id")).distinct() \
            .join(self.rows.withColumnRenamed("vec_id", "query_id"), "query_id") \
            .join(self.classes.select("embedding", "id"), "embedding").select("query_id", F.col("id").alias("q"))
        own = materialize(own, "ann-queries")
        qx = materialize(own.select("q").distinct().join(self.x.withColumnRenamed("id", "q"), "q")
                         .select("q", F.col("x").alias("qx")), "ann-query-vectors")
        n_queries = qx.count()
        links = materialize(self._lists(self.graph, -1).groupBy("u").agg(F.collect_set("v").alias("to")), "ann-links")
        links = _held(links, self.n, 8 * (self.k + self.reverse) + 40)
        qs, xs = _held(qx, n_queries, self.dim + 48), _held(self.x.withColumnRenamed("id", "v"), self.n, self.dim + 48)
        seen = qx.select("q", F.col("q").alias("v"), F.lit(float("inf")).cast("float").alias("sim"))
        first = qx.crossJoin(F.broadcast(self.seeds)).where("q != v").select("q", "v", "qx", "x") \
            .mapInArrow(_similarities, "q long, v long, sim float")
        seen = materialize(seen.unionByName(first).withColumn("done", F.lit(False)), "ann-beam")
        for turn in range(rounds + 1):
            front = materialize(_top(seen.where(~F.col("done")), "q", expand).select("q", "v"), "ann-front")
            if front.isEmpty():
                break
            if turn == rounds:
                raise RuntimeError(f"beams still hold nodes to expand after {rounds} rounds")
            reached = front.withColumnRenamed("v", "u").join(links, "u").select("q", F.explode("to").alias("v")) \
                .distinct().join(seen.select("q", "v"), ["q", "v"], "left_anti")
            new = reached.join(qs, "q").join(xs, "v").select("q", "v", "qx", "x") \
                .mapInArrow(_similarities, "q long, v long, sim float").withColumn("done", F.lit(False))
            old = seen.join(front.withColumn("now", F.lit(True)), ["q", "v"], "left") \
                .select("q", "v", "sim", (F.col("done") | F.col("now").isNotNull()).alias("done"))
            seen = materialize(_top(old.unionByName(new), "q", beam + 1), "ann-beam")
        vectors = self.classes.select(F.col("id").alias("v"), F.col("embedding").alias("y"), "members")
        base = self.classes.select(F.col("id").alias("q"), F.col("embedding").alias("z"))
        pairs = seen.select("q", "v").join(vectors, "v").join(base, "q") \
            .select("q", "members", F.aggregate(F.zip_with("z", "y", lambda a, b: a * b), F.lit(0.0),
                                                lambda a, c: a + c).alias("score"))
        rows = pairs.join(own, "q").select("query_id", F.explode("members").alias("vec_id"), "score") \
            .where(F.col("vec_id") != F.col("query_id"))
        rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
            .select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, top: int = 20, beam: int = 200, **index) -> DataFrame:
    """The ``top`` nearest rows of ``vectors (vec_id, embedding)`` to each row
    that ``is_query`` picks, by inner product, ties to the smaller vec_id.

    Vectors that are null, zero, hold null or non-finite components or have
    another length than most take no part, nor do rows without vec_id.  Repeated
    rows count once; equal vectors under several ids are all found.
    """
    found = Index(vectors.select("vec_id", "embedding"), members=top + 1, **index)
    return found.search(vectors.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id")), top, beam)


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
