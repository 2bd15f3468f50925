"""The prefix trie of rebuilt conversations by composable fingerprints.

A conversation may be rebuilt from the head of another one (its base) and its
own turns behind that many.  No rebuilt text is ever made:

1. Every turn gets a reference, a 128-bit hash of (role, text); that turns of one
   reference are equal is verified over all turns.
2. A sequence of turns is an element of a monoid, ``(length, value)`` with
   ``(m, u) * (n, v) = (m + n, u + B**m * v)``, four values modulo primes below
   2**31.  Prefix products of the stored conversations are a two-level scan:
   within range-sorted partitions, then over their fragments, so that a
   conversation of any length is spread over tasks.
3. A prefix of a rebuilt conversation is the product of a base head and a part
   of its own turns; both come from the stored prefix products
   (``part = (prefix - head) / B**m``), symbolically.
4. Rows of equal depth and product are a node.  All rows of a node must agree in
   their last turn's reference and in their parent, which by induction proves
   that their whole sequences are equal; if any node fails, the scan is done
   again with other constants.

Sums over subtrees need no walk over levels.  A node is owned by its smallest
member, and what a member owns is an end of its path; so a subtree's sum of
``(members - 1) * size`` is the sum, over the members, of the sizes between the
node and the first node that the member owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.session import materialize

_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)     # fixed values: primes below 2**31
_LANES = range(len(_PRIMES))
_KEY = ["depth", "a", "b"]
_HOT = 1000                       # keys with more than a thousandth of all rows are split off
_CHUNK = 1024                     # ids whose decimals are joined in one row
_TRIES = 8


def _bases(seed: int) -> list[int]:
    return [1 << 20 | int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:3], "big") for i in _LANES]


def _powers(seed: int):
    """A column function n -> B**n for each lane, by repeated squaring."""
    bases = _bases(seed)

    @F.arrow_udf(f"struct<{', '.join(f'p{i}: long' for i in _LANES)}>")
    def powers(n: pa.Array) -> pa.Array:
        todo = n.to_numpy(zero_copy_only=False)
        lanes = []
        for base, prime in zip(bases, _PRIMES):
            out, square, left = np.ones(len(todo), np.int64), base % prime, todo.copy()
            while left.any():
                out = np.where(left & 1, out * square % prime, out)
                square, left = square * square % prime, left >> 1
            lanes.append(pa.array(out))
        return pa.StructArray.from_arrays(lanes, names=[f"p{i}" for i in _LANES])

    return powers


def _mod(c: Column, lane: int) -> Column:
    return F.pmod(c, F.lit(_PRIMES[lane]))


def stored_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, c1, c2, size`` of ``turns (conv_id, turn, role, text)``:
    the reference of each turn and its text's code points.  Null roles and texts
    are empty, rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"))
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("c1"),
                       F.xxhash64(sha).alias("c2"), F.char_length("text").cast("long").alias("size"))


def verify_references(turns: DataFrame) -> None:
    """Raises if two different turns share a reference: one row per reference and
    task is shuffled, with its least and greatest role and text."""
    wrong = turns.groupBy("c1", "c2").agg(*(f(c).alias(f"{n}_{c}") for c in ("role", "text")
                                            for n, f in (("lo", F.min), ("hi", F.max)))) \
        .where("lo_role <> hi_role or lo_text <> hi_text").limit(1).collect()
    if wrong:
        raise RuntimeError("two different turns share a 128-bit reference")


def _numbered(turns: DataFrame) -> DataFrame:
    """The turns, range-sorted by conversation and turn (null first; ties by
    reference, then any order: such rows are equal), with the partition they
    stand in.  A long conversation, also one of equal turns, spreads over several."""
    order = ["conv_id", F.asc_nulls_first("turn"), "c1", "c2", "tie"]
    narrow = turns.select("conv_id", "turn", "c1", "c2", "size").withColumn("tie", F.monotonically_increasing_id())
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "trie-turns")


def prefix_products(turns: DataFrame, seed: int) -> DataFrame:
    """Per turn its position (from 0), the values ``v0..`` of the product before it
    and ``w0..`` including it, and the sizes before it (``before``)."""
    powers = _powers(seed)
    w = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "c1", "c2", "tie")
    element = [_mod(F.xxhash64(F.lit(seed * 8 + i), "c1", "c2"), i) for i in _LANES]
    local = turns.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("p", powers("i"))
    terms = local.select("conv_id", "part", "c1", "c2", "size", "i",
                         *(_mod(e * F.col(f"p.p{i}"), i).alias(f"t{i}") for i, e in zip(_LANES, element)))
    terms = materialize(terms, "trie-terms")
    fragments = terms.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("sizes"), *(_mod(F.sum(f"t{i}"), i).alias(f"t{i}") for i in _LANES))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fragments = fragments.withColumn("at", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("p", powers("at"))
    fragments = fragments.select(
        "conv_id", "part", "at", "p", F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("sizes_at"),
        *(F.coalesce(_mod(F.sum(_mod(F.col(f"t{i}") * F.col(f"p.p{i}"), i)).over(earlier), i), F.lit(0)).alias(f"at{i}")
          for i in _LANES))
    so_far = Window.partitionBy("conv_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = terms.withColumn("sizes", F.sum("size").over(so_far))
    for i in _LANES:
        rows = rows.withColumn(f"s{i}", _mod(F.sum(f"t{i}").over(so_far), i))
    rows = rows.join(fragments, ["conv_id", "part"])
    placed = [_mod(F.col(f"at{i}") + F.col(f"p.p{i}") * F.col(f"s{i}"), i) for i in _LANES]
    before = [_mod(F.col(f"at{i}") + F.col(f"p.p{i}") * _mod(F.col(f"s{i}") - F.col(f"t{i}"), i), i) for i in _LANES]
    return rows.select("conv_id", (F.col("at") + F.col("i")).alias("pos"), "c1", "c2", "size",
                       (F.col("sizes_at") + F.col("sizes") - F.col("size")).alias("before"),
                       *(c.alias(f"v{i}") for i, c in zip(_LANES, before)),
                       *(c.alias(f"w{i}") for i, c in zip(_LANES, placed)))


def _recipes(products: DataFrame, base: Column, head: Column, max_head: int) -> DataFrame:
    """One row per conversation: ``h`` (own turns left out), ``shift`` (turns that
    its base lacks), the base's first turns and what to subtract from and add to
    its own prefix products and sizes."""
    values = [f"{x}{i}" for x in "vw" for i in _LANES]
    first = products.groupBy("conv_id").agg(
        F.count("*").alias("own"), F.sum("size").alias("own_size"),
        F.array_sort(F.collect_list(F.when(F.col("pos") <= max_head, F.struct(
            "pos", "c1", "c2", "size", "before", *values)))).alias("turns"))
    first = materialize(first, "trie-first-turns")
    bases = first.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"), F.col("own").alias("base_own"))
    out = first.withColumn("base", base).withColumn("h", F.least(head.cast("long"), F.lit(max_head).cast("long"))) \
        .join(bases, "base", "left") \
        .withColumn("got", F.least("h", F.coalesce("base_own", F.lit(0))).cast("int")) \
        .withColumn("heads", F.when(F.col("got") > 0, F.slice("base_turns", F.lit(1), F.col("got")))) \
        .withColumn("shift", (F.col("h") - F.col("got")).cast("int"))
    last = F.element_at("heads", -1)
    cut = F.get("turns", F.col("h").cast("int"))                   # the first own turn that stays
    return out.select(
        "conv_id", "h", "shift", "heads",
        (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"),
        *(F.coalesce(last[f"w{i}"], F.lit(0)).alias(f"add{i}") for i in _LANES),
        *(F.coalesce(cut[f"v{i}"], F.lit(0)).alias(f"cut{i}") for i in _LANES),
        F.coalesce(last["before"] + last["size"], F.lit(0)).alias("add_size"),
        F.coalesce(cut["before"], F.lit(0)).alias("cut_size"),
        (F.coalesce(last["before"] + last["size"], F.lit(0))
         + F.when(cut.isNotNull(), F.col("own_size") - cut["before"]).otherwise(F.lit(0))).alias("total_size"))


def _packed(lanes: list[Column]) -> list[Column]:
    return [(F.shiftleft(lanes[k], 31) + lanes[k + 1]).alias(n) for k, n in ((0, "a"), (2, "b"))]


def _join_by_size(rows: DataFrame, info: DataFrame, keys: list[str], n_rows: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``info`` (one row per key, ``n_rows``: how many
    rows have it).  Keys with more than a thousandth of all rows, at most a
    thousand of them, are broadcast; the others are joined by shuffling."""
    hot = n_rows * _HOT > total
    marks = info.where(hot).select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(info.where(~hot), keys, how)
    return cold.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(info.where(hot)), keys, how))


def memberships(products: DataFrame, recipes: DataFrame, seed: int) -> DataFrame:
    """One row per rebuilt conversation and depth (0: the root): the node's
    ``depth, a, b``, its parent's ``pa, pb``, the last turn's reference and size
    and the sizes before it."""
    inverse = [[pow(b, -s, p) for s in range(64)] for b, p in zip(_bases(seed), _PRIMES)]
    root = recipes.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in (
        "a", "b", "pa", "pb", "c1", "c2", "size", "before")), (F.col("length") == 0).alias("is_end"))
    turn = F.col("turn")
    heads = recipes.where("heads is not null").select("conv_id", "length", F.explode("heads").alias("turn"))
    heads = heads.select(
        "conv_id", (turn.pos + 1).alias("depth"), *_packed([turn[f"w{i}"] for i in _LANES]),
        *(c.alias(n) for c, n in zip(_packed([turn[f"v{i}"] for i in _LANES]), ("pa", "pb"))),
        turn.c1.alias("c1"), turn.c2.alias("c2"), turn["size"].alias("size"), turn.before.alias("before"),
        (turn.pos + 1 == F.col("length")).alias("is_end"))
    info = recipes.where("length > size(coalesce(heads, array()))") \
        .select("conv_id", "h", "shift", "length", "add_size", "cut_size",
                *(f"{x}{i}" for x in ("add", "cut") for i in _LANES))
    own = _join_by_size(products, info, ["conv_id"], F.col("length"), products.count()) \
        .where(F.col("pos") >= F.col("h"))

    def product(value: str, i: int) -> Column:
        unshift = F.element_at(F.array(*map(F.lit, inverse[i])), F.col("shift") + 1)
        return _mod(F.col(f"add{i}") + unshift * _mod(F.col(f"{value}{i}") - F.col(f"cut{i}"), i), i)

    depth = F.col("pos") - F.col("shift") + 1
    own = own.select(
        "conv_id", depth.alias("depth"), *_packed([product("w", i) for i in _LANES]),
        *(c.alias(n) for c, n in zip(_packed([product("v", i) for i in _LANES]), ("pa", "pb"))),
        "c1", "c2", "size", (F.col("add_size") + F.col("before") - F.col("cut_size")).alias("before"),
        (depth == F.col("length")).alias("is_end"))
    return root.unionByName(heads).unionByName(own)


def prefix_trie(turns: DataFrame, base: Column | None = None, head: Column | None = None,
                max_head: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(nodes, ends)`` of the conversations ``turns (conv_id, turn, role, text)``.

    Conversation c becomes the first ``head`` turns of conversation ``base`` (all if
    it has fewer, none if it is absent), then its own turns after its first
    ``head``; both are expressions of ``conv_id``, ``head`` at most ``max_head``
    (63 or less).  Without them conversations stay as they are.

    ``nodes``: one row per distinct sequence of first turns, the empty one included:
    ``depth, a, b`` (its key), ``conv_id`` (smallest member), ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved`` (code points of its
    subtree that all but one member share, summed over nodes).  ``ends``: each
    conversation with the key of the node at which it ends.

    Turns are ordered by turn, null first; ties by a hash of role and text.  Rows
    that repeat all values are turns of their own.  Rows without conv_id are left
    out; other columns are not looked at; an empty table gives no node.
    """
    if not 0 <= max_head < 64:
        raise ValueError("max_head must be between 0 and 63")
    base = F.lit(None).cast("long") if base is None else base
    head = F.lit(0) if head is None else head
    stored = stored_turns(turns.select("conv_id", "turn", "role", "text"))
    verify_references(stored)
    numbered = _numbered(stored)
    for seed in range(_TRIES):
        products = materialize(prefix_products(numbered, seed), "trie-products")
        recipes = materialize(_recipes(products, base, head, max_head), "trie-recipes")
        members = materialize(memberships(products, recipes, seed), "trie-members")
        same = [F.min(c) == F.max(c) for c in ("c1", "c2", "pa", "pb")]
        nodes = materialize(members.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
            F.min("before").alias("before"), (same[0] & same[1] & same[2] & same[3]).alias("proven")), "trie-nodes")
        if not nodes.where(~F.col("proven")).limit(1).collect():
            return _with_sums(nodes, members, recipes), members.where("is_end").select("conv_id", *_KEY)
    raise RuntimeError(f"fingerprints of different prefixes met in {_TRIES} tries")


def _with_sums(nodes: DataFrame, members: DataFrame, recipes: DataFrame) -> DataFrame:
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")) \
        .agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")),
                        "trie-children")
    # what a conversation owns: its path from here on, a leaf if no other one goes on
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("until"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    who = recipes.select("conv_id", "length", "total_size").join(owned, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("until", "total_size").alias("until"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    who = materialize(who, "trie-owners")
    sums = _join_by_size(members.select("conv_id", *_KEY, "before"), who, ["conv_id"], F.col("length") + 1, members.count()) \
        .groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"),
                            F.sum(F.greatest(F.col("until") - F.col("before"), F.lit(0))).alias("saved"))
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = _join_by_size(nodes.where("depth > 0").drop("n_children"), parents, ["depth", "pa", "pb"], F.col("n_children"),
                          nodes.count()).select(*_KEY, "parent_conv_id")
    return nodes.join(below, _KEY, "left").join(sums, _KEY).select(
        *_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")


def _joined_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, joined by commas, as they stream by in order."""
    key, digest = None, None

    def row(key, digest):
        return pa.record_batch([pa.array([x]) for x in key] + [pa.array([digest.hexdigest()])], names=[*_KEY, "sha256"])

    for batch in batches:
        for *now, chunk in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now != key:
                if key is not None:
                    yield row(key, digest)
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk.encode())
    if key is not None:
        yield row(key, digest)


def ends_sha256(ends: DataFrame) -> DataFrame:
    """``depth, a, b, sha256`` of the conversations that end at a node: their
    decimal ids, ascending, joined by commas.  Ids are joined in chunks of a
    range of ``_CHUNK`` first; the chunks of a node then stream through the hash."""
    chunk = F.floor(F.col("conv_id") / _CHUNK)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ends.groupBy(*_KEY, chunk.alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids") \
        .mapInArrow(_joined_sha256, "depth long, a long, b long, sha256 string")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    nodes, ends = prefix_trie(table(spark, sf_dir, "conversations"), base=c - c % 100,
                              head=F.crc32(c.cast("string").cast("binary")) % 6, max_head=5)
    return nodes.join(ends_sha256(ends), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: crc32 by bits; every node is spread to its ancestors for the sums over subtrees
SQL = r"""
WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, conv_id::VARCHAR AS s, list(x ORDER BY pos) AS xs FROM t GROUP BY conv_id),
h AS (SELECT conv_id, xs, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                                   lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h FROM own),
r AS (SELECT a.conv_id, list_concat(coalesce(b.xs[1:a.h], []), a.xs[a.h + 1:]) AS xs
      FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, d, xs[1:d] AS p, d = len(xs) AS ended FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM r)),
n AS (SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended) AS ends FROM m GROUP BY p),
c AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.p = c.p),
s AS (SELECT p[1:k] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
             sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(p[-1].text) ELSE 0 END)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS k FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON f.p = s.p LEFT JOIN n u ON f.d > 0 AND u.p = f.p[1:f.d - 1]
"""
