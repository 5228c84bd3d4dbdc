"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm.common import Scratch

#: So many edges at most are followed in one task.
FEW = 50_000


def joined(edges: DataFrame) -> DataFrame:
    """(node, label) of few edges (u, v), in one task; label is the least node."""

    def run(batches):
        import pyarrow as pa

        top: dict[int, int] = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                top[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([root(x) for x in top], pa.int64())], names=["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, few: int = FEW, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of an edge; label is one node of the component, the same for all of it. rows: about the number of edges, if known.

    In each round a node goes over to the first of its neighbours and itself, and the edges are
    redrawn between those that are left; edges within one of them, and repeated ones, go. The order is
    that of the nodes and one drawn anew by hashing, in turn: the former empties stars round a least
    node at once, the latter leaves an expected three quarters of the nodes at most, whatever the graph, so
    that the edges of all rounds together are a small multiple of the first ones. Each step is a grouped
    minimum (with partial results before the shuffle) or an equi-join; a node with very many edges is
    never gathered. Each round's tables are written to the shared folder, which cuts lineage. When `few`
    edges at most are left, one task ends the work.
    """
    e = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges", rows)
    rounds: list[DataFrame] = []
    while (n := e.count()) > few:
        k = len(rounds)
        order = (lambda c: F.xxhash64(c, F.lit(k))) if k % 2 else F.col  # noqa: B023
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", order("v")).alias("m"))
        goes = scratch.write(first.select(F.col("u").alias("node"), F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("label")), "goes", n)
        one = e.join(goes.select(F.col("node").alias("u"), F.col("label").alias("x")), "u").select("x", "v").distinct()
        two = one.join(goes.select(F.col("node").alias("v"), F.col("label").alias("y")), "v").filter("x != y")
        new = scratch.write(two.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges", n)
        scratch.drop(e)
        e = new
        rounds.append(goes)

    if n:
        rounds.append(scratch.write(joined(e), "goes"))

    def follow(later: DataFrame, goes: DataFrame) -> DataFrame:
        on = later.select(F.col("node").alias("label"), F.col("label").alias("last"))
        return goes.join(on, "label", "left").select("node", F.coalesce("last", "label").alias("label"))

    return reduce(follow, reversed(rounds)) if rounds else e.select(F.col("u").alias("node"), F.col("v").alias("label"))
