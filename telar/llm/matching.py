"""Links of sets that share keys, without expanding groups into pairs.

Members are (key, node, excess): nodes whose sets may be linked have a key in common, and their excesses add up to
zero or less (0 where no such bound is known). Sets link when 100 * |both| >= percent * |either|.

In each key, nodes are compared on the full sets with a pivot, that of least excess; who exceeds all others has no
partner there and goes at once. Jaccard distance is a metric: nodes linked with a pivot leave, as whatever is linked
with them is within twice a link's distance of the pivot and is tied to it. Keys whose nodes are all in one component
by now need no more, nor does a node need its own component's pivot. After ROUNDS rounds, nodes left in keys of at most SMALL are compared with one another, unless
they are of one component or exceed each other; larger keys join their nodes into clusters.

Clusters, joined by ties and by large keys, whose nodes are not all in one component are compared in full, but for
nodes of one component: in blocks of bounded size, by products of presence matrices, which give exact intersections.
That grows with the square of such a cluster's size. Components over all links are the result; no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.llm.common import Scratch
from telar.llm.components import components

ROUNDS, SMALL = 2, 32
PAIRS = 8192  # rows of pairs, before equal ones are dropped, that a task compares at least
BLOCK, BLOCK_SHINGLES = 512, 400_000
U = np.uint64


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near) of pairs whose distance is at most twice that of a link; near: they are linked."""
    sides = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")
    sides = sides.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both, either = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                own, other = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both[i] = len(np.intersect1d(own, other, assume_unique=True))
                either[i] = len(own) + len(other) - both[i]
            tie = (100 * both >= (2 * percent - 100) * either) & (both > 0)
            near = (100 * both >= percent * either) & tie
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["a", "b", "near"]).filter(pa.array(tie))

    return sides.select("a", "b", "set_a", "set_b").mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in (("a", T.LongType()), ("b", T.LongType()), ("near", T.BooleanType()))]))


def matchable(members: DataFrame) -> DataFrame:
    """Members whose excess leaves them a partner in their key."""
    least = members.groupBy("key").agg(F.min("excess").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND least <= 0")
    return members.join(least, "key").filter("excess + least <= 0").select("key", "node", "excess")


def pivoted(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and ties (a, b, near) of nodes with the pivots of their keys, the components (node, label) of the links, and the members left.

    Two linked nodes that share a key are of one component of the links, or of the ties, or are left in a key; members: (key, node, excess).
    """
    found, labels, left, rows = [], None, members.withColumn("label", F.col("node")), members.count()
    held = sets.count()  # a comparison reads the sets of few pairs too
    for _ in range(ROUNDS):
        pivots = left.groupBy("key").agg(F.min(F.struct("excess", "node", "label")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.excess").alias("least"), F.col("p.label").alias("joined"))
        # nodes of the pivot's component need no link with it, nor with whoever is linked with it
        pairs = left.join(pivots, "key").filter("label <> joined AND excess + least <= 0").select("key", "node", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = scratch.write(pairs, "pairs", rows)
        new = scratch.write(compared(pairs.select("a", "b").distinct(), sets, percent), "ties", pairs.count() + held, PAIRS)
        # a tie matters where its pivot has links: only then does somebody leave
        hubs = new.filter("near").select(F.explode(F.array("a", "b")).alias("node")).distinct()
        loose = new.filter("NOT near")
        loose = loose.join(hubs.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(loose.join(hubs.withColumnRenamed("node", "b"), "b", "left_semi"))
        found.append(scratch.write(new.filter("near").unionByName(loose).distinct(), "ties", rows))
        # pivots leave, and whoever is linked with one
        gone = pivots.select("key", F.col("pivot").alias("node")).unionByName(pairs.join(new.filter("near").select("a", "b"), ["a", "b"]).select("key", "node"))
        rest = left.join(gone.distinct(), ["key", "node"], "left_anti")
        # what the labels so far join, and the new links
        links = new.filter("near").select("a", "b")
        links = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = scratch.write(components(links, "a", "b", scratch, rows=rows), "labels", rows)
        rest = scratch.write(matchable(rest).join(labels, "node", "left").select("key", "node", "excess", F.coalesce("label", "node").alias("label")), "rest", rows)
        open_ = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).filter("x <> y").select("key", "n")
        left = scratch.write(rest.join(open_, "key").select("key", "node", "excess", "label", "n"), "left", rows)
        scratch.drop(pairs)
        scratch.drop(rest)
    return reduce(DataFrame.unionByName, found).distinct(), labels, left


def left_pairs(left: DataFrame) -> DataFrame:
    """(a, b): the nodes left in a key of at most SMALL that may be linked and aren't yet joined."""
    small = left.filter(F.col("n") <= SMALL)
    one, two = (small.select("key", F.col("node").alias(x), F.col("excess").alias(f"excess_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return one.join(two, "key").filter("a < b AND label_a <> label_b AND excess_a + excess_b <= 0").select("a", "b").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    every = np.concatenate(left + right)
    own = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(every, kind="stable")
    h, own = every[order], own[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    word = np.cumsum(new) - 1
    often = np.bincount(word) > 1
    keep = often[word]
    word, own = (np.cumsum(often) - 1)[word[keep]], own[keep]
    out, wide = np.zeros((len(left), len(right)), np.float32), 8192
    for a in range(0, int(often.sum()), wide):  # word is ascending
        i, j = np.searchsorted(word, [a, a + wide])
        x = np.zeros((len(left) + len(right), min(wide, int(often.sum()) - a)), np.float32)
        x[own[i:j], word[i:j] - a] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def joining_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within clusters between nodes of different labels; nodes: cluster, node, label, n.

    A label with BLOCK nodes or more in a cluster has blocks of its own, the others share blocks; pairs of
    blocks are compared unless both are of one label. What a pair of blocks is dealt are hashed sets.
    """
    blocks = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = nodes.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    placed = nodes.join(sizes, ["cluster", "label"]).withColumn("own", F.when(F.col("c") >= BLOCK, F.col("label").cast("string")).otherwise("*"))
    counts = placed.groupBy("cluster", "own").agg(blocks().alias("blocks"))
    ids = counts.select("cluster", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    ids = ids.withColumn("block", F.xxhash64("own", "k"))
    one, two = ids.select("cluster", F.col("own").alias("o1"), F.col("block").alias("i")), ids.select("cluster", F.col("own").alias("o2"), F.col("block").alias("j"))
    pairs = one.join(two, "cluster").filter("i <= j AND (o1 = '*' OR o2 = '*' OR o1 <> o2)").select("cluster", "i", "j")
    pairs = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    block = F.xxhash64("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = placed.join(counts, ["cluster", "own"]).select("cluster", "node", "label", block.alias("block"))
    dealt = dealt.join(pairs, ["cluster", "block"]).join(sets, "node")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "label", "node").select("cluster", "i", "j", "node", "label", F.col("block") == F.col("i"), "hashes")

    def run(batches):
        import pyarrow as pa

        def links(rows):
            sets = [np.frombuffer(r[6], U) for r in rows]
            same = rows[0][1] == rows[0][2]
            left = [k for k, r in enumerate(rows) if same or r[5]]
            right = left if same else [k for k, r in enumerate(rows) if not r[5]]
            if not left or not right or len({r[4] for r in rows}) < 2:
                return []
            n = np.array([len(x) for x in sets])
            label = np.array([r[4] for r in rows])
            both = intersections([sets[k] for k in left], [sets[k] for k in right])
            union = n[left][:, None] + n[right][None, :] - both
            near = (100 * both >= percent * union) & (both > 0) & (label[left][:, None] != label[right][None, :])
            top, out = {x: x for x in label.tolist()}, []

            def root(x):
                while top[x] != x:
                    x = top[x]
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                p, q = root(rows[left[i]][4]), root(rows[right[j]][4])
                if p != q:
                    top[max(p, q)] = min(p, q)
                    out.append((rows[left[i]][3], rows[right[j]][3]))
            return out

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[-1][:3]:
                    yield emit(links(held))
                    held = []
                held.append(row)
        if held:
            yield emit(links(held))

    return dealt.mapInArrow(run, "a long, b long")


def linked(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(node, label): the components of all links of members; nodes: (node, n); sets: (node, hashes); likely() may drop pairs (a, b) that can't be linked."""
    tied, labels, left = pivoted(members, sets, percent, scratch)
    rows = members.count()
    pairs = scratch.write(compared(likely(left_pairs(left)), sets, percent).filter("near"), "left", left.count() + sets.count(), PAIRS // 4)
    direct = tied.filter("near").select("a", "b").unionByName(pairs.select("a", "b"))
    large = left.filter(F.col("n") > SMALL)
    large = large.join(large.groupBy("key").agg(F.min("node").alias("a")), "key").select("a", F.col("node").alias("b"))

    labels = components(direct, "a", "b", scratch, rows=rows)
    clusters = components(tied.select("a", "b").unionByName(large).unionByName(pairs.select("a", "b")), "a", "b", scratch, rows=rows).withColumnRenamed("label", "cluster")
    about = clusters.join(labels, "node", "left").join(nodes.select("node", "n"), "node").withColumn("label", F.coalesce("label", "node"))
    about = scratch.write(about, "about", rows)
    mixed = about.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("cluster")
    rest = scratch.write(about.join(mixed, "cluster", "left_semi"), "mixed", rows)
    links = direct.unionByName(scratch.write(joining_links(rest, sets, percent), "links", rest.count() + sets.count() // 32, BLOCK // 8))
    return components(links, "a", "b", scratch, rows=rows)


def least_ids(labels: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(set_hash, component) of nodes (node, set_hash, id): the least id of a node's component, null where none of it has one."""
    labels = scratch.write(labels.join(nodes.select("node", "id"), "node"), "labels", nodes.count())
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    found = labels.join(least, "label").select("node", F.struct("least").alias("linked"))
    return nodes.join(found, "node", "left").select("set_hash", F.when(F.col("linked").isNull(), F.col("id")).otherwise(F.col("linked.least")).alias("component"))
