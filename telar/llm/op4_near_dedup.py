"""Near-duplicates by b-bit MinHash signatures and a multi-index Hamming join.

A document's set is its distinct 2-word shingles. Texts with equal sets collapse into one node
before anything is joined. A node's signature has CHUNKS x WIDTH symbols of 16 bits. By the
pigeonhole principle two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have a
chunk with at most ERRORS differing symbols; with ERRORS = 1 that error is enumerated by leaving out
each symbol of a chunk in turn, so such a pair has a key in common with certainty. (At similarity
0.8 a chunk agrees this way with probability 0.655, so a pair with more differences is missed with
probability 0.345 ** CHUNKS, 3e-6.)

Groups that share a key are not expanded into pairs but matched as matching.py says, on the full sets. Pairs left
in keys of few nodes are compared if their signatures differ in LIKELY symbols at most; at similarity 0.8 a pair differs in
more with a probability of 1e-6.

Nodes are numbered; a number stands for the 128-bit hash of a set, so an id with two texts is two nodes.
"Full sets" are sets of 64-bit hashes of shingles, made once from one text of each node that is compared
at all; that two different shingles of a pair have one hash has a probability of 1e-15 for sets of a hundred.

Null, empty or wordless text: empty set, linked with nothing. Every row gives a row, and its component
follows from its own text: rows that share an id and differ in text may differ in component. keep_one()
decides by row: of each group the rows of its least id stay, so no group is lost; repeated rows stay or go together.
Columns other than id and text are left out here, and hidden in keep_one(), so they cannot clash.

Rows without an id link as all others do. Their component is the least id of their group, null where no
row of the group has an id; they are always kept, as without an id they cannot be told from one another.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import IdFilter, Scratch, drop_ids, field, hidden, map_texts, read, shown
from telar.llm.matching import least_ids, linked

CHUNKS, WIDTH, ERRORS = 12, 6, 1
LIKELY = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


class Shingles:
    """Hashes of the distinct word n-grams of a text, sorted. Word hashes are remembered, up to `limit`."""

    def __init__(self, size: int = 2, limit: int = 400_000):
        import xxhash

        self.size, self.limit, self.hash, self.known = size, limit, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = text.encode().translate(LOWER).split() if text else []
        known, hash_ = self.known, self.hash
        if len(known) > self.limit:
            known.clear()
        w = np.fromiter((known.get(x) or known.setdefault(x, hash_(x)) for x in ws), U, len(ws))
        if not len(w):
            return w
        n = min(self.size, len(w))
        h = np.full(len(w) - n + 1, n, U)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        return np.unique(h)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def signature(hashes: np.ndarray, mul: np.ndarray) -> bytes:
    least = np.full(len(mul), ~U(0))
    for a in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[a : a + 4096, None] * mul).min(axis=0), out=least)
    return ((least >> U(24)) & U(0xFFFF)).astype(np.uint16).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, n_shingles, set_hash, sig); key names the row by id and text; set_hash and sig are null for an empty set."""

    def make():
        import xxhash

        shingles, mul = Shingles(size), multipliers(CHUNKS * WIDTH)

        def f(texts):
            n, own, sig = [], [], []
            for t in texts:
                h = shingles(t)
                n.append(len(h))
                own.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h, mul) if len(h) else None)
            return [n, own, sig]
        return f

    return map_texts(keyed_texts(docs, id_col, text_col), "text", ["id", "key"], [field("n_shingles", "long"), field("set_hash", "binary"), field("sig", "binary")], make)


def row_key(id_: Column, text: Column) -> Column:
    """Stands for a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(id_.cast("string"), F.lit("")), text)))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.alias("id"), row_key(id_, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def hashed_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, hashes): the sorted hashes of each node's set, from the row that reps (node, key) names for it."""
    flagged = IdFilter(reps, "key", buckets=1024).flag(keyed_texts(docs, id_col, text_col), F.col("key"), "maybe").filter("maybe")

    def make():
        shingles = Shingles(size)
        return lambda texts: [[shingles(t).tobytes() for t in texts]]

    made = map_texts(flagged, "text", ["key"], [field("hashes", "binary")], make).groupBy("key").agg(F.first("hashes").alias("hashes"))
    return reps.join(made, "key").select("node", "hashes")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node): for every chunk, its symbols without each one in turn."""
    keys = [
        F.xxhash64(F.lit(j * WIDTH + t), F.substring("sig", 2 * WIDTH * j + 1, 2 * t), F.substring("sig", 2 * (WIDTH * j + t) + 3, 2 * (WIDTH - 1 - t)))
        for j in range(CHUNKS) for t in range(WIDTH)
    ]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    cut = lambda c, k: F.substring(c, 2 * k + 1, 2)
    return sum(((cut(a, k) != cut(b, k)).cast("int") for k in range(1, CHUNKS * WIDTH)), (cut(a, 0) != cut(b, 0)).cast("int"))


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in LIKELY symbols at most."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(sig("b"), "b").join(sig("a"), "a").filter(distance("sig_a", "sig_b") <= LIKELY).select("a", "b")


def judged(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, key, n_shingles, component_id, kept) of every row; key stands for its id and text."""
    every = scratch.write(sketches(docs, id_col, text_col, size), "sketches")
    nodes = every.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("id"), F.min(F.struct("key", "n_shingles", "sig")).alias("x"))
    nodes = scratch.write(nodes.select("set_hash", "id", F.monotonically_increasing_id().alias("node"), "x.key", F.col("x.n_shingles").alias("n"), "x.sig"), "nodes", every.count(), 1 << 13)
    n = nodes.count()

    shared = keyed(nodes).groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("key")
    shared = scratch.write(shared, "shared", n * CHUNKS * WIDTH, 1 << 18)
    some = IdFilter(shared, "key", buckets=1024).flag(keyed(nodes), F.col("key"), "maybe").filter("maybe").drop("maybe")
    members = scratch.write(some.join(shared, "key").withColumn("excess", F.lit(0).cast("long")), "members", n * CHUNKS * WIDTH, 1 << 18)
    reps = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = scratch.write(hashed_sets(docs, scratch.write(reps, "reps", n), id_col, text_col, size), "sets", n, 1 << 11)

    named = least_ids(linked(members, nodes, sets, percent, scratch, lambda pairs: likely_pairs(pairs, nodes)), nodes, scratch)
    out = every.join(named, "set_hash", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """A row per input row: id, n_shingles, component_id (least id reachable by links), kept."""
    return judged(docs, scratch, id_col, text_col, size, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """Rows of docs but those that have a lesser id in their group: of each group, the rows of its least id stay."""
    df, names = hidden(docs)
    gone = scratch.write(judged(df, scratch, names[id_col], names[text_col], size, percent).filter("NOT kept").select("key"), "gone")
    keyed_ = df.withColumn("key", row_key(F.col(names[id_col]).cast("long"), F.col(names[text_col])))
    return shown(drop_ids(keyed_, gone, "key"), names)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
