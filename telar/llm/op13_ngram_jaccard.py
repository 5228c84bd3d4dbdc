"""N-gram Jaccard join by prefixes whose frequent elements are indexed in combinations.

A document's set is its distinct 4-word shingles; equal sets collapse into one node before anything is
joined. Two sets of n and m elements link when 100 * |both| >= 85 * |either|, so each lacks at most
spare(n) = n - ceil(0.85 n) of its own elements in the other.

1. Which sets can have a partner at all: one that has more than spare(n) elements which no other set has,
   can't. That is counted on a quarter of the hash range, for which the bound holds just as well, so that
   only these elements are shuffled. What is left are sets most of whose elements are shared.
2. Among these sets, elements are counted exactly and put in one order: by the number of sets that hold them,
   then by hash. Of two linked sets the first common element c1 stands among the first spare(n) + 1 elements of
   both, the second one c2 among the first spare(n) + 2: the extended prefix.
3. Elements of at most RARE sets are rare and index a set alone. Frequent ones index it in combinations of two,
   one from the prefix with a later one from the extended prefix: if c1 is frequent, so is c2, as it is later in
   the order. Sets of more than LONG elements, whose combinations would be too many, use single frequent
   elements too, and so do, besides, the sets down to 0.85 * LONG, which may be linked with such a set.
4. Groups that share a key are not expanded into pairs but matched as matching.py says. Linked sets differ in at most
   15/185 of their sizes' sum, and what no other set has counts in full: that bounds the pairs worth comparing
   (a set's excess: 185 times its elements that no other set has, less 15 times its size).

Sets are those of 64-bit hashes of shingles; that two different shingles of a pair of sets have one hash has a
probability of 1e-15 for sets of a hundred.

Null, empty or wordless text: empty set, linked with nothing. Every row gives a row, and its component follows
from its own text: rows that share an id and differ in text may differ in component. Rows without an id link as
all others do; their component is the least id of their group, null where no row of it has one. Other columns
than id and text are left out, so they cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import Scratch, field, map_texts, read, sliced
from telar.llm.matching import linked, least_ids, matchable
from telar.llm.op4_near_dedup import Shingles, U, hashed_sets, keyed_texts

SIZE, PERCENT = 4, 85
RARE, LONG = 16, 256
SLICE = U(1 << 62)


def spare(n: int, percent: int) -> int:
    """Elements of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def summaries(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, n_shingles, set_hash, part): part has the set's hashes in the first quarter of their range; set_hash and part are null for an empty set."""

    def make():
        import xxhash

        shingles = Shingles(size)

        def f(texts):
            n, own, part = [], [], []
            for t in texts:
                h = shingles(t)
                n.append(len(h))
                own.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                part.append(h[: np.searchsorted(h, SLICE)].tobytes() if len(h) else None)
            return [n, own, part]
        return f

    return map_texts(keyed_texts(docs, id_col, text_col), "text", ["id", "key"], [field("n_shingles", "long"), field("set_hash", "binary"), field("part", "binary")], make)


def elements(sets: DataFrame, column: str) -> DataFrame:
    """(node, h): a row for each element of each set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sliced(batch, 1):
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(own))], names=["node", "h"])

    return sets.select("node", column).mapInArrow(run, "node long, h long")


def prefix_keys(df: np.ndarray, h: np.ndarray, n: int, percent: int, rare: int = RARE, long: int = LONG) -> np.ndarray:
    """Keys of a set of n elements, of which those with hashes h are in df > 1 sets and the others in no other."""
    order = np.lexsort((h, df))
    df, h = df[order], h[order].astype(U)
    first = spare(n, percent) + 1 - (n - len(h))  # elements that no other set has come first and are no keys
    if first <= 0 or n < 2:
        return np.zeros(0, U)
    alone = int(np.searchsorted(df[:first], rare, side="right"))
    keys = [h[:alone]]
    once, ahead = h[alone:first], h[alone : first + 1]
    if n <= long:
        i, j = np.triu_indices(len(once), 1, len(ahead))
        x = (once[i] * U(0x9E3779B97F4A7C15)) ^ (ahead[j] + U(0x632BE59BD9B4E019))
        keys.append((x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9))
    if 100 * n > percent * long:
        keys.append(once ^ U(0x5851F42D4C957F2D))
    return np.concatenate(keys)


def indexed(sets: DataFrame, nodes: DataFrame, percent: int, rare: int, long: int) -> DataFrame:
    """(key, node, excess): the keys under which a set meets every set it may be linked with."""
    counts = elements(sets, "hashes").groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = elements(sets, "hashes").join(counts, "h").groupBy("node").agg(F.collect_list(F.struct("df", "h")).alias("own"))
    fit = ordered.join(nodes.select("node", "n"), "node").filter(f"n - size(own) <= n - ({percent} * n + 99) div 100")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for node, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = own.values
                keys = prefix_keys(x.field(0).to_numpy(), x.field(1).to_numpy(), n, percent, rare, long).view(np.int64)
                excess = (100 + percent) * (n - len(x)) - (100 - percent) * n
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.full(len(keys), v, np.int64)) for v in (node, excess))], names=["key", "node", "excess"])

    return fit.select("node", "n", "own").mapInArrow(run, "key long, node long, excess long")


def jaccard_components(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, rare: int = RARE, long: int = LONG
) -> DataFrame:
    """A row per input row: id, n_shingles, component_id (least id reachable by links); percent: 51 to 100."""
    if not 50 < percent <= 100:
        raise ValueError("percent: 51 to 100")
    every = scratch.write(summaries(docs, id_col, text_col, size), "summaries")
    nodes = every.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("id"), F.min(F.struct("key", "n_shingles", "part")).alias("x"))
    nodes = scratch.write(nodes.select("set_hash", "id", F.monotonically_increasing_id().alias("node"), "x.key", F.col("x.n_shingles").alias("n"), "x.part"), "nodes", every.count(), 1 << 13)

    alone = elements(nodes, "part").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    could = nodes.join(alone, "node", "left").filter(f"n > 1 AND coalesce(alone, 0) <= n - ({percent} * n + 99) div 100").select("node", "key", "n")
    could = scratch.write(could, "could", nodes.count(), 1 << 13)
    n = could.count()
    sets = scratch.write(hashed_sets(docs, could, id_col, text_col, size), "sets", n, 1 << 8)

    keys = scratch.write(indexed(sets, could, percent, rare, long), "keys", n, 1 << 8)
    members = scratch.write(matchable(keys), "members", keys.count(), 1 << 18)

    named = least_ids(linked(members, could, sets, percent, scratch), nodes, scratch)
    out = every.select("id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op13_ngram_jaccard": op13_ngram_jaccard}
ORACLES = {
    "op13_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
elements AS (SELECT DISTINCT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id
FROM sets s LEFT JOIN least l ON l.x = s.doc_id"""}
