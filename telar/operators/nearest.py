"""Exact nearest neighbours by cosine over a clustered corpus whose clusters have bounds.

The corpus is cut into clusters round centres fitted on a sample of it; every row goes to its nearest centre and is
written once. A cluster's bounds are its centre and its radius. For a query q, by the triangle inequality, nothing in
a cluster is nearer than |q - centre| - radius. The k-th best score among the sampled rows is a query's first threshold;
it meets only clusters whose bound may reach that. No score is estimated, so the rows are those of a full scan, whatever
the centres; good centres make visits few.

Clusters near one another share a cell of at most CELL rows; a larger cluster fills several. A work unit is a cell with a block of at
most some QUERY_BLOCK queries that visit it. Vectors are moved once a unit, not once a cluster, so nothing that is moved or
held grows with queries times clusters. In a unit rows and queries are multiplied by tiles in float32, less the largest error that can
have; what may reach a query's threshold is scored again in float64, one pair at a time, so that equal vectors have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from telar.sources.files import settled

CLUSTER_ROWS, CELL, QUERY_BLOCK = 256, 1 << 16, 1 << 15
SAMPLE, LEAST_SAMPLE, CENTRE_BYTES = 16, 4096, 2 << 20
TILE, UNIT_BYTES = 2048, 16 << 20  # rows and queries multiplied at once; of a unit's queries
SLACK = 1e-9  # of bounds, for rounding
FOUND = "query_id long, id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def slack(width: int) -> float:
    """More than the error of a float32 product of unit vectors."""
    return (width + 8) * 2.0**-24


def kind_of(df: DataFrame) -> type:
    """In what the vectors of df lose nothing."""
    return np.float32 if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else np.float64


def matrix(column, kind: type = np.float64) -> np.ndarray:
    """A matrix from an Arrow column of number lists of one length, or of packed numbers."""
    if str(column.type) == "binary":
        return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(x: np.ndarray):
    """An Arrow column of the bytes of each row."""
    import pyarrow as pa

    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 1024] @ centres.T - half, axis=1) for a in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


def fitted(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n centres of unit vectors by Lloyd's rounds, begun with the first n rows."""
    centres = x[:n].copy()
    for _ in range(rounds if len(x) > n else 0):
        own = nearest_centre(x, centres)
        sums, size = np.zeros_like(centres), np.bincount(own, minlength=n)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres).astype(x.dtype)
    return centres


def bound(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By query and cluster: no row of the cluster has a higher cosine."""
    away = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * q @ centres.T, 0))
    return 1 - np.maximum(away - radius - SLACK, 0) ** 2 / 2 + SLACK


@dataclass
class Clustered:
    """rows: cluster, id, vec (packed numbers of a kind), written; centres, and by cluster the radius, the number of rows,
    its first cell and how many cells it has; sample: unit vectors of some rows."""

    rows: DataFrame
    kind: type
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    sample: np.ndarray

    def placed(self) -> DataFrame:
        """The rows with their cells; in a cluster of several cells by a hash of the id."""
        of = [(c, int(self.first[c]), int(self.cells[c])) for c in range(len(self.size))]  # a row a centre
        of = self.rows.sparkSession.createDataFrame(of, "cluster int, first int, cells int")
        return self.rows.join(F.broadcast(of), "cluster").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cells"))).cast("int")).drop("first", "cells")


def celled(centres: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first cell of each cluster and its number of cells: clusters near one another share a cell of at most `most` rows."""
    first, cells = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    groups = fitted(centres, min(len(centres), -(-int(size.sum()) // most)))
    cell, held = 0, 0
    for c in np.argsort(nearest_centre(centres, groups), kind="stable"):
        cells[c] = max(1, -(-size[c] // most))
        if held and held + size[c] > most:
            cell, held = cell + 1, 0
        first[c], held = cell, held + size[c]
        if cells[c] > 1:
            cell, held = cell + cells[c], 0
    return first, cells


def clustered(chunks: DataFrame, cluster_rows: int = CLUSTER_ROWS) -> Clustered:
    """The corpus (id, embedding), rows without a vector left out, as clusters of some cluster_rows rows.

    Centres, which fill CENTRE_BYTES at most, are fitted on some SAMPLE rows a centre, those whose hashes are low.
    """
    chunks = chunks.filter("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    kind = kind_of(chunks)
    n, width = chunks.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    centres = max(1, min(-(-n // cluster_rows), CENTRE_BYTES // (8 * max(width, 1))))
    want = max(SAMPLE * centres, LEAST_SAMPLE)
    some = chunks if n <= want else chunks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (want << 20) // n).limit(2 * want)
    some = some.toArrow() if n else None
    some = chunks.limit(1).toArrow() if n and not some.num_rows else some
    sample = unit(matrix(some.column(1).combine_chunks())).astype(np.float32) if n else np.zeros((0, width), np.float32)
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    found = fitted(sample, min(centres, len(sample)))
    sent = chunks.sparkSession.sparkContext.broadcast(found)

    def assign(batches):
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                raw = matrix(part.column(1)).astype(kind)
                x = unit(raw)
                own = nearest_centre(x.astype(np.float32), c)
                away = np.linalg.norm(x - c[own], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column(0), pa.array(away), packed(raw)], names=["cluster", "id", "away", "vec"])

    rows = settled(chunks.mapInArrow(assign, "cluster int, id long, away double, vec binary"), "clustered")
    radius, size = np.zeros(len(found)), np.zeros(len(found), np.int64)
    for r in rows.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size")).collect():  # a row a centre
        radius[r["cluster"]], size[r["cluster"]] = r["radius"], r["size"]
    found = found.astype(np.float64)
    most = min(CELL, max(TILE, -(-n // (3 * chunks.sparkSession.sparkContext.defaultParallelism))))
    return Clustered(rows.select("cluster", "id", "vec"), kind, found, radius, size, *celled(found, size, most), sample)


def visits(corpus: Clustered, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec, least, visited, cells: of each query that has a vector the first threshold, how many clusters may hold one
    of its k best, and the cells of these."""
    q = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    kind = kind_of(q)
    order = np.argsort(corpus.first, kind="stable")
    sent = q.sparkSession.sparkContext.broadcast((corpus.centres, corpus.radius, corpus.size, corpus.sample, order, np.unique(corpus.first[order], return_index=True)[1], corpus.cells[order]))

    def run(batches):
        import pyarrow as pa

        centres, radius, size, sample, order, starts, cells = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                raw = matrix(part.column(1)).astype(kind)
                v = unit(raw)
                least = np.full(len(v), -np.inf)
                if len(sample) >= k:
                    s = v.astype(np.float32) @ sample.T
                    least = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k].astype(np.float64) - slack(v.shape[1])
                visit = (bound(v, centres, radius) >= least[:, None]) & (size > 0) if len(size) else np.zeros((len(v), 0), bool)
                cell = np.zeros((len(v), 0), bool)
                if len(order):  # cells are numbered in this order
                    cell = np.repeat(np.logical_or.reduceat(visit[:, order], starts, axis=1), cells[starts], axis=1)
                cell = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cell.sum(1))].astype(np.int32)), pa.array(np.nonzero(cell)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), packed(raw), pa.array(least), pa.array(visit.sum(1).astype(np.int32)), cell], names=["query_id", "vec", "least", "visited", "cells"])

    return q.mapInArrow(run, "query_id long, vec binary, least double, visited int, cells array<int>")


class Best:
    """The k best rows so far of each of some queries (unit vectors), as flat arrays in the order of query, score and id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.q, self.q32, self.edge, self.k = ids, q, q.astype(np.float32), least.copy(), k  # edge: a bound of the k-th best score
        self.found, self.new, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def add(self, x: np.ndarray, x32: np.ndarray, ids: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> None:
        """x: unit vectors of rows; centres, radius: of the clusters they are in."""
        some = np.flatnonzero((bound(self.q, centres, radius) >= self.edge[:, None]).any(1))
        if not len(some):
            return
        s = (self.q32 if len(some) == len(self.q) else self.q32[some]) @ x32.T
        at = np.flatnonzero(s >= (self.edge[some] - slack(x.shape[1])).astype(np.float32)[:, None])
        step = max(1, (1 << 21) // max(1, x.shape[1]))
        for a in range(0, len(at), step):
            i, c = np.divmod(at[a : a + step], len(x))
            i = some[i]
            score = np.round((self.q[i] * x[c]).sum(1), 12)
            high = score >= self.edge[i]
            self.new.append((i[high], ids[c[high]], score[high]))
            self.waiting += int(high.sum())
            if self.waiting > max(self.k * len(self.q), 1 << 16):
                self.merge()

    def merge(self) -> None:
        query, id_, score = (np.concatenate(p) for p in zip(self.found, *self.new))
        order = np.lexsort((id_, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.found, self.new, self.waiting = (query[place < self.k], id_[kept], score[kept]), [], 0
        last = place == self.k - 1
        self.edge[query[last]] = np.maximum(self.edge[query[last]], score[order[last]])

    def result(self):
        import pyarrow as pa

        self.merge()
        query, id_, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(id_), pa.array(score)], names=["query_id", "id", "score"])


def met(corpus: Clustered, dealt: DataFrame, kind: type, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each query in each unit. dealt: unit, kind (0: query, 1: row), cluster, id, vec,
    least; a unit's rows come together, its queries first, and its rows by cluster."""
    sent = dealt.sparkSession.sparkContext.broadcast((corpus.centres, corpus.radius))
    own = corpus.kind

    def run(batches):
        centres, radius = sent.value
        now, asked, best = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            cut = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(key)]
            for a, z in zip(cut, cut[1:]):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if key[a, 0] != now:
                    yield from (b.result() for b in best or ())
                    now, asked, best = key[a, 0], [], None
                if key[a, 1] == 0:
                    asked.extend(part.slice(b, TILE) for b in range(0, len(part), TILE))
                if key[a, 1] == 0 or not asked:  # a block that no query fell to
                    continue
                if best is None:
                    best = [Best(p.column(3).to_numpy(), unit(matrix(p.column(4), kind)), p.column(5).to_numpy(), k) for p in asked]
                for b in range(0, len(part), TILE):
                    some = part.slice(b, TILE)
                    x, of = unit(matrix(some.column(4), own)), np.unique(some.column(2).to_numpy())
                    x32, ids = x.astype(np.float32), some.column(3).to_numpy()
                    for p in best:
                        p.add(x, x32, ids, centres[of], radius[of])
        yield from (b.result() for b in best or ())

    return dealt.mapInArrow(run, FOUND)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(corpus: Clustered, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query, by cosine to 12 decimals; ties go to the lesser id."""
    spark, kind = queries.sparkSession, kind_of(queries)
    asked = settled(visits(corpus, queries, k), "queries")
    most = max(1, min(QUERY_BLOCK, UNIT_BYTES // (8 * max(1, corpus.centres.shape[1])), (1 << 20) // k))
    units, n = [], 0
    for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # a row a cell
        units.append((r["cell"], n, -(-r["count"] // most)))
        n += units[-1][2]
    if not n:
        return best_of(spark.createDataFrame([], FOUND), k)
    of = F.broadcast(spark.createDataFrame(units, "cell int, first int, blocks int"))
    left = asked.select("query_id", "vec", "least", F.explode("cells").alias("cell")).join(of, "cell")
    left = left.select((F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("blocks"))).cast("int").alias("unit"), F.lit(0).alias("kind"), F.lit(-1).alias("cluster"), F.col("query_id").alias("id"), "vec", "least")
    right = corpus.placed().join(of, "cell").withColumn("unit", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    right = right.select("unit", F.lit(1).alias("kind"), "cluster", "id", "vec", F.lit(None).cast("double").alias("least"))
    dealt = left.unionByName(right).repartitionById(n, "unit").sortWithinPartitions("unit", "kind", "cluster")
    return best_of(met(corpus, dealt, kind, k), k)


def visit_report(corpus: Clustered, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, visited, clusters): how many of the clusters a search for k rows visits."""
    return visits(corpus, queries, k).select("query_id", "visited", F.lit(int((corpus.size > 0).sum())).alias("clusters"))
