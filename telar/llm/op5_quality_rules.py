"""Quality rules: an isolation forest on rule statistics.

The statistics of every whole text are written once to a scratch table. The forest is grown on the
driver from a bounded sample (`sample` rows) of the labelled rows that pass the base rules, good and
bad (of all rows where none is labelled); anomaly scores follow from path lengths over random splits. The
threshold is calibrated on all labelled rows, through a histogram of their scores: the lowest score
at which at most `clean_loss` of the good ones (base rules passed) would go.

Null text: no words. A document without words fails the base rules. A forest grows from whatever rows
there are; from two rows or fewer it has nothing to tell apart, and every score is 0.5. Without a labelled good
and a labelled bad row that pass the base rules there is no threshold, and only the base rules decide. Several labels of a document: the lowest counts. Every row gives a row. Columns other
than id and text are left out, so they cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import Scratch, field, map_texts, read

# The symbols that count.
SYMBOLS = "#*$%&|<>"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]


def statistics(text: str | None) -> list[int]:
    """The values named in STATS, of a whole text."""
    text = text or ""
    data = text.encode()
    ws = data.split()
    spaces = sum(map(data.count, b" \t\n\r\x0b\x0c"))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws))
    repeated = 0
    if len(ws) > 3:
        v = len(known)  # a window's code is exact while v ** 3 < 2 ** 63
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:] if v < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1]
        _, which, n = np.unique(code, return_inverse=True, return_counts=True)
        again = n[which] > 1
        hit = np.zeros(len(ws), bool)
        for k in range(3):
            hit[k : len(ws) - 2 + k] |= again
        repeated = int(hit.sum())
    b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return [
        len(ws), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        int(b[65:91].sum()), int(b[48:58].sum()), int(b[[33, 59, 63, 91, 93, 123, 124, 125]].sum()),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """What the splits see, from columns as in STATS: logarithms of the rates of symbols, marks and
    capitals, and of the mean word length. Lengths and repeats are left to the base rules."""
    w, chars, sym, _, _, _, up, _, marks = (stats[:, i].astype(np.float64) for i in range(9))
    w1, c1 = np.maximum(w, 1), np.maximum(chars, 1)
    return np.log10(np.stack([sym / w1, marks / w1, up / c1, chars / w1], 1) + 1e-3)


class IsolationForest:
    """Random splits on random features; short mean paths mean anomalies."""

    def __init__(self, x: np.ndarray, trees: int = 100, size: int = 64, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(x))
        trees = trees if self.size > 1 else 0
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _usual(n):
        """Mean path length of an unsuccessful search among n."""
        n = np.maximum(np.asarray(n, np.float64), 1)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def _grow(self, x, rng):
        """Arrays of feature (-1: leaf), split value, left child (right is the next), path length at a leaf."""
        nodes, todo = [[-1, 0.0, 0, 0.0]], [(0, x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
            if depth >= self.depth or len(rows) < 2 or not len(spread):
                nodes[at][3] = depth + float(self._usual(len(rows)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left = rows[:, f] < cut
            nodes[at][:3] = f, cut, len(nodes)
            todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        a = np.array(nodes)
        return a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 for anomalies."""
        if not self.trees:
            return np.full(len(x), 0.5)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, child[at] + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self._usual(self.size)), 1e-9))


def threshold(bins: list[tuple[int, int, int]], clean_loss: float) -> float:
    """The least lower edge of a bin (number, good rows, bad rows; ascending) with a bad row from which on at most the share clean_loss of all good rows lies."""
    good, limit, above = sum(b[1] for b in bins), 1.01, 0
    for k, n_good, n_bad in reversed(bins):
        above += n_good
        if not good or above > clean_loss * good:
            break
        if n_bad:
            limit = k / 2000
    return limit


def assess(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", sample: int = 4096, clean_loss: float = 0.001) -> DataFrame:
    """A row per input row: id, the statistics, base_failed, anomaly, kept."""
    stats = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"], [field(c, "long") for c in STATS], lambda: lambda texts: list(map(list, zip(*map(statistics, texts)))))
    stats = scratch.write(stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "stats")

    marks = labels.select(F.col("doc_id").alias("id"), "quality").filter("quality IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    marked = stats.filter("NOT base_failed").join(marks, "id")
    source = marked
    n = source.count()
    if not n:
        source = stats.filter("NOT base_failed")
        n = source.count()
    luck = F.pmod(F.xxhash64("id", F.lit("forest")), F.lit(1_000_003))
    rows = source.withColumn("luck", luck).filter(F.col("luck") < min(1.0, 1.3 * sample / max(n, 1)) * 1_000_003).orderBy("luck", "id", *STATS).limit(sample).select(*STATS).collect()
    forest = docs.sparkSession.sparkContext.broadcast(IsolationForest(features(np.array(rows, np.int64).reshape(-1, len(STATS)))))  # bounded by trees x size

    def scored(df, keep):
        from pyspark.sql import types as T

        schema = T.StructType([df.schema[c] for c in keep] + [field("anomaly", "double")])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = np.stack([b.column(c).to_numpy() for c in STATS], 1) if len(b) else np.zeros((0, len(STATS)), np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(forest.value.score(features(x)), pa.float64())], names=[*keep, "anomaly"])

        return df.select(*dict.fromkeys([*keep, *STATS])).mapInArrow(run, schema)

    bins = scored(marked, ["quality", *STATS]).groupBy((F.col("anomaly") * 2000).cast("int").alias("bin")).agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad")).orderBy("bin").collect()  # 2001 rows at most
    limit = threshold([(r["bin"], r["good"], r["bad"]) for r in bins], clean_loss)
    out = scored(stats, ["id", *STATS, "base_failed"])
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") < limit)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "anomaly")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
