"""Audit of how sources diverge within each language, by a recount through minimal perfect hashes.

First pass: each term's number of documents by language, exactly; terms of at least MIN_DOCS documents are kept. The
kept terms of a language are cut into shards by hash, SHARD terms each on average, and each shard gets a minimal
perfect hash: bit arrays in which a key stands at the first level where it is alone, and whose popcounts give its
slot. Slots store their terms, so that a term that isn't kept is told from the one whose slot it hits.

Second pass: the shards are broadcast, and every task increments dense slots for each (language, source). Shards are
broadcast in blocks of at most BLOCK_BYTES of terms; more blocks are handled one after another, each by a pass over
the texts, so that the broadcast is bounded whatever the vocabulary. A task holds at most HELD slots before it hands
them on, cut into pieces of PIECE slots, those without a count left out. Pieces of a group are then summed; no group
is gathered.

All arithmetic is exact in 64 bits: 10**9 * (c + 2) // D is worked out in three steps of a thousand, right for
D < 9 * 10**15. Divergences of pairs of sources are summed over shards, in blocks of SOURCES sources by SOURCES.

Null text, lang and source count as ''. Repeated rows are documents of their own. Other columns, ids too, are left
out, so they cannot clash. A language without kept terms has pairs of value 0 and no terms. An empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.llm.common import Scratch, read, sliced

MIN_DOCS, TOP = 10, 10
SHARD, PIECE, SOURCES = 16384, 512, 64
BLOCK_BYTES, HELD, MOST_TERMS = 32 << 20, 8 << 20, 120_000
U = np.uint64
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def hashed(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), U, len(keys))


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = (h ^ U(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class PerfectHash:
    """Slots 0 to n - 1 for the n distinct 64-bit hashes it was built from; -1 or any slot for others."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            size = 2 * len(h) + 1
            at = (mixed(h, len(levels)) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            h = h[~alone[at]]
        return cls(levels)

    @classmethod
    def read(cls, data: bytes) -> PerfectHash:
        levels = []
        while data:
            size = int.from_bytes(data[:4], "little")
            n = 4 + -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data[4:n], np.uint8), count=size).astype(bool))
            data = data[n:]
        return cls(levels)

    def bytes(self) -> bytes:
        return b"".join(len(b).to_bytes(4, "little") + np.packbits(b).tobytes() for b in self.levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        out, left = np.full(len(h), -1), np.arange(len(h))
        for k, bits in enumerate(self.levels):
            at = (mixed(h[left], k) % U(len(bits))).astype(np.int64)
            there = bits[at]
            out[left[there]] = self.before[k] + self.ranks[k][at[there]]
            left = left[~there]
        return out


def plain(docs: DataFrame) -> DataFrame:
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    return docs.select(c("lang"), c("source"), c("text"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, df) summed within tasks."""

    def run(batches):
        import pyarrow as pa

        def rows():
            out = [(lang, t, n) for lang, c in held.items() for t, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1].decode() for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["lang", "term", "df"])

        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(set(terms(text)))
                if sum(map(len, held.values())) > MOST_TERMS:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, df long")


def shards(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, shard, shards, slots, terms, tables): every shard's perfect hash, terms by slot, and its language's number of shards; sizes: (lang, v, shards), whose languages get shard 0 at least."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = hashed([t.encode() for t in batch.column(1).to_pylist()]) >> U(20)
            at = at % batch.column(2).to_numpy().astype(U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int64)), batch.column(2), batch.column(1)], names=["lang", "shard", "shards", "term"])

    def build(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (lang, shard, number), own in itertools.groupby(rows, key=lambda r: r[:3]):
            own = [r[3] for r in own if r[3] is not None]
            h = hashed([t.encode() for t in own])
            table = PerfectHash.build(h)
            by_slot = [t for _, t in sorted(zip(table.slots(h).tolist(), own))]
            arrays = [pa.array([x], t) for x, t in ((lang, pa.string()), (shard, pa.int64()), (number, pa.int64()), (len(own), pa.int64()), (by_slot, pa.list_(pa.string())), (table.bytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "shard", "shards", "slots", "terms", "tables"])

    placed = kept.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(place, "lang string, shard long, shards long, term string")
    # the rows without a term see to it that every language has shard 0
    placed = placed.unionByName(sizes.select("lang", F.lit(0).cast("long").alias("shard"), "shards", F.lit(None).cast("string").alias("term")))
    dealt = placed.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term")
    return dealt.mapInArrow(build, "lang string, shard long, shards long, slots long, terms array<string>, tables binary")


def recounted(docs: DataFrame, shards: list, scratch: Scratch, piece: int) -> DataFrame:
    """(lang, source, shard, piece, counts): slots of some shards, written."""
    packed = []
    for r in shards:
        own = [t.encode() for t in r["terms"]]
        packed.append((r["lang"], r["shard"], r["shards"], b"".join(own), np.cumsum([0, *map(len, own)]).astype(np.int32), bytes(r["tables"])))
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        import pyarrow as pa

        tables = {(lang, k): (PerfectHash.read(data), own, at) for lang, k, _, own, at, data in sent.value}
        number = {x[0]: x[2] for x in sent.value}
        slots: dict[tuple, np.ndarray] = {}
        bytes_read = 0

        def rows():
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            for (lang, source, k), v in slots.items():
                cut = [(i // piece, v[i : i + piece]) for i in range(0, len(v), piece)]
                out = [(lang, source, k, i, x.tobytes()) for i, x in cut if x.any()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["lang", "source", "shard", "piece", "counts"])
            slots.clear()

        for batch in batches:
            for part in sliced(batch, 2):
                groups: dict[tuple, Counter] = {}
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    if lang in number:
                        groups.setdefault((lang, source), Counter()).update(terms(text))
                for (lang, source), c in groups.items():
                    words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
                    h = hashed(words)
                    shard = ((h >> U(20)) % U(number[lang])).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    for some in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1):
                        if not len(some) or (lang, int(shard[some[0]])) not in tables:
                            continue
                        k = int(shard[some[0]])
                        table, own, at = tables[lang, k]
                        found = table.slots(h[some])
                        starts, ends = at[found].tolist(), at[found + 1].tolist()
                        same = np.fromiter((s >= 0 and own[a:z] == words[i] for s, a, z, i in zip(found.tolist(), starts, ends, some.tolist())), bool, len(some))
                        if same.any():
                            if (lang, source, k) not in slots:
                                slots[lang, source, k] = np.zeros(len(at) - 1, np.int32)
                            slots[lang, source, k][found[same]] += n[some[same]]  # slots of different terms differ
                    if sum(map(len, slots.values())) > HELD:
                        yield from rows()
                bytes_read += part.nbytes
                if bytes_read > 1 << 30:  # 32 bits hold what so many bytes can count
                    yield from rows()
                    bytes_read = 0
        yield from rows()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard long, piece long, counts binary")
    out = scratch.write(summed(counted, ["lang", "source", "shard", "piece"], np.int32), "counts")
    sent.destroy()
    return out


def summed(parts: DataFrame, keys: list[str], kind: type = np.int64) -> DataFrame:
    """Slot arrays of a kind added up by key in 64 bits, one after another."""
    n = len(keys)

    def run(batches):
        import pyarrow as pa

        def row(key, total):
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in key), pa.array([total.tobytes()], pa.binary())], names=[*keys, "counts"])

        key = total = None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(r[n], kind).astype(np.int64)
                if r[:n] == key:
                    total = total + own
                    continue
                if key is not None:
                    yield row(key, total)
                key, total = r[:n], own
        if key is not None:
            yield row(key, total)

    types = {"lang": "string", "source": "string", "shard": "long", "piece": "long"}
    return parts.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "counts").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", counts binary")


def share(c: np.ndarray, whole: int) -> np.ndarray:
    """1 + 10**9 * (c + 2) // whole, exactly."""
    rest, out = c + 2, np.zeros(len(c), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): both orders of all pairs of sources of a language, summed over shards; groups: lang, source, shard, piece, counts, whole."""
    many = groups.filter("shard = 0 AND piece = 0").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    dealt = groups.join(many, "lang").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    keys = ["lang", "shard", "piece", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "source").select(*keys, "source", "own", "whole", "counts")

    def run(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (lang, _, _, i, j), own in itertools.groupby(rows, key=lambda r: r[:5]):
            own = list(own)
            p = [share(np.frombuffer(r[8], np.int64), r[7]) for r in own]
            out = []
            for x, y in itertools.combinations(range(len(own)), 2):
                if i == j or own[x][6] != own[y][6]:
                    out.append((own[x][5], own[y][5], int(divergence(p[x], p[y]).sum())))
            a, b, v = (list(x) for x in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * 2 * len(out), pa.string()), pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(v + v, pa.int64())], names=["lang", "source", "item", "value"])

    return dealt.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): of every group and piece, the `top` terms at most that diverge upwards most; langs: lang, shard, piece, counts, whole, terms.

    A piece's row of its language comes first, those of its groups follow one by one.
    """
    rows = langs.select("lang", "shard", "piece", F.lit(None).cast("string").alias("source"), "whole", "counts", "terms")
    rows = rows.unionByName(groups.select("lang", "shard", "piece", "source", "whole", "counts", F.lit(None).cast("array<string>").alias("terms")))
    dealt = rows.repartition("lang", "shard", "piece").sortWithinPartitions("lang", "shard", "piece", F.col("source").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        q = own = None
        for batch in batches:
            out = []
            for lang, _, _, source, whole, counts, words in zip(*(c.to_pylist() for c in batch.columns)):
                c = np.frombuffer(counts, np.int64)
                p = share(c, whole) if len(c) else c
                if source is None:
                    q, own = p, [t.encode() for t in words]
                    continue
                f = divergence(p, q)
                some = np.nonzero((c > 0) & (p > q))[0]
                if len(some) > top:
                    some = some[f[some] >= np.partition(f[some], -top)[-top]]
                best = sorted((-int(f[s]), own[s]) for s in some.tolist())[:top]
                out += [(lang, source, t.decode(), -v) for v, t in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

    return dealt.select("lang", "shard", "piece", "source", "whole", "counts", "terms").mapInArrow(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank); docs: text, lang, source."""
    every = plain(docs)
    kept = document_counts(every).groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_docs)
    kept = scratch.write(kept.select("lang", "term"), "kept")
    groups = scratch.write(every.select("lang", "source").distinct(), "groups")
    sizes = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").na.fill(0, ["v"])
    sizes = scratch.write(sizes.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / SHARD))), "sizes")
    made = scratch.write(shards(kept, sizes), "shards")

    # blocks of shards; a broadcast has the shards of one
    size = made.agg(F.sum(F.octet_length("tables") + F.aggregate("terms", F.lit(0), lambda a, t: a + F.octet_length(t) + 4))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    counts = []
    for i in range(n):
        block = made.filter((F.pmod(F.xxhash64("lang", "shard"), F.lit(n)) == i) & (F.col("slots") > 0)).collect()
        counts.append(recounted(every, block, scratch, PIECE))
    counts = reduce(DataFrame.unionByName, counts)

    # every language has piece 0 of shard 0 at least
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("slots") / PIECE) - 1, F.lit(0)))
    cut = made.select("lang", "shard", "slots", "terms", F.explode(pieces).alias("piece"))
    cut = cut.select("lang", "shard", "piece", F.slice("terms", F.col("piece").cast("int") * PIECE + 1, PIECE).alias("terms"))
    cut = scratch.write(cut.withColumn("slots", F.size("terms")), "pieces")
    blank = F.unhex(F.repeat(F.lit("00"), 8 * F.col("slots")))
    grid = groups.join(cut.select("lang", "shard", "piece", "slots"), "lang").join(counts, ["lang", "source", "shard", "piece"], "left").withColumn("counts", F.coalesce("counts", blank))
    grid = scratch.write(grid, "grid")
    total = scratch.write(summed(grid, ["lang", "shard", "piece"]), "total")

    def added(df: DataFrame, keys: list[str]) -> DataFrame:
        """N + 2 V of each key."""
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array([int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in b.column(len(keys))], pa.int64())], names=[*keys, "n"])

        ns = df.select(*keys, "counts").mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))
        return df.join(ns, keys).join(sizes.select("lang", "v"), "lang").withColumn("whole", F.col("n") + 2 * F.col("v"))

    shared = scratch.write(added(grid, ["lang", "source"]), "shared")
    langs = added(total, ["lang"]).join(cut.select("lang", "shard", "piece", "terms"), ["lang", "shard", "piece"])
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = pair_sums(shared).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    found = top_terms(shared, langs, top).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(cols).unionByName(found.select(cols))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, c, CAST(1 + 1000000000 * CAST(c + 2 AS HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM grid JOIN sizes USING (lang)),
q AS (
  SELECT lang, term, CAST(1 + 1000000000 * CAST(sum(c) + 2 AS HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS BIGINT) AS q FROM grid JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""}
