"""Merkle manifest of a corpus: digests, roots by language and over all, proofs, and a check of every row.

Leaves are placed by bitmaps, not by sorting rows. Each language has a compressed bitmap of its ids: words of 64
ids, empty ones left out, in blocks of 1024 words. A word holds its bits (merged by bit_or, with partial results
before the shuffle) and how many rows it has; the popcount directory holds how many rows stand before each block
and before each word in its block. A row's rank is what stands before its word and the popcount of the lower bits
in it. So rows of a language are never gathered or sorted: windows go over the at most 1024 words of a block, and
the running sum over blocks goes by ranges of the directory (running()).

Ranks give slots: FAN leaves make a slot array, keyed by language and chunk, which one task reduces ten levels at a
time; the tops of chunks are the next level's leaves. Then the way down: siblings above a chunk are joined to it, and
each slot adds its own. Chunks have at most FAN rows, so any language may hold nearly all rows.

Ids that repeat within a language stand side by side, ordered by leaf; only rows of words with repeated ids are
numbered among themselves, by ranges. Rows without an id come first in their language. Null in any column is "-".
Other columns are left out, so they cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.llm.common import Scratch, field, read, to_arrow

FAN = 1024
NO_ID = -(1 << 60)  # the block of rows without an id, before all others


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def part(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, changed): key orders the languages, null first; changed is the leaf after the tampering."""
    n = F.col("n_chars").cast("decimal(20,0)")
    digest = lambda c: F.sha2(F.concat(part(F.col("doc_id")), part(F.col("source")), part(F.col("lang")), part(c), part(F.col("text"))), 256)
    leaf = digest(n)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & n.isNotNull()
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(tampered, digest(n + 1)).alias("changed"))


def running(df: DataFrame, order: list[str], value: Column, name: str, scratch: Scratch) -> DataFrame:
    """df with the sum of value over all rows before, in the order of columns that name a row.

    Rows are dealt by ranges, summed by range, and the sums of earlier ranges are added: no task has more than a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()).withColumn("value_", value)
    ranged = scratch.write(ranged, name).withColumn("range_", F.shiftright("at_", 33))
    totals = ranged.groupBy("range_").agg(F.sum("value_").alias("total_"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", F.coalesce(F.sum("total_").over(upto(Window.orderBy("range_"))), F.lit(0)).alias("start_"))
    inside = F.coalesce(F.sum("value_").over(upto(Window.partitionBy("range_").orderBy("at_"))), F.lit(0))
    return ranged.withColumn(name, inside).join(F.broadcast(starts), "range_").withColumn(name, F.col(name) + F.col("start_")).drop("range_", "at_", "value_", "start_")


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with n, the number of rows of their key, and rank, from 0 by key in the order of doc_id (null first), then leaf."""
    bit = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")
    block = F.coalesce(F.shiftright("doc_id", 16), F.lit(NO_ID))
    placed = rows.withColumns({"block": block, "word": F.coalesce(F.shiftright("doc_id", 6).bitwiseAND(1023), F.lit(0)), "bit": bit})
    place = ["key", "block", "word"]

    words = placed.groupBy(place).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"), F.count(F.lit(1)).alias("rows"))
    words = scratch.write(words, "words")
    blocks = running(words.groupBy("key", "block").agg(F.sum("rows").alias("rows")), ["key", "block"], F.col("rows"), "before", scratch)
    blocks = scratch.write(blocks, "blocks")
    keys = blocks.groupBy("key").agg(F.min("before").alias("first"), F.sum("rows").alias("n"))
    blocks = blocks.join(keys, "key").select("key", "block", "n", (F.col("before") - F.col("first")).alias("before"))
    in_block = F.sum("rows").over(Window.partitionBy("key", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    directory = words.withColumn("in_block", F.coalesce(in_block, F.lit(0))).join(blocks, ["key", "block"])
    directory = directory.select(*place, "bits", "n", (F.col("before") + F.col("in_block")).alias("before"), (F.col("rows") > F.bit_count("bits")).alias("repeats"))
    directory = scratch.write(directory, "directory")

    lower = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit"))))
    plain = placed.join(directory.filter("NOT repeats"), place).withColumn("rank", F.col("before") + F.bit_count(lower))
    some = placed.join(directory.filter("repeats"), place).withColumn("row", F.monotonically_increasing_id())
    some = running(scratch.write(some, "repeats"), [*place, "bit", "leaf", "row"], F.lit(1), "position", scratch)
    first = some.groupBy(place).agg(F.min("position").alias("first"))
    some = some.join(first, place).withColumn("rank", F.col("before") + F.col("position") - F.col("first"))
    keep = [*rows.columns, "n", "rank"]
    return plain.select(keep).unionByName(some.select(keep))


def height(n: int) -> int:
    return (n - 1).bit_length()


def tree(hashes: list[str], levels: int) -> list[list[str]]:
    out = [hashes]
    for _ in range(levels):
        h = out[-1]
        out.append([sha("".join(h[i : i + 2])) for i in range(0, len(h), 2)])
    return out


def path(levels: list[list[str]], slot: int) -> str:
    """Siblings from a leaf of the levels up to their top: L or R and the digest, or N where a run has no other."""
    out = []
    for k, h in enumerate(levels[:-1]):
        i = (slot >> k) ^ 1
        out.append(("RL"[slot >> k & 1] + h[i]) if i < len(h) else "N")
    return ",".join(out)


def by_chunk(rows: DataFrame, columns: list[str], schema: list[T.StructField], emit: Callable[[list[tuple]], Iterator[tuple]], fan: int) -> DataFrame:
    """emit(slots) for every slot array: rows (key, n, chunk, slot, hash, ...) in the order of slots."""
    made = T.StructType(schema)

    def run(batches):
        import pyarrow as pa

        types = [to_arrow(f.dataType) for f in schema]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=made.names)
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held = []
        for _, slots in itertools.groupby(every, key=lambda r: (r[0], r[2])):
            held += emit(list(slots))
            if len(held) >= 4096:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    dealt = rows.withColumn("chunk", F.floor(F.col("rank") / fan)).withColumn("slot", F.col("rank") % fan)
    return dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "slot").select("key", "n", "chunk", "slot", "hash", *columns).mapInArrow(run, made)


def within(slots: list[tuple], fan: int) -> list[list[str]]:
    """The levels of a slot array: log2(fan), or fewer where the whole tree has no more."""
    return tree([r[4] for r in slots], min(height(slots[0][1]), fan.bit_length() - 1))


def build(rows: DataFrame, scratch: Scratch, fan: int) -> list[DataFrame]:
    """Tables (key, n, rank, hash) from the leaves to one row a key, each level the tops of the slot arrays of the one before."""
    schema = [field("key", "string"), field("n", "long"), field("rank", "long"), field("hash", "string")]

    def top(slots):
        key, n, chunk = slots[0][:3]
        yield key, -(-n // fan), chunk, within(slots, fan)[-1][0]

    levels, most = [rows], rows.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(levels) == 1:
        levels.append(scratch.write(by_chunk(levels[-1], [], schema, top, fan), "tops"))
        most = -(-most // fan)
    return levels


def paths(rows: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """(key, rank, above): what stands above each of rows; above: the same of their slot arrays."""
    schema = [field("key", "string"), field("rank", "long"), field("above", "string")]

    def down(slots):
        own = within(slots, fan)
        for r in slots:
            yield r[0], r[2] * fan + r[3], ",".join(filter(None, (path(own, r[3]), r[5])))

    return by_chunk(chunk_joined(rows, above, fan), ["above"], schema, down, fan)


def descend(levels: list[DataFrame], above: DataFrame, scratch: Scratch, fan: int) -> DataFrame:
    """(key, rank, above): what stands above each slot array of the leaves; above: (key, above) of the roots."""
    out = above.withColumn("rank", F.lit(0).cast("long"))
    for rows in reversed(levels[1:-1]):
        out = scratch.write(paths(rows, out, fan), "above")
    return out


def chunk_joined(rows: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("rank") / fan)).join(above.withColumnRenamed("rank", "chunk"), ["key", "chunk"]).drop("chunk")


def fold(leaf: str, steps: list[str]) -> str:
    for s in steps:
        leaf = sha(s[1:] + leaf) if s[0] == "L" else sha(leaf + s[1:])
    return leaf


def proofs(levels: list[DataFrame], above: DataFrame, groups: DataFrame, fan: int) -> DataFrame:
    """A row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = [field(n, "long" if n == "doc_id" else "boolean" if n == "verified" else "string") for n in names]

    def check(slots):
        own = within(slots, fan)
        for _, _, _, slot, leaf, up, doc_id, changed, subroot, root in slots:
            steps = [s for s in (path(own, slot) + "," + up).split(",") if s]
            folded = fold(changed or leaf, steps)
            yield doc_id, leaf, subroot, root, sha("".join(s[1:] for s in steps)), folded, folded == root

    return by_chunk(chunk_joined(levels[0], above.join(groups, "key"), fan), ["above", "doc_id", "changed", "subroot", "root"], schema, check, fan)


def merkle_manifest(docs: DataFrame, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """A row per row of docs (doc_id, source, lang, n_chars, text); fan, a power of two: slots of an array."""
    rows = scratch.write(leaves(docs), "leaves")
    placed = scratch.write(ranked(rows, scratch).withColumnRenamed("leaf", "hash"), "ranked")
    levels = build(placed, scratch, fan)

    subroots = running(levels[-1].select("key", F.col("hash").alias("subroot")), ["key"], F.lit(1), "rank", scratch)
    subroots = scratch.write(subroots, "subroots")
    n = subroots.count()
    over = scratch.write(subroots.select(F.lit("").alias("key"), F.lit(n).cast("long").alias("n"), F.col("rank").cast("long").alias("rank"), F.col("subroot").alias("hash")), "over")
    tops = build(over, scratch, fan)
    root = tops[-1].select("hash").first()
    start = tops[-1].select("key", F.lit("").alias("above"))
    own = paths(over, descend(tops, start, scratch, fan), fan).select("rank", "above")
    groups = scratch.write(subroots.join(own, "rank").withColumn("root", F.lit(root and root[0]).cast("string")), "groups")
    above = descend(levels, groups.select("key", "above"), scratch, fan)
    return proofs(levels, above, groups.select("key", "subroot", "root"), fan)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
#: crc32 is spelled out bit by bit: codes of 256 and more stand for a byte, -1 for a shift.
ORACLES = {
    "op12_merkle_manifest": r"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c:
      [CAST(256 + ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x:
    CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc FROM documents),
parts AS (
  SELECT doc_id, lang, xor(crc, 4294967295) % 7 = 0 AS tampered, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS after FROM marked),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
    sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
    sha256(before || coalesce(strlen(CAST(n_chars + tampered::INT AS VARCHAR)) || ':' || (n_chars + tampered::INT), '-') || after) AS changed FROM parts),
levels AS (
  SELECT lang, 0 AS k, list(leaf ORDER BY r) AS h FROM leaves GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM levels WHERE len(h) > 1),
subroots AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM levels WHERE len(h) = 1),
tops AS (
  SELECT 0 AS k, list(subroot ORDER BY g) AS h FROM subroots
  UNION ALL SELECT k + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM tops WHERE len(h) > 1),
steps AS (
  SELECT l.doc_id, v.k, l.r >> v.k AS i, v.h FROM leaves l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang WHERE len(v.h) > 1
  UNION ALL SELECT l.doc_id, 1000 + t.k, s.g >> t.k, t.h FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON len(t.h) > 1),
paths AS (
  SELECT doc_id, list(CASE WHEN h[xor(i, 1) + 1] IS NULL THEN 'N' WHEN i % 2 = 1 THEN 'L' || h[xor(i, 1) + 1] ELSE 'R' || h[xor(i, 1) + 1] END ORDER BY k) AS p FROM steps GROUP BY doc_id),
folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h[1] FROM tops WHERE len(h) = 1) AS root, coalesce(p.p, []) AS p, list_reduce(list_concat([l.changed], coalesce(p.p, [])), lambda a, x:
    CASE WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p ON p.doc_id = l.doc_id)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""}
