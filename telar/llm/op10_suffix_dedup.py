"""Exact substring removal: every byte covered by a string of LENGTH bytes that also starts elsewhere.

1. Each window of LENGTH bytes is assigned to its anchor, the least hash among its GRAM-byte grams;
   equal windows have equal anchors. A run of windows with one anchor is a segment (the bytes of all
   its windows), so each window start of the corpus lies in exactly one segment.
2. Segments that occur more than once are kept once, with their number of copies; a segment that is
   alone with its anchor, or shares neither the half window before the anchor's gram nor the half
   after it with another one, can hold no repeated window and goes no further.
3. The rest meets by anchor in shards. A shard's segments are suffix-sorted; on the
   Burrows-Wheeler transform, intervals are expanded breadth-first by backward extension, from SEED
   characters up; each step finds the places in suffix order where the common prefix has just that
   length, and the expansion stops at LENGTH. What is not parted by then has LENGTH bytes in common:
   a start is repeated where the copies of its interval add up to two or more.
4. Starts go back to every document that holds the segment; covered bytes are joined and removed.

No anchor is gathered whole if it has more than `widest` bytes of distinct segments: these are cut by the
place of their windows before the anchor's gram (CLASSES), and what all windows of a class have in common,
up to nearly the whole window, parts the anchor into shards by longer context; equal windows stay together.
Shards that are still too wide are cut finer, in the end to single windows, of which equal ones are one.

Documents meet by a 128-bit hash of id and text, segments by two 64-bit hashes. Null or empty text: 0
bytes. Each row is a document of its own, so repeated rows repeat each other's strings. Columns other than
id and text are left out, so they cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.llm.common import IdFilter, Scratch, field, map_texts, read, sliced

GRAM, SEED, PACK = 32, 14, 7
CLASSES = (16, 400)  # into so many classes the windows of a wide anchor are cut, first and then
SHARD_BYTES = 1_500_000
U = np.uint64


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    h = (b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    width, mul = 1, 0xD6E8FEB86659FD93
    while width < GRAM:
        h = h[:-width] * U(mul) + h[width:]
        width, mul = 2 * width, mul * mul & 0xFFFFFFFFFFFFFFFF
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def least_places(h: np.ndarray, m: int) -> np.ndarray:
    """For each run of m values, the place of the least one (by its upper 40 bits; the first of equals)."""
    out = []
    for a in range(0, len(h) - m + 1, 1 << 22):
        part = h[a : a + (1 << 22) + m - 1]
        key = (part & ~U(0xFFFFFF)) | np.arange(len(part), dtype=U)
        rows = -(-len(part) // m)
        padded = np.full(rows * m, ~U(0))
        padded[: len(part)] = key
        grid, k = padded.reshape(rows, m), len(part) - m + 1
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        out.append((np.minimum(tail[:k], head[m - 1 : m - 1 + k]) & U(0xFFFFFF)).astype(np.int64) + a)
    return np.concatenate(out)


def segments(data: bytes, length: int) -> list[dict]:
    """anchor, seg (hash of its bytes), lo, n (bytes), place of the gram in it, and hashes of the half windows on either side of the gram."""
    import xxhash

    if len(data) < length:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8))
    at = least_places(h, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]])
    half, hash64, hash32, out = (length - GRAM + 1) // 2, xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest, []
    for lo, z, p, anchor in zip(first.tolist(), last.tolist(), at[first].tolist(), h[at[first]].view(np.int64).tolist()):
        hi = z - 1 + length
        out.append({
            "anchor": anchor, "seg": hash64(data[lo:hi]) - (1 << 63), "lo": lo, "n": hi - lo, "at": p - lo,
            "left": hash32(data[p - half : p]) - (1 << 31) if p - half >= lo else None,
            "right": hash32(data[p + GRAM : p + GRAM + half]) - (1 << 31) if p + GRAM + half <= hi else None,
        })
    return out


def suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of sym (0 to 256) sorted by `depth` symbols at least, and where in that order a new SEED-symbol prefix begins."""
    n = len(sym)
    padded = np.concatenate([sym, np.zeros(PACK, sym.dtype)]).astype(U)
    key = np.zeros(n, U)
    for j in range(PACK):
        key = (key << U(9)) | padded[j : n + j]
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k, seed = PACK, new
    while k < depth:
        open_ = ~(new & np.concatenate([new[1:], [True]]))  # places in groups of two or more
        slots = np.flatnonzero(open_)
        if len(slots):
            p = sa[slots]
            nxt = np.where(p + k < n, rank[np.minimum(p + k, n - 1)] + 1, 0)
            both = rank[p] * (n + 1) + nxt
            order = np.argsort(both, kind="stable")
            sa[slots], both = p[order], both[order]
            new[slots] = np.concatenate([[True], both[1:] != both[:-1]])
            rank[sa[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        k *= 2
        if k == SEED:
            seed = new.copy()
    return sa, seed


def parted(sa: np.ndarray, sym: np.ndarray, seed: np.ndarray, length: int) -> np.ndarray:
    """Whether each place in suffix order has fewer than `length` symbols in common with the one before.

    Breadth-first: intervals of strings of d symbols, extended backward by each symbol before them,
    give the intervals of d + 1; one whose end isn't marked yet marks it (the common prefix there is
    d) and goes on. Marks made before never come again, so all steps together are linear.
    """
    n = len(sa)
    bwt = sym[sa - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix that is longer by the symbol before stands
    back[by_symbol] = np.arange(n)
    mark = np.concatenate([seed, [True]])
    lo = np.flatnonzero(seed)
    hi = np.concatenate([lo[1:], [n]])
    for _ in range(SEED, length):
        one = hi - lo == 1
        single = lo[one]
        single = single[bwt[single] > 0]  # 0 parts segments
        new_lo, new_hi = [back[single]], [back[single] + 1]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo
            which = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(which)) + np.repeat(lo - np.cumsum(size) + size, size)
            key = which * 512 + bwt[at]
            order = np.argsort(key, kind="stable")
            key, to = key[order], back[at[order]]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.concatenate([begin[1:], [len(key)]]) - 1
            real = key[begin] % 512 > 0
            new_lo.append(to[begin[real]])
            new_hi.append(to[end[real]] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~mark[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        mark[hi] = True
    return mark[:-1]


def repeated_starts(parts: list[bytes], copies: list[int], length: int) -> list[list[int]]:
    """For each segment, the runs [from, to, ...] of starts whose string of `length` bytes occurs twice or more."""
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size + 1) - size - 1
    n = int((size + 1).sum())
    sym = np.zeros(n, np.uint16)
    for p, a in zip(parts, first.tolist()):
        sym[a : a + len(p)] = np.frombuffer(p, np.uint8) + np.uint16(1)
    sa, seed = suffix_order(sym, length)
    group = np.cumsum(parted(sa, sym, seed, length)) - 1
    own = np.repeat(np.arange(len(parts)), size + 1)
    full = np.arange(n) - first[own] + length <= size[own]
    weight = np.where(full, np.array(copies)[own], 0)[sa]
    again = np.zeros(n + 1, bool)
    again[sa] = full[sa] & (np.bincount(group, weight)[group] >= 2)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again]).astype(np.int8)))
    out: list[list[int]] = [[] for _ in parts]
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
        k = int(own[a])
        out[k] += [a - int(first[k]), z - int(first[k])]
    return out


PIECES = "anchor long, seg long, copies long, at int, data binary"


def _find(pieces: DataFrame, length: int) -> DataFrame:
    """pieces: PIECES; gives anchor, seg, starts of segments with repeated starts."""
    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "seg")

    def run(batches):
        import pyarrow as pa

        names = ["anchor", "seg", "starts"]

        def solve(held):
            got = [(a, s, r) for (a, s, *_), r in zip(held, repeated_starts([h[3] for h in held], [h[2] for h in held], length)) if r]
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=names)

        held, total = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and total >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield solve(held)

    return dealt.select("anchor", "seg", "copies", "data").mapInArrow(run, "anchor long, seg long, starts array<int>")


def cut_by_context(data: bytes, at: int, length: int, classes: int) -> list[tuple[int, bytes, bytes]]:
    """(offset, bytes, common part) of the parts of a segment whose windows begin in the same class of distances to the gram at `at`.

    A window that holds the gram begins length - GRAM bytes before it at most. The windows of a class share the
    bytes from the last one's begin to the first one's end.
    """
    most, out = length - GRAM, []
    step = -(-(most + 1) // classes)
    for k in range(-(-(most + 1) // step)):
        lo, hi = max(at - most + k * step, 0), min(at - most + (k + 1) * step - 1, at, len(data) - length)  # first and last begin
        if lo <= hi:
            common = data[at - most + min((k + 1) * step - 1, most) : at - most + k * step + length]
            out.append((lo, data[lo : hi + length], k.to_bytes(4, "little") + common))
    return out


def _find_wide(pieces: DataFrame, length: int, widest: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """The same as _find() for anchors with more than `widest` bytes of segments, by shards of longer context."""
    parted = f"{PIECES}, own long, part long, off int"

    def run(batches):
        import pyarrow as pa
        import xxhash

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in parted.split(", ")]
        for batch in batches:
            for anchor, seg, copies, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                hash64 = lambda x: xxhash.xxh3_64_intdigest(x, anchor & 0xFFFFFFFF) - (1 << 63)  # noqa: B023, E731
                out = [(anchor, seg, copies, at - off, own, hash64(common), hash64(own + b"part"), off) for off, own, common in cut_by_context(data, at, length, CLASSES[level])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    parts = scratch.write(pieces.select(*[c.split()[0] for c in PIECES.split(", ")]).mapInArrow(run, parted), "parts")
    inner = parts.groupBy(F.col("own").alias("anchor"), F.col("part").alias("seg")).agg(F.sum("copies").alias("copies"), F.min("at").alias("at"), F.first("data").alias("data"))
    found = _find_all(inner, length, widest, scratch, level + 1)
    found = parts.select("anchor", "seg", "own", "part", "off").join(found.select(F.col("anchor").alias("own"), F.col("seg").alias("part"), "starts"), ["own", "part"])
    return found.select("anchor", "seg", F.transform("starts", lambda x: x + F.col("off")).alias("starts"))


def _find_all(pieces: DataFrame, length: int, widest: int, scratch: Scratch, level: int = 0) -> DataFrame:
    pieces = scratch.write(pieces, "pieces")
    if level == len(CLASSES):  # single windows, of which equal ones are one: an anchor can hold several only if their hashes are equal
        return _find(pieces, length)
    wide = pieces.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("b")).filter(F.col("b") > widest).select("anchor")
    if wide.isEmpty():
        return _find(pieces, length)
    wide = scratch.write(wide, "wide")
    return _find(pieces.join(wide, "anchor", "left_anti"), length).unionByName(_find_wide(pieces.join(wide, "anchor", "left_semi"), length, widest, scratch, level))


def find_repeats(docs: DataFrame, scratch: Scratch, length: int = 400, widest: int = 48 << 20) -> tuple[DataFrame, DataFrame]:
    """docs: key, text. (key, lo, starts) for every segment with repeated starts, which are relative to lo."""
    fields = [field("segs", "array<struct<anchor:long,seg:long,lo:int,n:int,left:int,right:int>>")]
    fields[0] = T.StructField("segs", T.ArrayType(T.StructType([T.StructField(c, T.LongType() if c in ("anchor", "seg") else T.IntegerType()) for c in ("anchor", "seg", "lo", "n", "left", "right")])))
    segs = map_texts(docs, "text", ["key"], fields, lambda: lambda texts: [[segments(t.encode(), length) if t else [] for t in texts]])
    segs = scratch.write(segs.select("key", F.inline("segs")), "segments")

    distinct = segs.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), *[F.max(c).alias(c) for c in ("n", "left", "right")])
    distinct = scratch.write(distinct, "distinct")
    often = distinct.groupBy("anchor").agg(F.sum("copies").alias("total")).filter("total > 1").select("anchor")
    meet = scratch.write(distinct.join(often, "anchor"), "meet")
    scratch.drop(distinct)
    half = lambda c: meet.filter(F.col(c).isNotNull()).groupBy("anchor", c).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", c, F.lit(True).alias(f"in_{c}"))
    kept = meet.join(half("left"), ["anchor", "left"], "left").join(half("right"), ["anchor", "right"], "left")
    kept = scratch.write(kept.filter("copies > 1 OR in_left OR in_right").select("anchor", "seg", "copies", "key"), "kept")

    # the bytes of each kept segment are cut from one document that holds it
    wanted = kept.groupBy("key").agg(F.collect_list(F.struct("anchor", "seg", "copies")).alias("wanted"))
    held = IdFilter(kept, "key").flag(docs, F.col("key"), "maybe").filter("maybe").join(wanted, "key").select("text", "wanted")

    def cut(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in sliced(batch, 0):
                out = []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data, by = (text or "").encode(), {(w["anchor"], w["seg"]): w for w in want}
                    for s in segments(data, length):
                        if w := by.pop((s["anchor"], s["seg"]), None):
                            out.append((w["anchor"], w["seg"], w["copies"], s["at"], data[s["lo"] : s["lo"] + s["n"]]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["anchor", "seg", "copies", "at", "data"])

    starts = scratch.write(_find_all(held.mapInArrow(cut, PIECES), length, widest, scratch), "starts")
    scratch.drop(meet)
    some = IdFilter(starts, "seg", buckets=1024).flag(segs.select("key", "anchor", "seg", "lo"), F.col("seg"), "maybe").filter("maybe").drop("maybe")
    return some.join(starts, ["anchor", "seg"]).select("key", "lo", "starts"), segs


def covered(lo_starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the repeated strings."""
    runs = sorted((r["lo"] + r["starts"][i], r["lo"] + r["starts"][i + 1] - 1 + length) for r in lo_starts for i in range(0, len(r["starts"]), 2))
    out: list[tuple[int, int]] = []
    for a, z in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 400, outputs: bool = True, **options) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans and, with outputs, spans and kept (bytes), else kept_sha256."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))))
    found, _ = find_repeats(src.select("key", "text"), scratch, length, **options)
    per = scratch.write(found.groupBy("key").agg(F.collect_set(F.struct("lo", "starts")).alias("repeats")), "repeats")
    flagged = IdFilter(per, "key").flag(src, F.col("key"), "maybe")
    fields = [field(c, "long") for c in ("n_bytes", "n_removed", "n_spans")]
    fields += [field("spans", "array<struct<a:int,z:int>>"), field("kept", "binary")] if outputs else [field("kept_sha256", "string")]

    def one(text, repeats):
        data = (text or "").encode()
        spans = covered(repeats or [], length)
        left, at = [], 0
        for a, z in spans:
            left.append(data[at:a])
            at = z
        rest = b"".join([*left, data[at:]])
        row = [len(data), len(data) - len(rest), len(spans)]
        return [*row, [{"a": a, "z": z} for a, z in spans], rest] if outputs else [*row, hashlib.sha256(rest).hexdigest()]

    def run(batches):
        import pyarrow as pa

        from telar.llm.common import to_arrow

        types = [to_arrow(f.dataType) for f in fields]
        for batch in batches:
            for part in sliced(batch, 1):
                rows = [one(t, r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["id", *(f.name for f in fields)])

    schema = T.StructType([src.schema["id"], *fields])
    clear = flagged.filter(~F.col("maybe")).select("id", "text", F.lit(None).cast(per.schema["repeats"].dataType).alias("repeats")).mapInArrow(run, schema)
    mixed = flagged.filter("maybe").join(per, "key", "left").select("id", "text", "repeats").mapInArrow(run, schema)
    return clear.unionByName(mixed).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), Scratch(spark), outputs=False)


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
