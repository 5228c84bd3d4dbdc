"""Benchmark decontamination by an FM-index of every training shard.

A shard is a slice of a task's documents. Its sequence holds the runs of words that occur in some
phrase (a phrase can lie in no other place; shorter runs than the shortest phrase are left out), with
a separator after each. It is suffix-sorted by prefix doubling; the Burrows-Wheeler transform goes
into a wavelet matrix; all phrases are searched backward at once by its ranks; occurrences are
located by walking to sampled suffix positions; their word spans are merged.

Phrases are made once, as arrays of integers, and broadcast in blocks of items that have about
`block_words` words together; with one block (the usual case) nothing is shuffled, with more their spans
are joined by document. An item is one block's, however long.

Null or empty text: no words, no hits. Items with null or wordless text have no window. Several rows of
one item_id are one item; rows without one are the item `None`. Every row gives a row. Columns of `keep` that bear a new column's name are
replaced in decontaminate().
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import Scratch, field, map_texts, read

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Lower case for A-Z, a space for whatever stands in no word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling (values: 0 or more)."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    k = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        k *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence of small integers, many at a time."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (seq >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one)]).astype(np.int32)
            zeros = len(seq) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of sym[i] before pos[i]."""
        lo, hi = np.zeros_like(pos), pos
        for b, ones, zeros in self.levels:
            up = ((sym >> b) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return hi - lo

    def symbol(self, pos: np.ndarray) -> np.ndarray:
        sym = np.zeros_like(pos)
        for b, ones, zeros in self.levels:
            one = ones[pos + 1] - ones[pos]
            sym |= one.astype(sym.dtype) << b
            pos = np.where(one == 1, zeros + ones[pos], pos - ones[pos])
        return sym


class FMIndex:
    """Counts and places of phrases in runs of symbols (1 and above)."""

    def __init__(self, runs: list[np.ndarray], top: int, sample: int = 8):
        starts = np.cumsum([0] + [len(r) + 1 for r in runs])
        n = int(starts[-1])
        seq = np.zeros(n, np.int64)
        place = np.zeros(n, np.int64)  # within its run
        for r, a in zip(runs, starts.tolist()):
            seq[a : a + len(r)] = r
            place[a : a + len(r) + 1] = np.arange(len(r) + 1)
        # each separator sorts by its own place, so that no comparison goes beyond the run
        sa = suffix_array(np.where(seq == 0, np.cumsum(seq == 0) - 1, seq + len(runs)))
        bwt = seq[sa - 1]
        self.wavelet = WaveletMatrix(bwt, int(top).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        kept = place[sa] % sample == 0
        self.sampled = kept
        self.sample_no = np.cumsum(kept) - 1
        self.positions = sa[kept]
        self.n, self.starts = n, starts

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase; phrases: one a row, all of one length."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            sym = phrases[live, k].astype(np.int64)
            lo[live] = self.before[sym] + self.wavelet.rank(sym, lo[live])
            hi[live] = self.before[sym] + self.wavelet.rank(sym, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence: step back to a sampled suffix (a run's first always is one)."""
        out, at, steps, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled[at[todo]]
            hit = todo[done]
            out[hit] = self.positions[self.sample_no[at[hit]]] + steps
            todo = todo[~done]
            sym = self.wavelet.symbol(at[todo])
            at[todo] = self.before[sym] + self.wavelet.rank(sym, at[todo])
            steps += 1
        return out


class Phrases:
    """Distinct windows of the items, by length, and which items each comes from (of phrase p: owners[at[p] : at[p + 1]])."""

    def __init__(self, items: Iterable[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        found: dict[int, list] = {}
        for name, text in items:
            k = number.setdefault(str(name), len(number))
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")), np.int32)
            if n := min(window, len(ids)):
                own = np.lib.stride_tricks.sliding_window_view(ids, n)
                found.setdefault(n, []).append((own, np.full(len(own), k, np.int32)))
        self.items, self.least, self.groups = list(number), min(found, default=0), []
        for own in map(found.__getitem__, sorted(found)):
            phrases, which = np.unique(np.concatenate([p for p, _ in own]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate([k for _, k in own])], 1), axis=0)
            self.groups.append((phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1]))

    def find(self, texts: list) -> list[list]:
        """n_words, hit word spans, hit character spans and items of every text: one shard."""
        get, runs, where, n_words = self.vocabulary.get, [], [], []
        for d, text in enumerate(texts):
            ws = words(text) if text else []
            n_words.append(len(ws))
            if len(ws) < self.least or not self.least:
                continue
            ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if z - a >= self.least:
                    runs.append(ids[a:z])
                    where.append((d, a))
        spans, items = [[] for _ in texts], [set() for _ in texts]
        if runs:
            index = FMIndex(runs, len(self.vocabulary))
            of_doc, of_word = np.array(where).T
            for phrases, first, owners in self.groups:
                lo, hi = index.search(phrases)
                which = np.repeat(np.arange(len(lo)), hi - lo)
                if not len(which):
                    continue
                rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                at = index.locate(rows)
                run = np.searchsorted(index.starts, at, side="right") - 1
                doc, start = of_doc[run], of_word[run] + at - index.starts[run]
                for d, a in zip(doc.tolist(), start.tolist()):
                    spans[d].append((a, a + phrases.shape[1]))
                for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    items[d].update(owners[first[p] : first[p + 1]].tolist())
        merged = [merge(s) for s in spans]
        chars = [[(at[a][0], at[z - 1][1]) for a, z in m] if m and (at := [x.span() for x in WORD.finditer(fold(t))]) else [] for m, t in zip(merged, texts)]
        pairs = lambda rows: [[{"a": a, "z": z} for a, z in r] for r in rows]
        return [n_words, pairs(merged), pairs(chars), [[self.items[k] for k in s] for s in items]]


def fold(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


SPANS = "array<struct<a:int,z:int>>"


def merged_by_key(parts: DataFrame, key: str) -> DataFrame:
    """(key, hits, cuts, items) of the blocks' rows of each document: the union of their spans, and their items."""
    per = parts.groupBy(key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "cuts", "items")])

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([pa.field("a", pa.int32()), pa.field("z", pa.int32())]))
        union = lambda column: pa.array([[{"a": a, "z": z} for a, z in merge([(s["a"], s["z"]) for s in row])] for row in column.to_pylist()], spans)
        for b in batches:
            items = pa.array([list(dict.fromkeys(row)) for row in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), union(b.column(1)), union(b.column(2)), items], names=[key, "hits", "cuts", "items"])

    return per.mapInArrow(run, per.schema)


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_words: int = 500_000, scratch: Scratch | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """`keep` (all) columns of docs, and n_words, hits (word spans), cuts (character spans to remove), items (ids as text)."""
    keep = docs.columns if keep is None else keep
    size = items.agg(F.sum(F.size(F.regexp_extract_all(item_text, F.lit(WORD.pattern), F.lit(0))))).first()[0] or 0
    blocks = 1 + size // block_words
    fields = [field("n_words", "int"), field("hits", SPANS), field("cuts", SPANS), field("items", "array<string>")]

    def pass_over(df, kept, b):
        own = items.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).select(item_id, item_text)
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(map(tuple, own.toLocalIterator()), window))  # bounded by block_words
        return map_texts(df, text_col, kept, fields, lambda: shared.value.find)

    if blocks == 1:
        return pass_over(docs, keep, 0)
    scratch = scratch or Scratch(docs.sparkSession)
    key = "_".join(["key", *docs.columns])  # a name that no column has
    keyed = docs.withColumn(key, F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in docs.columns]), 256))
    parts = [scratch.write(pass_over(keyed, [key], b).filter(F.size("hits") > 0), f"block{b}") for b in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = merged_by_key(every, key)
    base = map_texts(keyed, text_col, [*keep, key], fields[:1], lambda: lambda texts: [[len(words(t)) if t else 0 for t in texts]])
    out = base.drop("hits", "cuts", "items").join(every, key, "left").drop(key)
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("hits", "cuts", "items")})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["z"] - s["a"])
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "cuts")


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {}
