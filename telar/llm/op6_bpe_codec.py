"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash over bytes cuts every text into chunks that depend on content alone; a table of
   chunk fingerprints (no text) tells which chunks occur more than once in the corpus.
2. Each such shared chunk is encoded once, in the first text that holds it: not its ends, only the
   core between its first and last safe cut (a single space between printable ASCII characters, at
   which the pre-tokenizer always separates pieces).
3. Texts with shared chunks receive the cores' ids; what lies between is encoded. At every seam the
   window from the safe cut before it to the one behind it is encoded once more: where the ids don't
   agree, a window round the seam replaces them, which doubles until its own two seams agree. Texts
   without shared chunks are encoded where they are.
4. Ids are decoded by the vocabulary's bytes.

Only fingerprints, texts that hold shared chunks, and ids of cores are shuffled; which texts need the
shuffle is decided by a bitmap filter of fixed size and, behind it, an exact join.

Null or empty text: no ids, decoded to the empty text. Rows with the same id and text are the same
document and each gives a row. Columns other than id and text are left out, so they cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import IdFilter, Scratch, field, map_texts, read

BEYOND_LATIN = re.compile("[^\x00-\u024f]")
SAFE = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")


def cuts(data: bytes, mean_bits: int = 10, least: int = 256, window: int = 32) -> list[int]:
    """End of each content-defined chunk: where the rolling hash of the last `window` bytes has
    `mean_bits` zero bits, at least `least` bytes after the cut before, never inside a character."""
    n = len(data)
    if n <= least:
        return [n]
    b = np.frombuffer(data, np.uint8)
    h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    width, mul = 1, 0x01000193
    while width < window:  # h[i] covers `width` bytes that end at i
        nxt = h.copy()
        nxt[width:] += h[:-width] * np.uint32(mul)
        h, width, mul = nxt, width * 2, mul * mul & 0xFFFFFFFF
    h ^= h >> np.uint32(13)
    found = np.flatnonzero((h * np.uint32(2246822519)) >> np.uint32(32 - mean_bits) == 0) + 1
    out, last = [], 0
    for p in found.tolist():
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= least and n - p > 0:
            out.append(p)
            last = p
    return [*out, n]


def core(data: bytes) -> tuple[int, int]:
    """First and last safe cut of a chunk; (0, 0) if it has no two."""
    if (m := SAFE.search(data)) is None:
        return 0, 0
    end = len(data)
    while (p := data.rfind(b" ", 0, end)) > m.start():
        if 0x21 <= data[p - 1] <= 0x7E and p + 1 < len(data) and 0x21 <= data[p + 1] <= 0x7E:
            return m.start(), p
        end = p
    return 0, 0


class Codec:
    """Ids of a text as the tokenizers library gives them, and bytes of ids.

    Latin text is encoded by the rank merger of tiktoken, which takes a third of the time; it is used
    only if the file's ids are in the order of its merges, as the results are then equal.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for s, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(map(to_byte.__getitem__, s)) if all(c in to_byte for c in s) else s.encode()
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.names = [str(i) for i in range(size)]
        self.special, self.quick = [t["content"] for t in spec["added_tokens"]], None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if all(spec["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {self.bytes[i]: i for i in spec["model"]["vocab"].values() if i < 256 + len(merges)}
            self.quick = tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.quick and not BEYOND_LATIN.search(text) and not any(s in text for s in self.special):
            return self.quick(text)
        return self.library(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def with_cores(self, text: str, cores: dict[int, np.ndarray]) -> list[int]:
        """Ids of a text of which some chunks' cores are encoded already (by chunk number)."""
        data, parts, start, pend = text.encode(), [], 0, 0  # data[pend:] has no ids yet
        part = lambda a, z: parts.append((a, z, self.encode(data[a:z].decode()))) if a < z else None
        for k, end in enumerate(cuts(data)):
            if (ids := cores.get(k)) is not None:
                a, z = (start + x for x in core(data[start:end]))
                part(pend, a)
                parts.append((a, z, ids.tolist()))
                pend = z
            start = end
        part(pend, len(data))
        out: list[tuple[int, int, list[int]]] = []
        for a, z, ids in parts:
            if not out or self.agrees(data, out[-1][0], a, z):
                out.append((a, z, ids))
            else:
                first = out.pop()[0]
                out.append((first, z, self.repaired(data, first, a, z)))
        return list(chain.from_iterable(ids for _, _, ids in out))

    def agrees(self, data: bytes, a: int, x: int, z: int) -> bool:
        """Whether data[a:x] and data[x:z] may be encoded apart, seen from the nearest safe cuts on either side of x."""
        left, right = cut_before(data, a, x), cut_behind(data, x, z)
        return self.library(data[left:right].decode()) == self.encode(data[left:x].decode()) + self.encode(data[x:right].decode())

    def repaired(self, data: bytes, a: int, x: int, z: int, width: int = 256) -> list[int]:
        """Ids of data[a:z], whose parts do not agree at x: by a window round x that doubles until it agrees with the rest."""
        while True:
            left, right = cut_before(data, a, x - width), cut_behind(data, x + width, z)
            if (left == a or self.agrees(data, a, left, right)) and (right == z or self.agrees(data, left, right, z)):
                return self.encode(data[a:left].decode()) + self.library(data[left:right].decode()) + self.encode(data[right:z].decode())
            width *= 2


def cut_before(data: bytes, a: int, x: int) -> int:
    """The last safe cut between a and x, else a."""
    while (x := data.rfind(b" ", a + 1, max(x, a + 1))) > a:
        if SAFE.match(data, x):
            return x
    return a


def cut_behind(data: bytes, x: int, z: int) -> int:
    """The first safe cut between x and z, else z."""
    m = SAFE.search(data, x + 1, z + 1) if x < z else None
    return m.start() if m and m.start() < z else z


CODECS: dict = {}


def codec(path: str | None) -> Codec:
    return CODECS.get(path) or CODECS.setdefault(path, Codec(path))


def text_key(doc_id, text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(f"{doc_id}\n{text}".encode())


def encode_decode(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, outputs: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded) for every row or, with outputs=False, (id, n_tokens, ids_sha256, decoded_sha256)."""
    import xxhash

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # `key` names a document by id and text: rows that repeat share it
    src = src.withColumn("key", F.unhex(F.sha2(F.concat_ws("\n", F.col("id").cast("string"), "text"), 256)))

    def fingerprints():
        def f(texts):
            out = []
            for t in texts:
                data, a, row = t.encode(), 0, []
                for k, z in enumerate(cuts(data)):
                    chunk = data[a:z]
                    if core(chunk)[1]:
                        row.append({"k": k, "h": xxhash.xxh3_128_digest(chunk)})
                    a = z
                out.append(row)
            return [out]
        return f

    prints = map_texts(src, "text", ["key"], [field("chunks", "array<struct<k:int,h:binary>>")], fingerprints)
    prints = scratch.write(prints.select("key", F.explode("chunks").alias("c")).select("key", "c.k", "c.h"), "prints")
    shared = prints.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "k")).alias("at")).filter("n > 1")
    first = scratch.write(shared.select("h", "at.key", "at.k"), "first")

    def encode_cores():
        c = codec(tokenizer_path)

        def f(texts, wanted):
            out = []
            for t, ks in zip(texts, wanted):
                data = t.encode()
                ends = cuts(data)
                row = []
                for w in ks:
                    chunk = data[ends[w["k"] - 1] if w["k"] else 0 : ends[w["k"]]]
                    a, z = core(chunk)
                    row.append({"h": w["h"], "ids": np.array(c.encode(chunk[a:z].decode()), np.int32).tobytes()})
                out.append(row)
            return [out]
        return f

    def marked(keys):
        return IdFilter(keys, "key").flag(src, F.col("key"), "maybe")

    wanted = first.groupBy("key").agg(F.collect_list(F.struct("k", "h")).alias("wanted"))
    holders = marked(first.select("key")).filter("maybe").dropDuplicates(["key"]).join(wanted, "key")
    cores = _map_with(holders, "wanted", ["key"], [field("cores", "array<struct<h:binary,ids:binary>>")], encode_cores)
    cores = scratch.write(cores.select(F.explode("cores").alias("c")).select("c.*"), "cores")

    known = prints.join(cores, "h").groupBy("key").agg(F.collect_set(F.struct("k", "ids")).alias("known"))
    known = scratch.write(known, "known")
    scratch.drop(prints), scratch.drop(first), scratch.drop(cores)

    fields = [field("ids", "array<int>"), field("decoded", "string")] if outputs else [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]

    def finish(with_known):
        def make():
            c = codec(tokenizer_path)

            def one(t, row):
                ids = c.with_cores(t, {r["k"]: np.frombuffer(r["ids"], np.int32) for r in row}) if row else c.encode(t)
                back = c.decode(ids)
                if back != t and row:
                    ids = c.encode(t)
                    back = c.decode(ids)
                return (ids, back) if outputs else (len(ids), hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())

            def f(texts, rows=None):
                return list(map(list, zip(*(one(t, r) for t, r in zip(texts, rows or [None] * len(texts))))))
            return f
        return make

    flagged = marked(known.select("key"))
    plain = map_texts(flagged.filter(~F.col("maybe")), "text", ["id"], fields, finish(False))
    mixed = _map_with(flagged.filter("maybe").join(known, "key", "left"), "known", ["id"], fields, finish(True))
    return plain.unionByName(mixed).withColumnRenamed("id", id_col)


def _map_with(df: DataFrame, extra: str, keep: list[str], fields: list, make) -> DataFrame:
    """map_texts() whose function also gets the values of the column `extra`."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from telar.llm.common import sliced, to_arrow

    schema, n = T.StructType([df.schema[c] for c in keep] + fields), len(keep)

    def run(batches):
        f, types = make(), [to_arrow(x.dataType) for x in fields]
        for batch in batches:
            for part in sliced(batch, n):
                out = f(part.column(n).to_pylist(), part.column(n + 1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(v, type=t) for v, t in zip(out, types)], names=[x.name for x in schema])

    return df.select(*keep, "text", extra).mapInArrow(run, schema)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), Scratch(spark), outputs=False)


QUERIES = {"op6_bpe_codec": op6_bpe_codec}
ORACLES: dict[str, str] = {}
