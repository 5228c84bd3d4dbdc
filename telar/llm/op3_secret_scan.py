"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Base spans come from three fixed patterns. Besides them, loose candidates (long words that mix upper
case, lower case and digits) are taken. A text gives the lengths of its matches and of the gaps between
them; where a match stands is the sum of all lengths up to it, taken by a window over the document, so a
text with very many matches costs in proportion. The hashes of all candidate values are aggregated over
the corpus by distinct owner (`source`) and repository (document): a value that more than `max_owners`
owners hold, or that stands in more than `max_repos` repositories, is a widely copied example; one that
few repositories of its owner hold looks live. The method adds the loose candidates that look live and
touch no base span (kind `owned`); base spans stay, and each row counts its live and copied values.

Offsets are code points, end exclusive. Null or empty text: no spans. Null owner counts as one owner.
Rows with the same id, owner and text are one document, each row still gives a row. Columns other than
those named are left out, so they cannot clash; redact_secrets() keeps all columns but for the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.llm.common import IdFilter, Scratch, hidden, read, shown

# The kinds of spans, their patterns and least lengths.
ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOOSE = r"[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]

SPAN = "struct<start:int,ord:int,end:int,h:string>"
MATCH = "array<struct<ord:int,i:int,gap:int,size:int,h:string>>"


def _matches(text: Column, pattern: str, found: Column, values: Column, order: int, keep) -> Column:
    """The matches `found` of a pattern: the length of the gap before each and its own, and the hash of its value where keep(value) holds."""
    rows = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda gap, x: F.struct(
        F.length(gap).alias("gap"), F.length(x["m"]).alias("size"), F.when(keep(x["v"]), F.sha2(x["v"], 256)).alias("h")))
    rows = F.transform(rows, lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["h"].alias("h")))
    return F.when(F.size(found) > 0, rows.cast(MATCH)).otherwise(F.array().cast(MATCH))


def document_key(id_col: str, owner_col: str, text_col: str) -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws("\n", part(id_col), part(owner_col), part(text_col)), 256))


def _candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(id, key, owner, matches); texts are read once."""
    t = F.col("text")
    every = lambda p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    df = docs.select(F.col(id_col).alias("id"), document_key(id_col, owner_col, text_col).alias("key"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("*", every(ASSIGN).alias("m0"), every(ACCESS).alias("m1"), every(HEX).alias("m2"), every(LOOSE).alias("m3"))
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[a-z]") & w.rlike("[A-Z]")
    long = lambda n: lambda v: F.length(v) >= n
    m = F.concat(
        _matches(t, ASSIGN, F.col("m0"), F.when(F.size("m0") > 0, every(ASSIGN, 2)), 0, long(8)), _matches(t, ACCESS, F.col("m1"), F.col("m1"), 1, long(16)),
        _matches(t, HEX, F.col("m2"), F.col("m2"), 2, long(32)),
        F.when(F.exists("m3", mixed), _matches(t, LOOSE, F.col("m3"), F.col("m3"), 3, mixed)).otherwise(F.array().cast(MATCH)))
    return df.select("id", "key", "owner", m.alias("matches"))


def _spans(found: DataFrame) -> DataFrame:
    """(key, owner, s) for each span of each document: base spans, and loose ones that touch none. Shuffled once, by document."""
    each = found.filter(F.size("matches") > 0).select("key", "owner", F.inline("matches")).repartition("key").dropDuplicates(["key", "ord", "i"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "ord").orderBy("i")).cast("int")
    each = each.withColumn("end", end).filter("h IS NOT NULL").select("key", "owner", "ord", (F.col("end") - F.col("size")).alias("start"), "end", "h")
    # loose spans touch neither the furthest end of the base spans that begin before them nor the next base span
    by, back = Window.partitionBy("key").orderBy("start", "ord"), Window.partitionBy("key").orderBy(F.desc("start"), F.desc("ord"))
    base = lambda c: F.when(F.col("ord") < 3, F.col(c))
    each = each.withColumns({"before": F.max(base("end")).over(by.rowsBetween(Window.unboundedPreceding, 0)), "next": F.min(base("start")).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    free = (F.col("ord") < 3) | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    return each.filter(free).select("key", "owner", F.struct("start", "ord", "end", "h").cast(SPAN).alias("s"))


def _line(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 1, max_repos: int = 100) -> DataFrame:
    """A row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, key, found (array of start, ord, end)."""
    every = scratch.write(_candidates(docs, id_col, text_col, owner_col), "candidates")
    each = scratch.write(_spans(every), "spans").withColumn("h", F.col("s.h"))
    # repositories and owners of each value: those of an owner are counted before owners are
    owners = (
        each.groupBy("h", "owner", "key").agg(F.lit(1).alias("one")).groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))
    judged = each.join(owners, "h").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    kept = F.when((F.col("s.ord") < 3) | F.col("live"), F.col("s"))
    per = judged.groupBy("key").agg(
        F.array_sort(F.collect_list(kept)).alias("found"), F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    some = every.filter(F.size("matches") > 0).select("id", "key").join(per, "key", "left")
    none = every.filter(F.size("matches") == 0).select("id", "key", *[F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("found", "n_live", "n_copied")])
    out = some.select("id", "key", "found", "n_live", "n_copied").unionByName(none).withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))
    n = lambda k: F.size(F.filter("found", lambda s: s["ord"] == k)).cast("long")
    base = F.filter("found", lambda s: s["ord"] < 3)
    return out.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), "key", "found")


PIECE = 4096


def _redacted(texts: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    """(key, text) of texts (key, text) with a mark in the place of each run of overlapping spans; found: key, found.

    Texts are cut into pieces of PIECE characters, each of which is rebuilt from its own few spans, so that long
    texts with very many spans cost in proportion.
    """
    by = Window.partitionBy("key").orderBy("start", "end")
    spans = found.select("key", F.inline("found")).select("key", "start", "end")
    new = F.col("start") >= F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = spans.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    first = F.floor(F.col("a") / PIECE).cast("int")
    runs = runs.select("key", "a", "z", first.alias("first"), F.explode(F.sequence(first, F.floor((F.col("z") - 1) / PIECE).cast("int"))).alias("k"))
    local = F.struct(
        F.greatest(F.col("a") - F.col("k") * PIECE, F.lit(0)).alias("a"), F.least(F.col("z") - F.col("k") * PIECE, F.lit(PIECE)).alias("z"),
        F.when(F.col("k") == F.col("first"), mark).otherwise("").alias("mark"))
    cuts = runs.groupBy("key", "k").agg(F.array_sort(F.collect_list(local)).alias("cuts"))
    pieces = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % PIECE), F.lit(0))).alias("k", "piece")).join(cuts, ["key", "k"], "left")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["z"].alias("pos"), F.concat(acc["out"], F.substring(F.col("piece"), acc["pos"] + 1, s["a"] - acc["pos"]), s["mark"]).alias("out"))
    done = F.aggregate("cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("piece"), acc["pos"] + 1, F.lit(PIECE))))
    rebuilt = pieces.select("key", "k", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(done).alias("piece"))
    return rebuilt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("text"))


def redact_secrets(docs: DataFrame, scratch: Scratch, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", **options) -> DataFrame:
    """docs with the text under every run of spans replaced by `mark`; other rows and columns stay as they are."""
    df, names = hidden(docs)
    id_col, text_col, owner_col = (names[c] for c in (id_col, text_col, owner_col))
    found = scan_secrets(df, scratch, id_col, text_col, owner_col, **options).filter(F.size("found") > 0)
    found = scratch.write(found.select("key", "found").dropDuplicates(["key"]), "redact")
    flagged = IdFilter(found, "key").flag(df.withColumn("key", document_key(id_col, owner_col, text_col)), F.col("key"), "maybe")
    clear = flagged.filter(~F.col("maybe")).select(*df.columns)
    texts = flagged.filter("maybe").select("key", F.col(text_col).alias("text")).join(found.select("key"), "key", "left_semi").dropDuplicates(["key"])
    new = scratch.write(_redacted(texts, found, mark), "redacted").select("key", F.col("text").alias("new"))
    mixed = flagged.filter("maybe").join(new, "key", "left").withColumn(text_col, F.coalesce("new", text_col))
    return shown(clear.unionByName(mixed.select(*df.columns)), names)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
