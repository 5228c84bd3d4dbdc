"""Pages to clean, typed, identified chunks, and what an index holds. Pages: source_file, page_number, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions.text import chunk_id, normalize_line, table_to_markdown
from telar.sources.files import settled


def check_files(files: DataFrame) -> DataFrame:
    """is_valid, reject_reason of files (path, content): absolute .pdf paths whose content begins with %PDF-."""
    reason = (
        F.when(~F.col("path").rlike(r"^([a-z]+:)?/"), "relative path").when(~F.lower("path").endswith(".pdf"), "not a .pdf name")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF header"))
    return files.withColumns({"reject_reason": reason, "is_valid": reason.isNull()})


def limit_pages(pages: DataFrame, most: int = 500) -> DataFrame:
    """Pages with `accepted`, false for all pages of a document with more than `most`."""
    counts = pages.groupBy("source_file").agg((F.count(F.lit(1)) <= most).alias("accepted"))
    return pages.alias("p").join(counts.alias("c"), F.col("p.source_file").eqNullSafe(F.col("c.source_file"))).select("p.*", "accepted")


def number_pages(rows: DataFrame, order: str, by: str = "source_file", name: str = "page_number") -> DataFrame:
    """rows with page numbers from 1 by document, in the order of a column that names a row within its document.

    In two phases, so that a document of any size is many tasks' work: (by, order) alone is dealt by ranges and written,
    each range is numbered on its own, and what stands in a document's earlier ranges is added. The numbers are joined
    back to the rows by both columns.
    """
    ranged = rows.select(by, order).repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("at", F.monotonically_increasing_id())
    places = settled(ranged, "places").withColumn("range", F.shiftright("at", 33))
    per = places.groupBy(by, "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    per = per.withColumn("before", F.coalesce(earlier, F.lit(0)))
    numbers = places.alias("p").join(per.alias("r"), F.col(f"p.{by}").eqNullSafe(F.col(f"r.{by}")) & (F.col("p.range") == F.col("r.range")))
    numbers = numbers.select(F.col(f"p.{by}").alias(by), F.col(f"p.{order}").alias(order), (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias(name))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (by, order)]
    return rows.alias("d").join(numbers.alias("n"), same).select("d.*", f"n.{name}")


def choose_text(strategy: Column, native: Column, ocr: Column) -> Column:
    """Struct of text and ocr_used: FAST takes the native text, OCR_ONLY the other, HI_RES the native unless it is blank."""
    blank = F.trim(F.coalesce(native, F.lit(""))) == ""
    use = F.when(strategy == "OCR_ONLY", True).when(strategy == "FAST", False).otherwise(blank & ocr.isNotNull())
    return F.struct(F.when(use, ocr).otherwise(native).alias("text"), F.coalesce(use, F.lit(False)).alias("ocr_used"))


def is_sparse(text: Column, least: int = 10) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def detect_noise(pages: DataFrame, share: float = 0.7, edge: int = 3, least_pages: int = 3) -> DataFrame:
    """(source_file, pattern): normalised lines that stand at the top or at the bottom of so large a share of the pages."""
    lines = F.split("text", "\n")
    zones = F.array(
        F.struct(F.lit("header").alias("zone"), F.slice(lines, 1, edge).alias("lines")),
        F.struct(F.lit("footer").alias("zone"), F.slice(lines, F.greatest(F.size(lines) - edge + 1, F.lit(1)), F.lit(edge)).alias("lines")))
    found = pages.filter(F.col("text").isNotNull()).select("source_file", F.explode(zones).alias("z")).select("source_file", "z.zone", F.explode("z.lines").alias("line"))
    counts = found.select("source_file", "zone", normalize_line(F.col("line")).alias("pattern")).filter(F.length("pattern") > 5).groupBy("source_file", "zone", "pattern").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    return counts.join(totals, "source_file").filter(F.col("n") >= F.col("n_pages") * share).select("source_file", "pattern").distinct()


def remove_noise(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """Pages without the lines that are noise in their document; only the document's list of patterns is joined."""
    lists = noise.groupBy("source_file").agg(F.collect_set("pattern").alias("noise"))
    kept = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("noise", normalize_line(line)))
    out = pages.join(lists, "source_file", "left")
    return out.withColumn("text", F.when(F.col("noise").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("noise")


def emit_chunks(pages: DataFrame, chunks: Column, tables: DataFrame | None = None) -> DataFrame:
    """Typed chunk rows: text chunks by page, and table chunks (source_file, page_number, rows) as Markdown."""
    text = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("source_file", "page_number", F.posexplode(chunks).alias("chunk_index", "content"))
    text = text.select("source_file", "page_number", F.lit("text").alias("chunk_type"), "chunk_index", F.trim("content").alias("content"), F.lit(None).cast("int").alias("table_rows"))
    out = text
    if tables is not None:
        order = Window.partitionBy("source_file", "page_number").orderBy("content")
        t = tables.filter(F.size("rows") >= 2).select("source_file", "page_number", table_to_markdown(F.col("rows")).alias("content"), F.size("rows").alias("table_rows"))
        t = t.select("source_file", "page_number", F.lit("table").alias("chunk_type"), (F.row_number().over(order) - 1).alias("chunk_index"), "content", "table_rows")
        out = text.unionByName(t)
    return out.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("page_number"), F.col("content")))


def scan_warnings(pages: DataFrame) -> DataFrame:
    """(source_file, page_number, warning): a row per page that looks scanned."""
    return pages.filter(is_sparse(F.col("text"))).select("source_file", "page_number", F.format_string("page %d looks scanned", F.col("page_number")).alias("warning"))


def load_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: pages, chunks, tables, whether OCR was used, how many pages scan_warnings() names."""
    p = pages.groupBy("source_file").agg(
        F.countDistinct("page_number").alias("total_pages"), F.coalesce(F.bool_or("ocr_used"), F.lit(False)).alias("ocr_used"),
        F.sum(is_sparse(F.col("text")).cast("int")).cast("int").alias("warnings"))
    c = chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), F.sum((F.col("chunk_type") == "table").cast("long")).alias("tables_extracted"))
    return p.join(c, "source_file", "left").select("source_file", "total_pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tables_extracted", F.lit(0)).alias("tables_extracted"), "ocr_used", "warnings")


def source_counts(chunks: DataFrame, source: str = "source_file") -> DataFrame:
    return chunks.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("chunks"))


def index_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"))
