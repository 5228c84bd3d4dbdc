"""Column functions for page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_line(line: Column) -> Column:
    """A line without page numbers, n-of-m, lone numbers and dates, in that order, with single spaces."""
    out = F.coalesce(line, F.lit(""))
    for pattern in (r"(?iU)\b(página|page|pág\.?)\s*\d+\b", r"(?U)\b\d+\s*(de|of|/)\s*\d+\b", r"(?U)^\s*\d+\s*$", r"(?U)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def chunk_id(source: Column, page: Column, content: Column) -> Column:
    """First 12 hex digits of the digest of source, page and the first 100 characters."""
    return F.substring(F.md5(F.concat_ws(":", source, page.cast("string"), F.substring(content, 1, 100))), 1, 12)


def table_to_markdown(rows: Column) -> Column:
    """Pipe Markdown of rows of cells; short rows are padded, long ones cut to the header's width."""
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))
    width = F.size(rows[0])
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: line(F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width)), F.lit(1), width)))
    head = F.array(line(F.transform(rows[0], cell)), line(F.array_repeat(F.lit("---"), width)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(F.array_join(F.concat(head, body), "\n"))


def page_numbers(spec: Column, most: Column) -> Column:
    """Sorted distinct pages of a range text such as 1,3,5-7 or all, within 1..most; null where it is invalid or empty."""
    s = F.lower(F.trim(spec))
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p))
    fine = s.rlike(r"^\s*\d+\s*(-\s*\d+)?(\s*,\s*\d+\s*(-\s*\d+)?)*\s*$")

    def pages(p: Column) -> Column:
        lo, hi = F.trim(F.substring_index(p, "-", 1)).try_cast("int"), F.trim(F.substring_index(p, "-", -1)).try_cast("int")
        hi = F.least(hi, most)
        return F.when(lo <= hi, F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, lo, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    listed = F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))), lambda p: (p >= 1) & (p <= most))
    out = F.when(s == "all", F.sequence(F.lit(1), most)).when(fine, listed)
    return F.when(F.size(out) > 0, out)
