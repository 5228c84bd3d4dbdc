"""Column functions for money texts and table headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions.arrays import let

# Texts that stand for no amount.
NO_AMOUNT = ["", "n/a", "-", "n.a.", "na", "s/d", "---"]


def clean_currency(value: Column) -> Column:
    """A money text as a double, null where it holds none.

    Parentheses or a leading minus make it negative. One separator followed by three digits, with three
    or fewer before it, marks thousands, else it is the decimal mark; of both kinds the last one is the
    decimal mark; several of one kind mark thousands; apostrophes always do.
    """
    def number(body: Column) -> Column:
        dots, commas = (F.length(body) - F.length(F.replace(body, F.lit(c), F.lit(""))) for c in ".,")
        no_dots, no_commas = (F.replace(body, F.lit(c), F.lit("")) for c in ".,")
        as_decimal = lambda c: F.replace(c, F.lit(","), F.lit("."))
        comma_last = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
        plain = (
            F.when(body.rlike(r"^[0-9]{0,3}[.,][0-9]{3}$"), F.regexp_replace(body, "[.,]", ""))
            .when(dots + commas <= 1, as_decimal(body))
            .when((dots >= 1) & (commas == 1), F.when(comma_last, as_decimal(no_dots)).otherwise(no_commas))
            .when((commas >= 1) & (dots == 1), no_commas)
            .otherwise(F.regexp_replace(body, "[.,]", "")))
        return F.when(body.rlike("[0-9]"), plain).try_cast("double")

    def signed(t: Column) -> Column:
        inner = F.regexp_replace(t, r"^\((.*)\)$", "$1")
        negative = (F.length(inner) < F.length(t)) | inner.startswith("-") | inner.startswith("−")
        amount = let(F.regexp_replace(inner, "[^0-9.,]", ""), number)
        return F.when(~F.lower(t).isin(*NO_AMOUNT), amount * F.when(negative, -1.0).otherwise(1.0))

    return let(F.trim(value.cast("string")), signed)


def normalize_header(header: Column) -> Column:
    """snake_case without special characters; `column` when nothing is left."""
    h = F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"(?U)[^\w\s]", "")
    h = F.regexp_replace(F.regexp_replace(F.trim(h), r"(?U)\s+", "_"), "_+", "_")
    return F.when(h == "", "column").otherwise(h)
