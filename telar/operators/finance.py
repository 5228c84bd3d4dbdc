"""Price tables: confidence, currency, column mapping, typed rows and totals. Tables are rows of cells, the first the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions.money import clean_currency, normalize_header

# Words of financial headers, and the header names of each field.
KEYWORDS = [
    "precio", "precios", "monto", "montos", "total", "totales", "subtotal", "costo", "costos", "valor", "valores", "importe",
    "importes", "unidad", "unitario", "cantidad", "cant", "iva", "impuesto", "descuento", "neto", "bruto",
    "price", "prices", "amount", "amounts", "cost", "costs", "value", "values", "unit", "quantity", "qty", "tax",
    "discount", "net", "gross", "fee", "rate", "$", "€", "£", "¥", "usd", "eur", "ars", "brl", "mxn",
]
FIELDS = {
    "description": ["descripcion", "descripción", "concepto", "item", "ítem", "producto", "servicio", "detalle", "rubro", "name", "nombre"],
    "unit_price": ["precio_unitario", "precio_unit", "p_unit", "unit_price", "precio", "price", "tarifa", "rate", "costo_unitario"],
    "quantity": ["cantidad", "cant", "qty", "quantity", "unidades", "units", "volumen", "volume"],
    "total_price": ["total", "importe", "monto", "subtotal", "amount", "precio_total", "total_price", "valor", "value"],
}


def holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def headers(rows: Column) -> Column:
    return F.transform(rows[0], lambda h: F.trim(F.coalesce(h, F.lit(""))))


def confidence(rows: Column) -> Column:
    """How likely a table is financial: 0 to 1, counted in hundredths."""
    head = F.lower(F.array_join(headers(rows), " "))
    sample = F.lower(F.array_join(F.flatten(F.slice(rows, 2, 4)), " "))
    points = (
        F.size(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: head.contains(k))) * 15 + sample.contains("$").cast("int") * 20
        + sample.contains("€").cast("int") * 20 + sample.rlike("[0-9.,]").cast("int") * 20 + F.size(rows[0]).between(3, 10).cast("int") * 10)
    return F.least(points, F.lit(100)) / 100


def currency(rows: Column, hint: str = "USD") -> Column:
    """From the header, else from the cells, else the hint; of several in a header USD comes first, then EUR, then ARS."""
    head = F.lower(F.array_join(headers(rows), " "))
    sample = F.array_join(F.flatten(F.slice(rows, 2, 4)), " ")
    any_of = lambda *w: holds(head, list(w))
    return F.when(any_of("$", "usd"), "USD").when(any_of("€", "eur"), "EUR").when(any_of("ars"), "ARS").when(sample.contains("$"), "USD").when(sample.contains("€"), "EUR").otherwise(hint)


def column_of(head: Column, field: str) -> Column:
    """0-based place of the first header that is or holds one of the field's names, null if none."""
    hit = F.array_position(F.transform(head, lambda h: holds(h, FIELDS[field])), F.lit(True))
    place = F.when(hit > 0, (hit - 1).cast("int"))
    return F.coalesce(place, F.lit(0)) if field == "description" else place


def map_columns(tables: DataFrame) -> DataFrame:
    """`head` (normalised headers) and a column for each field's place."""
    out = tables.withColumn("head", F.transform(headers(F.col("rows")), normalize_header))
    return out.withColumns({f"at_{f}": column_of(F.col("head"), f) for f in FIELDS})


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def explode_rows(tables: DataFrame, keys: list[str], outer: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Data rows with their 0-based index and the first cell filled down from the last one above that isn't blank.

    outer: a table without data rows gives a row of nulls; also: further columns of the table to keep.
    """
    each = F.posexplode_outer if outer else F.posexplode
    rows = map_columns(tables).select(*keys, *also, "head", *[f"at_{f}" for f in FIELDS], each(F.slice("rows", F.lit(2), F.size("rows"))).alias("row_index", "cells"))
    w = Window.partitionBy(*keys).orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    first = F.get("cells", F.lit(0))
    filled = F.last(F.when(~blank(first), first), ignorenulls=True).over(w)
    return rows.withColumn("first", F.coalesce(filled, first))


def typed_rows(tables: DataFrame, keys: list[str], outer: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows: description, unit_price, quantity, total_price, raw_data, and whether they hold something usable."""
    rows = explode_rows(tables, keys, outer, also)
    cell = lambda f: F.when(F.col(f"at_{f}") == 0, F.col("first")).otherwise(F.get("cells", F.col(f"at_{f}")))
    names = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.coalesce(F.get("head", i), F.concat(F.lit("col_"), i.cast("string"))))
    cells = F.concat(F.array("first"), F.slice("cells", F.lit(2), F.size("cells")))
    some = F.exists(F.concat(F.array("first"), "cells"), lambda c: F.coalesce(c, F.lit("")) != "")
    out = rows.select(
        *keys, *also, "row_index", some.alias("some"), F.trim(F.coalesce(cell("description"), F.lit(""))).alias("description"),
        *[clean_currency(cell(f)).alias(f) for f in ("unit_price", "quantity", "total_price")], F.arrays_zip(names.alias("name"), cells.alias("cell")).alias("raw_data"))
    return out.withColumn("usable", F.coalesce(F.expr("some AND (description <> '' OR unit_price IS NOT NULL OR total_price IS NOT NULL)"), F.lit(False))).drop("some")


def parse_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Typed rows that hold something usable."""
    return typed_rows(tables, keys).filter("usable").drop("usable")


def line_total() -> Column:
    return F.coalesce(F.col("unit_price") * F.col("quantity"), F.col("total_price"))


def table_totals(tables: DataFrame, keys: list[str], least: float = 0.5, hint: str = "USD") -> DataFrame:
    """Tables at or above the confidence, numbered anew in their document, with totals and the document's grand total.

    keys: the document's key first, then what orders its tables.
    """
    rated = tables.withColumns({"confidence": confidence(F.col("rows")), "currency": currency(F.col("rows"), hint)}).filter(F.col("confidence") >= least)
    rows = typed_rows(rated, keys, True, ("confidence", "currency"))
    amount = lambda c: F.sum(F.when(F.col("usable"), c.cast("decimal(18,2)")))
    out = rows.groupBy(*keys).agg(
        F.first("confidence").alias("confidence"), F.first("currency").alias("currency"), F.sum(F.col("usable").cast("long")).alias("n_rows"),
        amount(F.col("total_price")).alias("total"), amount(line_total()).alias("lines"))
    zero = F.lit(0).cast("decimal(18,2)")
    by = Window.partitionBy(keys[0])
    return out.select(
        *keys, F.row_number().over(by.orderBy(*keys[1:])).alias("table_number"), "confidence", "currency", "n_rows",
        F.coalesce("total", zero).cast("double").alias("total_detected"), F.coalesce("lines", zero).cast("double").alias("line_total"),
        F.coalesce(F.sum("total").over(by), zero).cast("double").alias("grand_total"), F.count(F.lit(1)).over(by).alias("tables_found"))


def reconcile(totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    gap = F.round(F.abs(F.col("line_total") - F.col("total_detected")), 2)
    return totals.withColumns({"difference": gap, "agrees": gap <= tolerance})


CHARTS = ["bar", "line", "pie", "table", "none"]
PAYLOAD = "data_found boolean, data_type string, categories array<string>, values array<string>, unit string, chart_type string"


def chart_plan(reply: Column) -> Column:
    """Struct of the payload, its chart type after checks, and whether categories and values fit."""
    p = F.from_json(reply, PAYLOAD)
    guess = F.when(p["data_type"] == "comparison", "bar").when(p["data_type"] == "timeline", "line").when(p["data_type"] == "distribution", "pie").otherwise("bar")
    given = F.coalesce(p["chart_type"], F.lit("none"))
    none = ~F.coalesce(p["data_found"], F.lit(False)) | (F.coalesce(F.size(p["values"]), F.lit(0)) < 1)
    chart = F.when(none, "none").when(given.isin(*CHARTS), given).otherwise(guess)
    fits = F.coalesce((F.size(p["categories"]) > 0) & (F.size(p["categories"]) == F.size(p["values"])), F.lit(False))
    return F.struct(p.alias("payload"), chart.alias("chart_type"), fits.alias("fits"))


def chart_values(values: Column) -> Column:
    """Numbers of chart values; texts are read as money texts."""
    return F.transform(values, clean_currency)


def chart_sentence(found: Column, values: Column, unit: Column) -> Column:
    unit = F.coalesce(unit, F.lit(""))
    return (
        F.when(~F.coalesce(found, F.lit(False)) | (F.coalesce(F.size(values), F.lit(0)) < 1), "No se encontraron datos numericos relevantes para analizar.")
        .when(F.size(values) == 1, F.concat(F.lit("El valor encontrado es **"), F.get(values, F.lit(0)), F.lit(" "), unit, F.lit("**.")))
        .otherwise(F.concat(F.lit("Se encontraron "), F.size(values).cast("string"), F.lit(" valores: "), F.array_join(values, ", "), F.lit(" ("), unit, F.lit(")."))))
