"""Queries on price tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.functions.money import clean_currency as clean
from telar.functions.money import normalize_header as header
from telar.operators import finance
from telar.plans.inputs import derive, oracle

MONEY = """
SELECT doc_id, table_id, row_index, quantity, cents, kind, style, p_name, us, eu,
  CASE style WHEN 0 THEN concat('$ ', us) WHEN 1 THEN concat('€ ', eu) WHEN 2 THEN replace(us, ',', '''') WHEN 3 THEN concat(replace(us, ',', ''), ' USD') ELSE concat('(', us, ')') END AS amount,
  CASE WHEN style = 4 THEN -1 ELSE 1 END * CAST(cents AS DOUBLE) / 100 AS expected
FROM (
  SELECT *, concat(CASE WHEN whole >= 1000 THEN concat(CAST(CAST((whole - whole % 1000) / 1000 AS BIGINT) AS STRING), ',', lpad(CAST(whole % 1000 AS STRING), 3, '0')) ELSE CAST(whole AS STRING) END, '.', lpad(CAST(cents % 100 AS STRING), 2, '0')) AS us,
    concat(CASE WHEN whole >= 1000 THEN concat(CAST(CAST((whole - whole % 1000) / 1000 AS BIGINT) AS STRING), '.', lpad(CAST(whole % 1000 AS STRING), 3, '0')) ELSE CAST(whole AS STRING) END, ',', lpad(CAST(cents % 100 AS STRING), 2, '0')) AS eu
  FROM (
    SELECT *, CAST((cents - cents % 100) / 100 AS BIGINT) AS whole FROM (
      SELECT l_orderkey % 500 AS doc_id, l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_index, CAST(l_quantity AS INT) AS quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_orderkey % 4 AS INT) AS kind, CAST(l_partkey % 5 AS INT) AS style, p_name
      FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) x) y) z"""
HEADS = {
    0: ["Descripción", "Cantidad", "Precio Unitario", "Total ($)"], 1: ["Item", "Qty", "Unit Price", "Amount EUR"],
    2: ["Producto", "Notas"], 3: ["Concepto", "Unidades", "Tarifa", "Importe ARS"],
}
NORMAL = {0: "descripción|cantidad|precio_unitario|total", 1: "item|qty|unit_price|amount_eur", 2: "producto|notas", 3: "concepto|unidades|tarifa|importe_ars"}
KEYS = ["doc_id", "table_id"]


def money(spark, d):
    return derive(spark, d, MONEY)


def tables(spark, d):
    """Raw tables: the header by kind, the first cell blank below the first row, the unit price in the totals' style."""
    m = money(spark, d)
    head = F.array(*map(F.lit, HEADS[0]))
    for k in (1, 2, 3):
        head = F.when(F.col("kind") == k, F.array(*map(F.lit, HEADS[k]))).otherwise(head)
    name = F.when(F.col("row_index") == 0, F.col("p_name")).otherwise("")
    cells = F.when(F.col("kind") == 2, F.array(name, F.lit("nota"))).otherwise(F.array(name, F.col("quantity").cast("string"), F.lit("1.500"), F.col("amount")))
    rows = m.groupBy(*KEYS, "kind").agg(F.array_sort(F.collect_list(F.struct("row_index", cells.alias("cells")))).alias("r"))
    return rows.select(*KEYS, F.concat(F.array(head), F.transform("r", lambda x: x["cells"])).alias("rows"))


def clean_currency(spark, d):
    return money(spark, d).select("table_id", F.col("row_index").cast("int").alias("row_index"), "amount", clean(F.col("amount")).alias("value"))


def normalize_header(spark, d):
    return tables(spark, d).select("table_id", F.array_join(F.transform(F.col("rows")[0], header), "|").alias("headers"))


def fin_confidence(spark, d):
    return tables(spark, d).select("table_id", finance.confidence(F.col("rows")).alias("confidence"))


def detect_currency(spark, d):
    return tables(spark, d).select("table_id", finance.currency(F.col("rows"), "CLP").alias("currency"))


def map_columns(spark, d):
    return finance.map_columns(tables(spark, d)).select("table_id", *[f"at_{f}" for f in finance.FIELDS])


def fill_down(spark, d):
    return finance.explode_rows(tables(spark, d), KEYS).select("table_id", "row_index", "first")


def parse_rows(spark, d):
    return finance.parse_rows(tables(spark, d), KEYS).select("table_id", "row_index", "description", "unit_price", "quantity", "total_price")


def rows_flat(spark, d):
    pairs = F.transform("raw_data", lambda x: F.concat_ws("=", x["name"], x["cell"]))
    return finance.parse_rows(tables(spark, d), KEYS).select("doc_id", "table_id", "row_index", F.array_join(pairs, ";").alias("raw_data"))


def totals(spark, d, least=0.5):
    return finance.table_totals(tables(spark, d), KEYS, least)


def table_totals(spark, d):
    return totals(spark, d, 0.6)


def line_total(spark, d):
    return finance.parse_rows(tables(spark, d), KEYS).select("table_id", "row_index", F.round(finance.line_total(), 2).alias("line_total"))


def column_sum(spark, d):
    r = finance.parse_rows(tables(spark, d), KEYS)
    return r.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("double").alias(f"sum_{c}") for c in ("unit_price", "quantity", "total_price")])


def reconcile_totals(spark, d):
    return finance.reconcile(totals(spark, d)).select("table_id", "line_total", "total_detected", "difference", "agrees")


CHARTS = """
SELECT event_id, concat('{"data_found": ', CASE WHEN event_id % 9 = 0 THEN 'false' ELSE 'true' END, ', "data_type": "', CASE event_id % 4 WHEN 0 THEN 'comparison' WHEN 1 THEN 'timeline' WHEN 2 THEN 'distribution' ELSE 'single_value' END,
  '", "categories": ["a", "b"], "values": ["', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), ',5"', CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "1.250"' END, '], "unit": "', event_type, '", "chart_type": "', CASE event_id % 5 WHEN 0 THEN 'radar' WHEN 1 THEN 'pie' ELSE 'line' END, '"}') AS reply
FROM {events}"""


def charts(spark, d):
    return derive(spark, d, CHARTS).select("event_id", finance.chart_plan(F.col("reply")).alias("p"))


def quant_validate(spark, d):
    return charts(spark, d).select("event_id", "p.chart_type", "p.fits")


def quant_values(spark, d):
    return charts(spark, d).select("event_id", F.posexplode(finance.chart_values(F.col("p.payload.values"))).alias("place", "value"))


def quant_fallback_text(spark, d):
    return charts(spark, d).select("event_id", finance.chart_sentence(F.col("p.payload.data_found"), F.col("p.payload.values"), F.col("p.payload.unit")).alias("sentence"))


QUERIES = {f.__name__: f for f in (
    clean_currency, normalize_header, fin_confidence, detect_currency, map_columns, fill_down, parse_rows, rows_flat, table_totals, line_total, column_sum, reconcile_totals,
    quant_validate, quant_values, quant_fallback_text)}

M = oracle(MONEY)
KW = "[" + ", ".join(f"'{k}'" for k in finance.KEYWORDS) + "]"
HEAD = "CASE kind " + " ".join(f"WHEN {k} THEN '{' '.join(v)}'" for k, v in HEADS.items()) + " END"
MARK = "bool_or(kind <> 2 AND row_index < 4 AND style = 0) AS dollar, bool_or(kind <> 2 AND row_index < 4 AND style = 1) AS euro"
CONF = f"""conf AS (SELECT doc_id, table_id, kind, dollar, euro, least(100, len(list_filter({KW}, lambda k: contains(lower({HEAD}), k))) * 15 + CASE WHEN dollar THEN 20 ELSE 0 END + CASE WHEN euro THEN 20 ELSE 0 END
  + CASE WHEN kind <> 2 THEN 20 ELSE 0 END + CASE WHEN kind <> 2 THEN 10 ELSE 0 END) / 100.0 AS confidence FROM (SELECT doc_id, table_id, kind, {MARK} FROM m GROUP BY 1, 2, 3))"""
ROWS = """first AS (SELECT table_id, p_name AS description FROM m WHERE row_index = 0),
r AS (SELECT m.doc_id, m.table_id, m.row_index, m.kind, f.description, CASE WHEN kind <> 2 THEN CAST(1500.0 AS DOUBLE) END AS unit_price, CASE WHEN kind <> 2 THEN CAST(quantity AS DOUBLE) END AS quantity,
  CASE WHEN kind <> 2 THEN expected END AS total_price, m.quantity AS q, amount FROM m JOIN first f USING (table_id))"""
CUR = "CASE kind WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 3 THEN 'ARS' ELSE {hint} END"
SUMS = """s AS (SELECT table_id, count(*) AS n_rows, sum(CAST(total_price AS DECIMAL(18,2))) AS total, sum(CAST(unit_price * quantity AS DECIMAL(18,2))) AS lines FROM r GROUP BY 1)"""
PAY = f"""e AS (SELECT event_id, reply, json_extract_string(reply, '$.data_type') AS dt, json_extract_string(reply, '$.chart_type') AS ct, json_extract_string(reply, '$.data_found') = 'true' AS found,
  from_json(json_extract(reply, '$.values'), '["VARCHAR"]') AS vals, json_extract_string(reply, '$.unit') AS unit FROM ({oracle(CHARTS)}))"""
ORACLES = {
    "clean_currency": f"SELECT table_id, CAST(row_index AS INT) AS row_index, amount, expected AS value FROM ({M})",
    "normalize_header": f"SELECT table_id, CASE any_value(kind) {' '.join(f'WHEN {k} THEN {v!r}' for k, v in NORMAL.items())} END AS headers FROM ({M}) GROUP BY 1",
    "fin_confidence": f"WITH m AS ({M}), {CONF} SELECT table_id, CAST(confidence AS DOUBLE) AS confidence FROM conf",
    "detect_currency": f"WITH m AS ({M}) SELECT table_id, {CUR.format(hint=chr(39) + 'CLP' + chr(39))} AS currency FROM (SELECT DISTINCT table_id, kind FROM m)",
    "map_columns": f"WITH m AS ({M}) SELECT DISTINCT table_id, 0 AS at_description, CASE WHEN kind <> 2 THEN 2 END AS at_unit_price, CASE WHEN kind <> 2 THEN 1 END AS at_quantity, CASE WHEN kind <> 2 THEN 3 END AS at_total_price FROM m",
    "fill_down": f"""WITH m AS ({M}) SELECT table_id, CAST(row_index AS INT) AS row_index, last_value(CASE WHEN row_index = 0 THEN p_name END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_index) AS "first" FROM m""",
    "parse_rows": f"WITH m AS ({M}), {ROWS} SELECT table_id, CAST(row_index AS INT) AS row_index, description, unit_price, quantity, total_price FROM r",
    "rows_flat": f"""WITH m AS ({M}), {ROWS} SELECT doc_id, table_id, CAST(row_index AS INT) AS row_index, CASE kind
      WHEN 0 THEN 'descripción=' || description || ';cantidad=' || q || ';precio_unitario=1.500;total=' || amount WHEN 1 THEN 'item=' || description || ';qty=' || q || ';unit_price=1.500;amount_eur=' || amount
      WHEN 2 THEN 'producto=' || description || ';notas=nota' ELSE 'concepto=' || description || ';unidades=' || q || ';tarifa=1.500;importe_ars=' || amount END AS raw_data FROM r""",
    "table_totals": f"""WITH m AS ({M}), {ROWS}, {CONF}, {SUMS} SELECT doc_id, table_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS INT) AS table_number, CAST(confidence AS DOUBLE) AS confidence,
      {CUR.format(hint=chr(39) + 'USD' + chr(39))} AS currency, n_rows, CAST(coalesce(total, 0) AS DOUBLE) AS total_detected, CAST(coalesce(lines, 0) AS DOUBLE) AS line_total,
      CAST(coalesce(sum(total) OVER (PARTITION BY doc_id), 0) AS DOUBLE) AS grand_total, count(*) OVER (PARTITION BY doc_id) AS tables_found FROM conf JOIN s USING (table_id) WHERE confidence >= 0.6""",
    "line_total": f"WITH m AS ({M}), {ROWS} SELECT table_id, CAST(row_index AS INT) AS row_index, round(coalesce(unit_price * quantity, total_price), 2) AS line_total FROM r",
    "column_sum": f"""WITH m AS ({M}), {ROWS} SELECT doc_id, CAST(coalesce(sum(CAST(unit_price AS DECIMAL(18,2))), 0) AS DOUBLE) AS sum_unit_price, CAST(coalesce(sum(CAST(quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS sum_quantity,
      CAST(coalesce(sum(CAST(total_price AS DECIMAL(18,2))), 0) AS DOUBLE) AS sum_total_price FROM r GROUP BY 1""",
    "reconcile_totals": f"""WITH m AS ({M}), {ROWS}, {CONF}, {SUMS} SELECT table_id, CAST(coalesce(lines, 0) AS DOUBLE) AS line_total, CAST(coalesce(total, 0) AS DOUBLE) AS total_detected,
      CAST(abs(coalesce(lines, 0) - coalesce(total, 0)) AS DOUBLE) AS difference, abs(coalesce(lines, 0) - coalesce(total, 0)) <= 0.01 AS agrees FROM conf JOIN s USING (table_id) WHERE confidence >= 0.5""",
    "quant_validate": f"""WITH {PAY} SELECT event_id, CASE WHEN NOT found THEN 'none' WHEN ct IN ('bar', 'line', 'pie', 'table', 'none') THEN ct WHEN dt = 'timeline' THEN 'line' WHEN dt = 'distribution' THEN 'pie' ELSE 'bar' END AS chart_type, len(vals) = 2 AS fits FROM e""",
    "quant_values": f"""WITH {PAY} SELECT event_id, CAST(0 AS INT) AS place, CAST(replace(vals[1], ',', '.') AS DOUBLE) AS value FROM e UNION ALL SELECT event_id, 1, 1250.0 FROM e WHERE len(vals) = 2""",
    "quant_fallback_text": f"""WITH {PAY} SELECT event_id, CASE WHEN NOT found THEN 'No se encontraron datos numericos relevantes para analizar.' WHEN len(vals) = 1 THEN 'El valor encontrado es **' || vals[1] || ' ' || unit || '**.'
      ELSE 'Se encontraron ' || len(vals) || ' valores: ' || array_to_string(vals, ', ') || ' (' || unit || ').' END AS sentence FROM e""",
}
