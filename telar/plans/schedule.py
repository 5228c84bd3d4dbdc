"""Queries on timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import timeline as t
from telar.plans.inputs import derive, oracle, spread

ES = "CASE month(o_orderdate) " + " ".join(f"WHEN {n} THEN '{m}'" for m, n in list(t.MONTHS.items()) if m != "setiembre" and m in list(t.MONTHS)[:13]) + " END"
EN = "CASE month(o_orderdate) " + " ".join(f"WHEN {n} THEN '{m.capitalize()}'" for m, n in list(t.MONTHS.items())[13:]) + " END"
Y, MO, D = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
DAY = "CAST(day(o_orderdate) AS STRING)"
TEXTS = f"""
SELECT doc_id, kind, n, m, w, o_orderdate, date_text, concat('La presentación de la oferta vence el ', date_text, ' a las diez.', chr(10), 'Segun el pliego de condiciones generales y particulares: abono ', CAST(n AS STRING), ' días después de la firma', chr(10),
  'duración de ', CAST(m AS STRING), ' meses', chr(10), 'Taller ', CAST(w AS STRING), ' semanas antes de cierre total') AS text
FROM (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 5 AS INT) AS kind, CAST(o_orderkey % 90 AS INT) AS n, CAST(1 + o_orderkey % 36 AS INT) AS m, CAST(1 + o_orderkey % 4 AS INT) AS w, o_orderdate,
  CASE o_orderkey % 5 WHEN 0 THEN concat({D}, '/', {MO}, '/', {Y}) WHEN 1 THEN concat({Y}, '-', {MO}, '-', {D}) WHEN 2 THEN concat({DAY}, ' de ', {ES}, ' de ', {Y}) WHEN 3 THEN concat({EN}, ' ', {DAY}, ', ', {Y}) ELSE concat({DAY}, ' de ', {ES}) END AS date_text
  FROM {{orders}}) x"""
ANCHOR = "1995-01-01"


def anchor():
    return F.lit(ANCHOR).cast("date")


def texts(spark, d):
    return spread(derive(spark, d, TEXTS))


def found(spark, d):
    return t.events(texts(spark, d).select("doc_id", "text"), anchor())


def solved(spark, d):
    return t.resolve(found(spark, d), ANCHOR)


def absolute_dates(spark, d):
    return t.absolute_dates(texts(spark, d), anchor()).filter("confidence > 0.8").select("doc_id", "original", "event_date", "confidence")


def infer_year(spark, d):
    return t.absolute_dates(texts(spark, d), anchor()).filter("confidence < 0.8").select("doc_id", "original", "event_date", "confidence")


def relative_dates(spark, d):
    return t.relative_dates(texts(spark, d)).select("doc_id", "original", "offset_days", "dependency")


def durations(spark, d):
    return t.durations(texts(spark, d)).select("doc_id", "original", "value", "unit", "days")


def project_duration(spark, d):
    return t.project_duration(t.durations(texts(spark, d)))


def context_window(spark, d):
    return texts(spark, d).select("doc_id", t.context_window(F.col("text"), F.upper("date_text"), 20).alias("context"))


def describe_event(spark, d):
    return found(spark, d).select("doc_id", "original", "description")


def classify_event(spark, d):
    return found(spark, d).select("doc_id", "original", "event_type")


def critical_flag(spark, d):
    return found(spark, d).filter("is_critical").select("doc_id", "original")


def resolve_relative(spark, d):
    return solved(spark, d).filter("is_relative").select("doc_id", "original", "event_date")


def confidence_filter(spark, d):
    return t.keep_confident(found(spark, d), 0.75).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def order_events(spark, d):
    return t.in_order(solved(spark, d)).select("doc_id", "place", "original")


def split_events(spark, d):
    return t.split_events(solved(spark, d)).select("doc_id", "total_events", F.array_join("critical", ";").alias("critical"), F.array_join("unresolved", ";").alias("unresolved"), "warning")


def next_deadline(spark, d):
    return t.next_deadline(found(spark, d), F.lit("1998-01-01").cast("date"))


def validate_anchor(spark, d):
    a = derive(spark, d, "SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-04-01' WHEN 2 THEN '1/4/2024' ELSE NULL END AS anchor FROM {orders}")
    return a.select("seq", t.valid_anchor(F.col("anchor")).alias("anchor"), t.valid_anchor(F.col("anchor")).isNotNull().alias("valid"))


def report_timeline(spark, d):
    return t.reports(texts(spark, d).select("doc_id", "text"), ANCHOR)


QUERIES = {f.__name__: f for f in (
    absolute_dates, infer_year, relative_dates, durations, project_duration, context_window, describe_event, classify_event, critical_flag, resolve_relative, confidence_filter,
    order_events, split_events, next_deadline, validate_anchor, report_timeline)}

X = f"""x AS (SELECT *, CAST(o_orderdate AS DATE) AS od, date_text AS a, n || ' días después de la firma' AS r1, w || ' semanas antes de cierre total' AS r2, CAST(DATE '{ANCHOR}' + n AS DATE) AS d1,
  CASE WHEN kind < 4 THEN CAST(o_orderdate AS DATE) WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE make_date(1995, month(o_orderdate), day(o_orderdate)) END AS da FROM ({oracle(TEXTS)}))"""
EV = """ev AS (SELECT doc_id, 0 AS s, a AS original, 'Fecha de entrega: ' || a AS description, 'submission_deadline' AS event_type, da AS event_date, CASE WHEN kind < 4 THEN 0.9 ELSE 0.7 END AS confidence, true AS crit FROM x WHERE da IS NOT NULL
  UNION ALL SELECT doc_id, 1, r1, 'Evento: ' || r1, 'project_start', d1, 0.8, false FROM x UNION ALL SELECT doc_id, 2, r2, 'Evento: ' || r2, 'other', NULL, 0.8, false FROM x)"""
ORACLES = {
    "absolute_dates": f"WITH {X} SELECT doc_id, a AS original, da AS event_date, 0.9::DOUBLE AS confidence FROM x WHERE kind < 4",
    "infer_year": f"WITH {X} SELECT doc_id, a AS original, da AS event_date, 0.7::DOUBLE AS confidence FROM x WHERE kind = 4 AND da IS NOT NULL",
    "relative_dates": f"WITH {X} SELECT doc_id, r1 AS original, n AS offset_days, 'la firma' AS dependency FROM x UNION ALL SELECT doc_id, r2, CAST(-7 * w AS INT), 'cierre total' FROM x",
    "durations": f"WITH {X} SELECT doc_id, 'duración de ' || m || ' meses' AS original, m AS value, 'meses' AS unit, CAST(m * 30 AS INT) AS days FROM x",
    "project_duration": f"WITH {X} SELECT doc_id, CAST(m * 30 AS INT) AS days, CAST(m AS DOUBLE) AS months FROM x",
    "context_window": f"WITH {X} SELECT doc_id, trim(text[19:38 + length(a) + 20]) AS context FROM x",
    "describe_event": f"WITH {X}, {EV} SELECT doc_id, original, description FROM ev",
    "classify_event": f"WITH {X}, {EV} SELECT doc_id, original, event_type FROM ev",
    "critical_flag": f"WITH {X}, {EV} SELECT doc_id, original FROM ev WHERE crit",
    "resolve_relative": f"WITH {X}, {EV} SELECT doc_id, original, event_date FROM ev WHERE s > 0",
    "confidence_filter": f"WITH {X}, {EV} SELECT event_type, count(*) AS events FROM ev WHERE confidence >= 0.75 GROUP BY 1",
    "order_events": f"WITH {X}, {EV} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY event_date NULLS LAST, s) AS INT) AS place, original FROM ev",
    "split_events": f"""WITH {X}, {EV} SELECT doc_id, count(*) AS total_events, coalesce(string_agg(original, ';' ORDER BY s) FILTER (WHERE crit), '') AS critical, coalesce(string_agg(original, ';' ORDER BY s) FILTER (WHERE event_date IS NULL), '') AS unresolved,
      count(*) FILTER (WHERE event_date IS NULL) || ' evento(s) sin fecha' AS warning FROM ev GROUP BY 1""",
    "next_deadline": f"WITH {X}, {EV} SELECT doc_id, event_date, description FROM ev WHERE crit AND event_date >= DATE '1998-01-01'",
    "validate_anchor": "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 1 THEN DATE '2024-04-01' END AS anchor, o_orderkey % 4 = 1 AS valid FROM orders",
    "report_timeline": f"""WITH {X}, {EV}, l AS (SELECT doc_id, string_agg('| ' || coalesce(CAST(event_date AS VARCHAR), 'TBD') || ' | ' || description || ' | ' || event_type || ' | ' || CASE WHEN crit THEN '⚠️' ELSE '' END || ' |', chr(10) ORDER BY event_date NULLS LAST, s) AS lines FROM ev GROUP BY 1)
      SELECT doc_id, '## Cronograma del Proyecto' || chr(10) || chr(10) || '**Fecha base**: {ANCHOR}' || chr(10) || '**Duración estimada**: ' || m || '.0 meses' || chr(10) || chr(10) || '| Fecha | Evento | Tipo | Crítico |' || chr(10) || '|-------|--------|------|---------|' || chr(10) || lines AS report FROM l JOIN x USING (doc_id)""",
}
