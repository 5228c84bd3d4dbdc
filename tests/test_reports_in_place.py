"""Timeline reports of documents that come in one row or in several, short and long, against the path that deals all of them; and the passes over a text."""

import datetime
import re

from pyspark.sql import functions as F

from telar.operators import timeline

DAY = "2024-04-01"
TEXT = "La oferta vence el 15/05/2024 a las diez.\nAbono 30 días después de la firma\nduración de {} meses\nTaller 2 semanas antes de la oferta\n5 dias del inicio, al los 4 días de la oferta\n29 de febrero"


def dealt(docs):
    found = timeline.resolve(timeline.events(docs, F.lit(DAY).cast("date")), DAY)
    return timeline.report(found, timeline.project_duration(timeline.durations(docs)), DAY)


def test_reports(spark):
    long = "\n".join(f"{1 + i % 28} de mayo de 20{10 + i % 80}: entrega\n{i} días después de entrega" for i in range(300))
    rows = [(i, TEXT.format(i)) for i in range(50)] + [(60, long), (61, None), (62, ""), (63, "sin fechas"), (64, "El 3 de mayo hay reunión"), (None, "El 4 de mayo de 2024"), (None, "El 5 de mayo de 2024")]
    rows += [(7, "Otra parte: 1 de enero de 2023, 3 días después de la oferta"), (8, TEXT.format(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(str, dealt(docs.filter("doc_id NOT IN (7, 8)")).collect()))  # ties in seq of several rows are open
    got = timeline.reports(docs, DAY).collect()
    assert sorted(str(r) for r in got if r["doc_id"] not in (7, 8, None)) == want
    assert {7, 8, None} <= {r["doc_id"] for r in got} and len(got) == len({r["doc_id"] for r in got}) == 53
    plan = timeline.reports(docs.filter("doc_id NOT IN (7, 8)"), DAY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Window" not in plan  # the only one is that of the input


def test_heads_lose_no_relative_expression(spark):
    """Every pattern alone, tried on the whole text, finds what relative() finds."""
    texts = [TEXT.format(3), "dentro de al los 4 días de la oferta", "12días después firma; 3 semanas luego del acto", "4 meses\n tras el acto", "7 days after award", "9 weeks prior to x", "10 days prior to the end", "5 día antes de hoy", "5  díasantes x",
             "1 semana post firma y 2 semanas antes del cierre", "a 3 día del fin", "x 33 meses despues de y, 4 week before z", "٣ días después de la firma", "8 días después del acto", "0 days from 5 weeks after 6 days before k"]
    low = F.lower("text")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = docs.select("doc_id", F.transform(timeline.relative(low), lambda e: e["original"]).alias("x")).collect()
    want = docs.select("doc_id", F.concat(*[F.regexp_extract_all(low, F.lit("(?U)" + r[0]), F.lit(0)) for r in timeline.RELATIVE]).alias("x")).collect()
    assert sorted(got) == sorted(want) and sum(len(r["x"]) for r in want) >= 18


def test_date_looks_lose_no_date(spark):
    """The looks ahead of DATE only save time: the alternatives alone find the same."""
    texts = ["vence el 15/05/2024, 2024-5-6 y 3 DE MARZO DE 2024.", "Mayo 2025; may 3, 2024; 12 setiembre", "x15/05/2024 no, é3 de mayo sí?", "٣ de mayo, １２/0１/２０２４", "ſeptiembre 2024 y 4 de ſeptiembre", "juni 2024 junio 2024 JUNIO DEL 2024 dec 2024 december 2024", "𝟏𝟐/05/2024"]
    plain = "(?iU)\\b" + timeline.DATE[re.search(r"\(\?:\\d\{1,2\}\[/-\]", timeline.DATE).start() :]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select(F.regexp_extract_all("text", F.lit(timeline.DATE), F.lit(0)).alias("got"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("want")).collect():
        assert r["got"] == r["want"]


def test_durations_of_all_patterns(spark):
    docs = spark.createDataFrame([(1, "Duración de 12 meses, vigencia 3 años; 5 semanas de vigencia. Duration: 4 weeks, 6 months term"), (2, "durará 40 dias, 7 meses de duración")], "doc_id long, text string")
    got = sorted(r[:] for r in timeline.durations(docs).select("doc_id", "value", "unit", "days").collect())
    assert got == [(1, 3, "años", 1095), (1, 4, "weeks", 28), (1, 5, "semanas", 35), (1, 6, "months", 180), (1, 12, "meses", 360), (2, 7, "meses", 210), (2, 40, "dias", 40)]
