"""Queries on technology mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import tech
from telar.plans.inputs import derive, oracle, spread

# phrase number: surface, name, category, level, version, sentence
PHRASES = [
    ("Java", "Java", "language", "mandatory", "17", "El sistema debe usar Java 17 en el servidor."),
    ("k8s", "Kubernetes", "infrastructure", "mandatory", None, "Se requiere despliegue en k8s 1.28 obligatorio."),
    ("PostgreSQL", "PostgreSQL", "database", "nice_to_have", None, "Es deseable una base PostgreSQL en producción."),
    ("COBOL", None, None, None, None, "Ninguna palabra conocida por aquí."),
    ("spring boot", "Spring Boot", "framework", "mandatory", "3.2", "The services must be built with spring boot 3.2 today."),
    ("AngularJS", "AngularJS", "framework", "forbidden", None, "Migrar de AngularJS cuanto antes."),
    ("C#", "C#", "language", "mandatory", None, "Developers shall write C# daily."),
    ("golang", "Go", "language", "nice_to_have", None, "Experience with golang is a plus for bidders."),
    ("con Go", "Go", "language", "mandatory", None, "Se programará con Go el servicio."),
    ("ISO 27001", "ISO 27001", "security_cert", "mandatory", None, "Certificación ISO 27001 excluyente."),
    ("python", "Python", "language", "mandatory", ">=3.8", "Se exige python >=3.8 imprescindible."),
    ("MySQL", "MySQL", "database", "forbidden", "5", "Prohibido MySQL 5 en la entrega."),
    ("Scrum", "Scrum", "methodology", "mandatory", None, "Trabajo con Scrum semanal."),
    ("React.js", "React", "framework", "nice_to_have", None, "Optional: React.js components."),
    ("AWS", "AWS", "infrastructure", "mandatory", None, "Hosting en AWS requerido."),
    ("jira", "Jira", "tool", "nice_to_have", None, "Se valorará jira para gestión."),
]
CASE = lambda i: "CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN " + ("NULL" if p[i] is None else "'" + p[i] + "'") for k, p in enumerate(PHRASES)) + " END"
TEXTS = f"SELECT doc_id, CAST((doc_id - doc_id % 25) / 25 AS BIGINT) AS tender_id, concat('Pliego numero ', CAST(doc_id AS STRING), '. ', chr(10), {CASE(5)}, chr(10), 'Fin.') AS text FROM {{documents}}"
# two companies bid for each tender of 25 documents
BIDDER = lambda n: f"CASE CAST(tender_id + {n} AS BIGINT) % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' WHEN 2 THEN 'gama' ELSE 'delta' END"
BIDS = f"""WITH t AS (SELECT DISTINCT CAST((doc_id - doc_id % 25) / 25 AS BIGINT) AS tender_id FROM {{documents}})
SELECT tender_id, {BIDDER(0)} AS company FROM t UNION ALL SELECT tender_id, {BIDDER(3)} FROM t"""
COMPANIES = [("acme", ["Java", "Kubernetes", "MySQL", "Cobol"]), ("beta", ["python", "AWS", "React", "AngularJS", "Go"]), ("gama", []), ("delta", ["Scrum", "ISO 27001", "C#", "Spring Boot"])]


def texts(spark, d):
    return spread(derive(spark, d, TEXTS))


def found(spark, d):
    return tech.entities(texts(spark, d), ["tender_id", "doc_id"])


def per_tender(spark, d):
    return tech.entities(texts(spark, d).groupBy("tender_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text")), ["tender_id"])


def tech_mentions(spark, d):
    return tech.mentions(texts(spark, d), ["doc_id"]).select("doc_id", "raw", "offset")


def canonicalize(spark, d):
    return tech.canonicalize(tech.mentions(texts(spark, d), ["doc_id"])).select("doc_id", "raw", "name", "category")


def go_language(spark, d):
    return found(spark, d).filter("name = 'Go'").select("doc_id", "raw", "confidence")


def first_mention(spark, d):
    return per_tender(spark, d).groupBy("tender_id").agg(F.count(F.lit(1)).alias("names"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("list"))


def tech_context(spark, d):
    return found(spark, d).select("doc_id", "context")


def tech_version(spark, d):
    return found(spark, d).select("doc_id", "name", "version")


def requirement_level(spark, d):
    return found(spark, d).select("doc_id", "name", "level")


def stacked(spark, d):
    return tech.stacks(found(spark, d).withColumn("offset", F.col("doc_id")), ["tender_id"])


LEVELS = ("mandatory", "nice_to_have", "forbidden")


def listed(*columns):
    return [F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c) for c in columns]


def stacks_by_level(spark, d):
    return stacked(spark, d).select("tender_id", *listed(*LEVELS), "total")


def stacks_by_category(spark, d):
    s = tech.by_category(found(spark, d).withColumn("offset", F.col("doc_id")), ["tender_id"])
    return s.select("tender_id", "category", *listed("names", *LEVELS), "total")


def distinct_stacks(spark, d):
    s = stacked(spark, d)
    return s.select("tender_id", *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("mandatory", "nice_to_have", "forbidden")])


def compatibility(spark, d):
    companies = spark.createDataFrame(COMPANIES, "company string, stack array<string>")
    out = tech.compatibility(distinct_stacks(spark, d), companies, derive(spark, d, BIDS), ["tender_id"])
    return out.select("tender_id", "company", *[F.array_join(c, ",").alias(c) for c in ("matched", "missing", "extra", "conflicts")], "score", "has_blockers")


def stack_summary(spark, d):
    return distinct_stacks(spark, d).select("tender_id", tech.stack_sentence().alias("summary"))


def report_tech(spark, d):
    return tech.report(found(spark, d), ["doc_id"])


QUERIES = {f.__name__: f for f in (
    tech_mentions, canonicalize, go_language, first_mention, tech_context, tech_version, requirement_level, stacks_by_level, stacks_by_category, compatibility, stack_summary, report_tech)}

E = f"""t AS ({oracle(TEXTS)}), e AS (SELECT t.doc_id, t.tender_id, t.text, {CASE(0)} AS raw, {CASE(1)} AS name, {CASE(2)} AS category, {CASE(3)} AS level, {CASE(4)} AS version FROM t WHERE doc_id % 16 <> 3)"""
STACK = """st AS (SELECT tender_id, coalesce(list_sort(list_distinct(list(name) FILTER (WHERE level = 'mandatory'))), []) AS mandatory, coalesce(list_sort(list_distinct(list(name) FILTER (WHERE level = 'nice_to_have'))), []) AS nice_to_have,
  coalesce(list_sort(list_distinct(list(name) FILTER (WHERE level = 'forbidden'))), []) AS forbidden, count(*) AS total FROM e GROUP BY 1)"""
COMP = "comp(company, stack) AS (VALUES " + ", ".join(f"('{c}', {s if s else 'CAST([] AS VARCHAR[])'})" for c, s in COMPANIES) + ")"
ORACLES = {
    "tech_mentions": f"WITH {E} SELECT doc_id, raw, CAST(strpos(text, raw) - 1 AS INT) AS \"offset\" FROM e WHERE raw <> 'con Go'",
    "canonicalize": f"WITH {E} SELECT doc_id, raw, name, category FROM e WHERE raw <> 'con Go'",
    "go_language": f"WITH {E} SELECT doc_id, raw, CASE raw WHEN 'golang' THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM e WHERE name = 'Go'",
    "first_mention": f"WITH {E} SELECT tender_id, count(DISTINCT name) AS names, array_to_string(list_sort(list_distinct(list(name))), ',') AS list FROM e GROUP BY 1",
    "tech_context": f"WITH {E}, p AS (SELECT *, strpos(text, raw) - 1 AS o FROM e) SELECT doc_id, trim(text[greatest(o - 50, 0) + 1:o + length(raw) + 50]) AS context FROM p",
    "tech_version": f"WITH {E} SELECT doc_id, name, version FROM e",
    "requirement_level": f"WITH {E} SELECT doc_id, name, level FROM e",
    "stacks_by_level": f"WITH {E}, {STACK} SELECT tender_id, array_to_string(mandatory, ',') AS mandatory, array_to_string(nice_to_have, ',') AS nice_to_have, array_to_string(forbidden, ',') AS forbidden, total FROM st",
    "stacks_by_category": f"""WITH {E}, l AS (SELECT tender_id, category, list(name) AS names, list(name) FILTER (WHERE level = 'mandatory') AS mandatory, list(name) FILTER (WHERE level = 'nice_to_have') AS nice_to_have,
      list(name) FILTER (WHERE level = 'forbidden') AS forbidden, count(*) AS total FROM e GROUP BY 1, 2)
      SELECT tender_id, category, """ + ", ".join(f"array_to_string(coalesce(list_sort(list_distinct({c})), []), ',') AS {c}" for c in ("names", *LEVELS)) + ", total FROM l",
    "compatibility": f"""WITH {E}, {STACK}, {COMP}, b AS ({oracle(BIDS)}), x AS (SELECT tender_id, company, mandatory, stack, list_transform(stack, lambda s: lower(s)) AS have, forbidden FROM st JOIN b USING (tender_id) JOIN comp USING (company)),
      y AS (SELECT *, list_filter(mandatory, lambda m: list_contains(have, lower(m))) AS matched, list_filter(mandatory, lambda m: NOT list_contains(have, lower(m))) AS missing,
      list_filter(stack, lambda s: NOT list_contains(list_transform(mandatory, lambda m: lower(m)), lower(s))) AS extra, list_filter(forbidden, lambda f: list_contains(have, lower(f))) AS conflicts FROM x),
      z AS (SELECT *, CASE WHEN len(mandatory) = 0 THEN 1.0 ELSE len(matched)::DOUBLE / len(mandatory) END AS raw FROM y)
      SELECT tender_id, company, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, array_to_string(conflicts, ',') AS conflicts,
      round_even(greatest(0.0, raw - 0.3 * len(conflicts)), 2) AS score, len(conflicts) > 0 AS has_blockers FROM z""",
    "stack_summary": f"""WITH {E}, {STACK}, p AS (SELECT tender_id, CASE WHEN len(mandatory) > 0 THEN 'Stack requerido: ' || array_to_string(mandatory[1:5], ', ') || CASE WHEN len(mandatory) > 5 THEN ' (+' || (len(mandatory) - 5) || ' más)' ELSE '' END END AS a,
      CASE WHEN len(nice_to_have) > 0 THEN 'Deseable: ' || array_to_string(nice_to_have[1:3], ', ') END AS b, CASE WHEN len(forbidden) > 0 THEN 'Prohibido: ' || array_to_string(forbidden, ', ') END AS c FROM st)
      SELECT tender_id, CASE WHEN coalesce(a, b, c) IS NULL THEN 'No se detectaron tecnologías.' ELSE concat_ws('. ', a, b, c) || '.' END AS summary FROM p""",
    "report_tech": f"""WITH {E}, l AS (SELECT *, '- ' || CASE level WHEN 'mandatory' THEN '✅' WHEN 'nice_to_have' THEN '💡' ELSE '🚫' END || ' ' || name || coalesce(' ' || version, '') || ' [' || category || '] - ' || level AS line FROM e)
      SELECT doc_id, '## Análisis de Stack Tecnológico' || chr(10) || chr(10) || '**Total detectado**: 1 tecnologías' || chr(10) || chr(10) || '### Stack Obligatorio' || chr(10) || CASE WHEN level = 'mandatory' THEN line ELSE '- Ninguno detectado' END
      || chr(10) || chr(10) || '### Tecnologías Deseables' || chr(10) || CASE WHEN level = 'nice_to_have' THEN line ELSE '- Ninguna' END || CASE WHEN level = 'forbidden' THEN chr(10) || chr(10) || '### ⚠️ Tecnologías Prohibidas' || chr(10) || line ELSE '' END AS report FROM l""",
}
