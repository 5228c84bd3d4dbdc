"""Queries on risks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import compliance, risk
from telar.plans.inputs import RISKS, VERDICTS, derive, oracle

R, V = oracle(RISKS), oracle(VERDICTS)
W = "CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 5 WHEN 'high' THEN 15 ELSE 100 END"
PEN = f"CAST({W} * probability AS DECIMAL(18,6))"
SCORED = f"""scored AS (
  SELECT tender_id, coalesce(bool_or(severity = 'critical'), false) AS kill_switch, sum({PEN}) AS pen, count(*) AS total_risks,
    CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high_risks,
    coalesce(list(description ORDER BY seq) FILTER (WHERE severity = 'critical'), []) AS critical_flags
  FROM risks GROUP BY tender_id),
s2 AS (SELECT *, CASE WHEN kill_switch THEN 0 ELSE greatest(0, 100 - pen) END AS raw FROM scored),
s3 AS (SELECT *, printf('%.1f', CAST(round_even(raw, 1) AS DOUBLE)) AS shown, CAST(round_even(raw, 2) AS DOUBLE) AS total_score,
  CASE WHEN kill_switch THEN 'NO_GO' WHEN raw >= 70 THEN 'GO' WHEN raw >= 40 THEN 'REVIEW' ELSE 'NO_GO' END AS recommendation FROM s2),
final AS (SELECT *, CASE WHEN kill_switch THEN 'Kill Switch activado: ' || len(critical_flags) || ' riesgo(s) CRÍTICO(s) detectado(s). La propuesta no es viable.'
   WHEN raw >= 70 AND high_risks > 0 THEN 'Score favorable (' || shown || '), pero revisar ' || high_risks || ' riesgo(s) alto(s).'
   WHEN raw >= 70 THEN 'Propuesta viable con score de ' || shown || '/100.'
   WHEN raw >= 40 THEN 'Score moderado (' || shown || '). Se requiere revisión manual antes de decidir.'
   ELSE 'Score insuficiente (' || shown || '). La acumulación de riesgos desaconseja presentarse.' END AS reason FROM s3)"""
BREAK = f"""cats AS (SELECT * FROM (VALUES (0, 'financial'), (1, 'legal'), (2, 'technical'), (3, 'reputational')) t(category_order, category)),
kills AS (SELECT tender_id, bool_or(severity = 'critical') AS kill FROM risks GROUP BY tender_id),
sums AS (SELECT tender_id, category, sum({PEN}) AS p, count(*) AS n FROM risks GROUP BY 1, 2),
breakdown AS (SELECT k.tender_id, CAST(category_order AS INT) AS category_order, c.category,
  round(CASE WHEN kill THEN CASE WHEN coalesce(n, 0) > 0 THEN 0.0 ELSE 100.0 END ELSE CAST(greatest(0, 100 - coalesce(p, 0)) AS DOUBLE) END, 6) AS score,
  coalesce(n, 0) AS risk_count,
  round(CASE WHEN kill THEN CASE WHEN coalesce(n, 0) > 0 THEN 100.0 ELSE 0.0 END ELSE CAST(coalesce(p, 0) AS DOUBLE) END, 6) AS total_penalty
  FROM kills k CROSS JOIN cats c LEFT JOIN sums s ON s.tender_id = k.tender_id AND s.category = c.category)"""
RAW = """
SELECT o_custkey AS tender_id, o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' ELSE concat('risk ', CAST(o_orderkey AS STRING)) END AS description,
  CASE o_orderkey % 5 WHEN 0 THEN 'FINANCIAL' WHEN 1 THEN 'Legal' WHEN 2 THEN 'reputation' WHEN 3 THEN 'technical' ELSE 'timeline' END AS category,
  CASE o_orderkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN 'severe' WHEN 3 THEN 'Medium' WHEN 4 THEN 'critical' ELSE 'high' END AS severity,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '1.5' WHEN 2 THEN 'often' ELSE '0.25' END AS probability
FROM {orders}"""


def risks(spark, d):
    return derive(spark, d, RISKS)


def verdicts(spark, d):
    return derive(spark, d, VERDICTS)


def scores(spark, d):
    return risk.score_tenders(risks(spark, d))


def risk_score(spark, d):
    return scores(spark, d).select("tender_id", "total_score", "recommendation", "reason", "kill_switch", "total_risks", "high_risks")


def kill_switch(spark, d):
    return scores(spark, d).filter("kill_switch").select("tender_id", "total_score", "recommendation", F.array_join("critical_flags", "; ").alias("critical_flags"))


def recommendation(spark, d):
    return scores(spark, d).groupBy("recommendation").agg(F.count(F.lit(1)).alias("tenders"), F.sum("total_risks").alias("risks"))


def category_breakdown(spark, d):
    return risk.category_breakdown(risks(spark, d))


def risk_matrix(spark, d):
    return risk.risk_matrix(risks(spark, d)).withColumn("risks", F.array_join("risks", "; "))


def empty_risks(spark, d):
    return risk.with_empty(derive(spark, d, "SELECT c_custkey AS tender_id FROM {customer}"), risks(spark, d))


def validate_risk(spark, d):
    return risk.validate_risks(derive(spark, d, RAW))


def gate_decision(spark, d):
    return risk.gate(scores(spark, d)).withColumn("issues", F.array_join("issues", "\n"))


AUDITS = """
SELECT o_orderkey AS query_id, CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'extreme' WHEN 2 THEN NULL ELSE 'high' END AS risk_level,
  CASE o_orderkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'ok' ELSE 'pending' END AS compliance_status,
  concat(CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Lista SOLO problemas' ELSE 'sin cita' END, ';', 'monto ', CAST(o_orderkey AS STRING)) AS issue_text,
  concat(CASE o_orderkey % 4 WHEN 0 THEN 'corta' WHEN 1 THEN 'Hubo un Error al consultar el indice de documentos de la licitacion' WHEN 2 THEN 'Lo siento: no hay documentos cargados en el sistema, suba el pliego antes' ELSE 'El presupuesto es de cinco millones segun la seccion tres del pliego' END) AS answer,
  o_orderkey % 7 <> 0 AS parsed
FROM {orders}"""


def clean_issues(spark, d):
    df = derive(spark, d, AUDITS).withColumn("issues", F.split("issue_text", ";"))
    return risk.clean_issues(df).select("query_id", "risk_level", "compliance_status", F.array_join("issues", ";").alias("issues"))


def audit_bypass(spark, d):
    return risk.audit_bypass(derive(spark, d, AUDITS).select("query_id", "answer", "parsed")).select("query_id", "route", "risk_level", "compliance_status")


def report_risk(spark, d):
    r = risks(spark, d)
    return risk.report(risk.score_tenders(r), risk.category_breakdown(r))


def detect_severity(spark, d):
    return verdicts(spark, d).select("seq", compliance.detect_severity(F.col("requirement_text")).alias("severity"))


REQS = """
SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN '   corto   ' ELSE 'El proveedor debe cumplir' END AS requirement_text, CAST(o_orderkey % 9 AS INT) AS page,
  CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'contexto de la empresa' END AS context, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'legal' WHEN 2 THEN 'otros' ELSE 'experience' END AS category
FROM {orders}"""


def validate_requirement(spark, d):
    return compliance.validate_requirements(derive(spark, d, REQS)).select("seq", "valid", "reject_reason")


def parsed(spark, d):
    return compliance.parse_verdicts(verdicts(spark, d).select("tender_id", "seq", "page", "reply", "requirement_text"))


def parse_json(spark, d):
    j = compliance.json_object(compliance.strip_fences(F.concat(F.lit("```json\n"), "reply", F.lit("\n```"))))
    return verdicts(spark, d).select("seq", F.get_json_object(j, "$.status").alias("status"), F.get_json_object(j, "$.confidence_score").cast("double").alias("confidence"))


def parse_verdict(spark, d):
    return parsed(spark, d).filter("parsed").select("seq", "status", "severity", "confidence", "reasoning")


def failed_verdict(spark, d):
    return compliance.failed_verdicts(parsed(spark, d)).select("seq", "parsed", "status", "severity", "confidence")


def showstoppers(spark, d):
    return verdicts(spark, d).filter(compliance.is_showstopper()).select("tender_id", "seq", "page")


def audit_rollup(spark, d):
    out = compliance.roll_up(verdicts(spark, d), derive(spark, d, "SELECT c_custkey AS tender_id FROM {customer}"))
    return out.withColumn("showstoppers", F.array_join(F.transform("showstoppers", lambda x: x.cast("string")), ","))


def report_audit(spark, d):
    return verdicts(spark, d).select("seq", compliance.verdict_line().alias("line"))


QUERIES = {f.__name__: f for f in (
    risk_score, kill_switch, recommendation, category_breakdown, risk_matrix, empty_risks, validate_risk, gate_decision, clean_issues, audit_bypass, report_risk,
    detect_severity, validate_requirement, parse_json, parse_verdict, failed_verdict, showstoppers, audit_rollup, report_audit)}

SEV = """CASE WHEN regexp_matches(lower(requirement_text), 'debe|obligatori|excluyente|indispensable|imprescindible|requisito|necesari|requerid|shall|must|required|mandatory|essential|necessary|obligation|compulsory') THEN 'mandatory'
  WHEN regexp_matches(lower(requirement_text), 'valorará|valorara|deseable|preferible|preferente|opcional|adicional|plus|ventaja|puntuará|bonificación|mejora|should|may|desirable|preferred|optional|bonus|advantage|recommended') THEN 'desirable' ELSE 'mandatory' END"""
PARSED = f"""v AS ({V}), p AS (SELECT *, seq % 13 <> 0 AS parsed, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS j FROM v),
q AS (SELECT seq, parsed, requirement_text, CASE WHEN parsed THEN lower(json_extract_string(j, '$.status')) END AS st, CASE WHEN parsed THEN json_extract_string(j, '$.severity_detected') END AS sv,
  CASE WHEN parsed THEN CAST(json_extract_string(j, '$.confidence_score') AS DOUBLE) END AS cf FROM p),
verdict AS (SELECT seq, parsed, CASE WHEN st IN ('compliant', 'non_compliant', 'partial', 'missing_info') THEN st ELSE 'missing_info' END AS status,
  CASE WHEN sv IS NULL THEN {SEV} WHEN sv = 'desirable' THEN 'desirable' ELSE 'mandatory' END AS severity, coalesce(cf, 0.7) AS confidence FROM q)"""
LIGHT = "CASE recommendation WHEN 'GO' THEN '🟢' WHEN 'REVIEW' THEN '🟡' ELSE '🔴' END"
ORACLES = {
    "risk_score": f"WITH risks AS ({R}), {SCORED} SELECT tender_id, total_score, recommendation, reason, kill_switch, total_risks, high_risks FROM final",
    "kill_switch": f"WITH risks AS ({R}), {SCORED} SELECT tender_id, total_score, recommendation, array_to_string(critical_flags, '; ') AS critical_flags FROM final WHERE kill_switch",
    "recommendation": f"WITH risks AS ({R}), {SCORED} SELECT recommendation, count(*) AS tenders, CAST(sum(total_risks) AS BIGINT) AS risks FROM final GROUP BY 1",
    "category_breakdown": f"WITH risks AS ({R}), {BREAK} SELECT * FROM breakdown",
    "risk_matrix": f"""WITH risks AS ({R}), cells AS (SELECT *, CASE WHEN severity IN ('high', 'critical') THEN 'high' ELSE severity END AS impact,
      CASE WHEN probability < 0.33 THEN 'low' WHEN probability < 0.66 THEN 'medium' ELSE 'high' END AS probability_level FROM risks)
      SELECT tender_id, impact, probability_level, string_agg(description, '; ' ORDER BY seq) AS risks,
      CASE WHEN impact || probability_level IN ('lowhigh', 'mediummedium', 'highlow') THEN 'yellow' WHEN impact || probability_level IN ('mediumhigh', 'highmedium', 'highhigh') THEN 'red' ELSE 'green' END AS colour
      FROM cells GROUP BY tender_id, impact, probability_level""",
    "empty_risks": f"""WITH risks AS ({R}), {SCORED} SELECT c_custkey AS tender_id, coalesce(total_score, 100.0) AS total_score, coalesce(recommendation, 'GO') AS recommendation,
      coalesce(reason, 'No se detectaron riesgos.') AS reason, coalesce(total_risks, 0) AS total_risks FROM customer LEFT JOIN final ON tender_id = c_custkey""",
    "validate_risk": f"""WITH raw AS ({oracle(RAW)}), c AS (SELECT *, lower(severity) IN ('low', 'medium', 'high', 'critical') AS gs, lower(category) IN ('financial', 'legal', 'technical', 'reputational') AS gc,
      CASE WHEN probability IS NULL THEN 0.5 ELSE TRY_CAST(probability AS DOUBLE) END AS p FROM raw)
      SELECT tender_id, seq, description, CASE WHEN gc THEN lower(category) ELSE 'financial' END AS category, CASE WHEN gs THEN lower(severity) ELSE 'medium' END AS severity,
      p AS probability, NOT (gs AND gc) AS coerced, length(description) >= 5 AND coalesce(p BETWEEN 0 AND 1, false) AS valid FROM c""",
    "gate_decision": f"""WITH risks AS ({R}), {SCORED} SELECT tender_id, CASE WHEN total_score < 40 THEN 'critical' WHEN total_score < 70 THEN 'high' WHEN recommendation = 'GO' THEN 'low' ELSE 'medium' END AS risk_level,
      CASE recommendation WHEN 'GO' THEN 'approved' WHEN 'REVIEW' THEN 'pending' ELSE 'rejected' END AS compliance_status, recommendation <> 'NO_GO' AS gate_passed,
      '[RiskScore] Score: ' || total_score || '/100. Rec: ' || recommendation || CASE WHEN kill_switch THEN chr(10) || '[RiskScore] KILL SWITCH ACTIVATED: ' || reason ELSE '' END AS issues FROM final""",
    "clean_issues": f"""WITH a AS ({oracle(AUDITS)}) SELECT query_id, CASE WHEN risk_level IN ('low', 'medium', 'high', 'critical') THEN risk_level ELSE 'medium' END AS risk_level,
      CASE WHEN compliance_status IN ('approved', 'pending', 'rejected') THEN compliance_status ELSE 'approved' END AS compliance_status,
      CASE WHEN query_id % 4 IN (0, 1) THEN split_part(issue_text, ';', 2) ELSE issue_text END AS issues FROM a""",
    "audit_bypass": f"""WITH a AS ({oracle(AUDITS)}), b AS (SELECT *, CASE WHEN length(answer) < 50 OR contains(lower(answer), 'error') OR contains(lower(answer), 'no hay documentos') THEN 'bypass' WHEN NOT parsed THEN 'unparsed' ELSE 'audit' END AS route FROM a)
      SELECT query_id, route, CASE route WHEN 'bypass' THEN 'low' WHEN 'unparsed' THEN 'medium' END AS risk_level, CASE WHEN route <> 'audit' THEN 'approved' END AS compliance_status FROM b""",
    "report_risk": f"""WITH risks AS ({R}), {SCORED}, {BREAK}, rows_ AS (SELECT tender_id, string_agg('| ' || upper(category[1]) || category[2:] || ' | ' || printf('%.1f', CAST(round_even(CAST(score AS DECIMAL(18,6)), 1) AS DOUBLE)) || ' | ' || risk_count || ' | -' || printf('%.1f', CAST(round_even(CAST(total_penalty AS DECIMAL(18,6)), 1) AS DOUBLE)) || ' |', chr(10) ORDER BY category_order) AS lines FROM breakdown GROUP BY 1)
      SELECT tender_id, {LIGHT} AS light,
      {LIGHT} || ' Score: ' || shown || '/100 | Rec: ' || recommendation || ' | Riesgos: ' || total_risks || ' (' || CASE WHEN kill_switch THEN '⚠️ Kill Switch' ELSE 'Normal' END || ')' AS summary,
      '## Resultado de Evaluación de Viabilidad' || chr(10) || chr(10) || '**Score Total**: ' || shown || '/100 ' || {LIGHT} || chr(10) || '**Recomendación**: ' || recommendation || chr(10) || '**Razón**: ' || reason || chr(10) || chr(10)
      || CASE WHEN kill_switch THEN '### ⚠️ Kill Switch Activado' || chr(10) || 'Los siguientes riesgos críticos descalifican la propuesta:' || chr(10) || chr(10) || array_to_string(list_transform(critical_flags, lambda f: '- 🔴 ' || f), chr(10)) || chr(10) || chr(10) ELSE '' END
      || '### Desglose por Categoría' || chr(10) || chr(10) || '| Categoría | Score | Riesgos | Penalización |' || chr(10) || '|-----------|-------|---------|--------------|' || chr(10) || lines AS report
      FROM final JOIN rows_ USING (tender_id)""",
    "detect_severity": f"WITH v AS ({V}) SELECT seq, {SEV} AS severity FROM v",
    "validate_requirement": f"""WITH r AS ({oracle(REQS)}), x AS (SELECT seq, CASE WHEN length(trim(requirement_text)) < 10 THEN 'requirement_text' WHEN length(trim(coalesce(context, ''))) < 10 THEN 'context' WHEN page < 1 THEN 'page'
      WHEN category NOT IN ('legal', 'technical', 'financial', 'administrative', 'experience', 'certification', 'other') THEN 'category' END AS reject_reason FROM r) SELECT seq, reject_reason IS NULL AS valid, reject_reason FROM x""",
    "parse_json": f"WITH {PARSED} SELECT seq, CASE WHEN parsed THEN json_extract_string(j, '$.status') END AS status, CASE WHEN parsed THEN CAST(json_extract_string(j, '$.confidence_score') AS DOUBLE) END AS confidence FROM p",
    "parse_verdict": f"WITH {PARSED} SELECT seq, status, severity, confidence, '{compliance.NO_REASON}' AS reasoning FROM verdict WHERE parsed",
    "failed_verdict": f"WITH {PARSED} SELECT seq, parsed, CASE WHEN parsed THEN status ELSE 'missing_info' END AS status, CASE WHEN parsed THEN severity ELSE 'mandatory' END AS severity, CASE WHEN parsed THEN confidence ELSE 0.0 END AS confidence FROM verdict",
    "showstoppers": f"WITH v AS ({V}) SELECT tender_id, seq, page FROM v WHERE severity = 'mandatory' AND status = 'non_compliant'",
    "audit_rollup": f"""WITH v AS ({V}), s AS (SELECT tender_id, count(*) AS n, count(*) FILTER (WHERE status = 'compliant') AS c, count(*) FILTER (WHERE status = 'non_compliant') AS x,
      string_agg(CAST(seq AS STRING), ',' ORDER BY seq) FILTER (WHERE severity = 'mandatory' AND status = 'non_compliant') AS ss FROM v GROUP BY 1)
      SELECT c_custkey AS tender_id, coalesce(n, 0) AS total_requirements, coalesce(c, 0) AS compliant_count, coalesce(x, 0) AS non_compliant_count, coalesce(ss, '') AS showstoppers,
      CASE WHEN ss IS NOT NULL THEN 'non_compliant' WHEN coalesce(x, 0) > 0 THEN 'partial' WHEN coalesce(c, 0) = coalesce(n, 0) THEN 'compliant' ELSE 'partial' END AS overall_status FROM customer LEFT JOIN s ON tender_id = c_custkey""",
    "report_audit": f"""WITH v AS ({V}) SELECT seq, CASE status WHEN 'compliant' THEN '🟢' WHEN 'non_compliant' THEN '🔴' WHEN 'partial' THEN '🟡' ELSE '⚪' END || ' ' || upper(status) || ' | ' || CASE severity WHEN 'mandatory' THEN '⚠️ OBLIGATORIO' ELSE '📊 Puntuable' END
      || ' | Pág. ' || page || ' | Confianza: ' || (50 + seq % 50) || '%' AS line FROM v""",
}
