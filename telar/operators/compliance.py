"""Requirement audits: severity, verdicts parsed from replies, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that make a requirement mandatory or desirable, and the known categories and statuses.
MANDATORY = [
    "debe", "deberá", "deberán", "obligatorio", "obligatoria", "excluyente", "indispensable", "imprescindible", "requisito",
    "necesario", "necesaria", "requerido", "requerida", "shall", "must", "required", "mandatory", "essential", "necessary",
    "obligation", "compulsory",
]
DESIRABLE = [
    "valorará", "valorara", "deseable", "preferible", "preferente", "opcional", "adicional", "plus", "ventaja", "puntuará",
    "bonificación", "mejora", "should", "may", "desirable", "preferred", "optional", "bonus", "advantage", "recommended",
]
REQUIREMENT_CATEGORIES = ["legal", "technical", "financial", "administrative", "experience", "certification", "other"]
STATUSES = ["compliant", "non_compliant", "partial", "missing_info"]
SIGNS = {"compliant": "🟢", "non_compliant": "🔴", "partial": "🟡", "missing_info": "⚪"}
NO_REASON = "Sin razonamiento proporcionado."


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words as a substring."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def detect_severity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, MANDATORY), "mandatory").when(any_of(low, DESIRABLE), "desirable").otherwise("mandatory")


def validate_requirements(reqs: DataFrame) -> DataFrame:
    """valid, reject_reason: text and context of 10 characters or more, page 1 or more, a known category or none."""
    short = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < 10
    reason = (
        F.when(short("requirement_text"), "requirement_text").when(short("context"), "context").when(F.coalesce(F.col("page") < 1, F.lit(True)), "page")
        .when(F.col("category").isNotNull() & ~F.col("category").isin(*REQUIREMENT_CATEGORIES), "category"))
    return reqs.withColumns({"reject_reason": reason, "valid": reason.isNull()})


REPLY = "status string, severity_detected string, confidence_score double, reasoning string, gap_analysis string, evidence_found string"


def json_object(reply: Column) -> Column:
    """From the first { to the last }, null where there is none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def strip_fences(reply: Column) -> Column:
    """A reply without the ``` fences around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(json)?\s*", ""), r"\s*```$", ""))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Verdicts from reply texts; `parsed` is false where there is no usable JSON object."""
    r = F.from_json(json_object(F.col("reply")), REPLY)
    out = replies.withColumn("r", r).withColumn("parsed", F.coalesce(
        F.expr("try_parse_json(regexp_extract(reply, '(?s)\\\\{.*\\\\}', 0)) IS NOT NULL"), F.lit(False)))
    status, sev = F.lower("r.status"), F.lower("r.severity_detected")
    given = F.coalesce(F.col("r.severity_detected") != "", F.lit(False))
    return out.withColumns({
        "status": F.when(F.coalesce(status.isin(*STATUSES), F.lit(False)), status).otherwise("missing_info"),
        "severity": F.when(~given, detect_severity(F.col("requirement_text"))).when(sev == "desirable", "desirable").otherwise("mandatory"),
        "confidence": F.coalesce("r.confidence_score", F.lit(0.7)), "reasoning": F.coalesce("r.reasoning", F.lit(NO_REASON)),
        "gap_analysis": F.col("r.gap_analysis"), "evidence_found": F.col("r.evidence_found")}).drop("r")


def failed_verdicts(parsed: DataFrame) -> DataFrame:
    """Requirements whose reply could not be parsed count as missing information, mandatory, confidence 0."""
    ok = F.col("parsed")
    return parsed.withColumns({
        "status": F.when(ok, F.col("status")).otherwise("missing_info"), "severity": F.when(ok, F.col("severity")).otherwise("mandatory"),
        "confidence": F.when(ok, F.col("confidence")).otherwise(0.0)})


def is_showstopper() -> Column:
    return (F.col("severity") == "mandatory") & (F.col("status") == "non_compliant")


def roll_up(verdicts: DataFrame, tenders: DataFrame | None = None) -> DataFrame:
    """Counts, showstoppers and overall status per tender; a tender without verdicts is compliant."""
    n = lambda c: F.sum(c.cast("long"))
    per = verdicts.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("total_requirements"), n(F.col("status") == "compliant").alias("compliant_count"), n(F.col("status") == "non_compliant").alias("non_compliant_count"),
        F.array_sort(F.collect_list(F.when(is_showstopper(), F.col("seq")))).alias("showstoppers"))
    if tenders is not None:
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        per = tenders.select("tender_id").distinct().join(per, "tender_id", "left").select(
            "tender_id", zero("total_requirements"), zero("compliant_count"), zero("non_compliant_count"), F.coalesce("showstoppers", F.array().cast("array<bigint>")).alias("showstoppers"))
    overall = (
        F.when(F.size("showstoppers") > 0, "non_compliant").when(F.col("non_compliant_count") > 0, "partial")
        .when(F.col("compliant_count") == F.col("total_requirements"), "compliant").otherwise("partial"))
    return per.withColumn("overall_status", overall)


def verdict_line() -> Column:
    sign = F.lit("⚪")
    for s, mark in SIGNS.items():
        sign = F.when(F.col("status") == s, mark).otherwise(sign)
    label = F.when(F.col("severity") == "mandatory", "⚠️ OBLIGATORIO").otherwise("📊 Puntuable")
    return F.format_string("%s %s | %s | Pág. %d | Confianza: %d%%", sign, F.upper("status"), label, F.col("page"), F.bround((F.col("confidence") * 100).cast("decimal(9,4)"), 0).cast("int"))
