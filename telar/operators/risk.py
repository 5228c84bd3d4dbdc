"""Bid viability: weighted risk scores, kill switch, recommendation, breakdown, matrix and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, severities with their weights, thresholds and matrix colours.
CATEGORIES = ["financial", "legal", "technical", "reputational"]
WEIGHTS = {"low": 2, "medium": 5, "high": 15, "critical": 100}
GO, REVIEW = 70.0, 40.0
LOW_BELOW, MEDIUM_BELOW = 0.33, 0.66
COLOURS = [
    ("low", "low", "green"), ("low", "medium", "green"), ("low", "high", "yellow"),
    ("medium", "low", "green"), ("medium", "medium", "yellow"), ("medium", "high", "red"),
    ("high", "low", "yellow"), ("high", "medium", "red"), ("high", "high", "red"),
]
LIGHTS = {"GO": "🟢", "REVIEW": "🟡", "NO_GO": "🔴"}

MONEY = "decimal(18,6)"


def validate_risks(raw: DataFrame, default_probability: float = 0.5) -> DataFrame:
    """Risks with known severities and categories; `valid` is false for short descriptions and odd probabilities.

    Unknown severities become medium, unknown categories financial (`coerced` says so).
    """
    sev, cat = F.lower(F.trim("severity")), F.lower(F.trim("category"))
    good_sev, good_cat = F.coalesce(sev.isin(*WEIGHTS), F.lit(False)), F.coalesce(cat.isin(*CATEGORIES), F.lit(False))
    p = F.when(F.col("probability").isNull(), F.lit(default_probability)).otherwise(F.expr("try_cast(probability AS double)"))
    out = raw.withColumns({
        "severity": F.when(good_sev, sev).otherwise("medium"), "category": F.when(good_cat, cat).otherwise("financial"),
        "probability": p, "coerced": ~(good_sev & good_cat)})
    fine = (F.length(F.coalesce("description", F.lit(""))) >= 5) & F.coalesce(F.col("probability").between(0, 1), F.lit(False))
    return out.withColumn("valid", fine)


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def penalty() -> Column:
    return (weight(F.col("severity")) * F.col("probability")).cast(MONEY)


def score_tenders(risks: DataFrame, go: float = GO, review: float = REVIEW) -> DataFrame:
    """A row per tender: total_score, recommendation, reason, kill switch and its flags, counts."""
    critical = F.col("severity") == "critical"
    flags = F.transform(F.array_sort(F.collect_list(F.when(critical, F.struct("seq", "description")))), lambda x: x["description"])
    per = risks.groupBy("tender_id").agg(
        F.sum(penalty()).alias("penalty"), F.coalesce(F.bool_or(critical), F.lit(False)).alias("kill_switch"), flags.alias("critical_flags"),
        F.count(F.lit(1)).alias("total_risks"), F.sum((F.col("severity") == "high").cast("long")).alias("high_risks"))
    return decide(per, go, review)


def decide(per: DataFrame, go: float = GO, review: float = REVIEW) -> DataFrame:
    raw = F.greatest(F.lit(0).cast(MONEY), F.lit(100).cast(MONEY) - F.coalesce("penalty", F.lit(0).cast(MONEY)))
    score = F.when(F.col("kill_switch"), F.lit(0).cast(MONEY)).otherwise(raw)
    shown = F.format_string("%.1f", F.bround(score, 1).cast("double"))
    rec = F.when(F.col("kill_switch"), "NO_GO").when(score >= go, "GO").when(score >= review, "REVIEW").otherwise("NO_GO")
    reason = (
        F.when(F.col("kill_switch"), F.format_string("Kill Switch activado: %d riesgo(s) CRÍTICO(s) detectado(s). La propuesta no es viable.", F.size("critical_flags")))
        .when(F.col("total_risks") == 0, "No se detectaron riesgos.")
        .when((score >= go) & (F.col("high_risks") > 0), F.format_string("Score favorable (%s), pero revisar %d riesgo(s) alto(s).", shown, F.col("high_risks")))
        .when(score >= go, F.format_string("Propuesta viable con score de %s/100.", shown))
        .when(score >= review, F.format_string("Score moderado (%s). Se requiere revisión manual antes de decidir.", shown))
        .otherwise(F.format_string("Score insuficiente (%s). La acumulación de riesgos desaconseja presentarse.", shown)))
    return per.select(
        "tender_id", F.bround(score, 2).cast("double").alias("total_score"), rec.alias("recommendation"), reason.alias("reason"),
        "kill_switch", "critical_flags", "total_risks", "high_risks")


def with_empty(tenders: DataFrame, risks: DataFrame, allow_empty: bool = True) -> DataFrame:
    """Scores of all tenders; those without risks are perfect or, if not allowed, rejected (null score)."""
    scored = score_tenders(risks)
    out = tenders.select("tender_id").distinct().join(scored, "tender_id", "left")
    none = F.col("total_risks").isNull()
    return out.select(
        "tender_id", F.when(none, F.lit(100.0 if allow_empty else None)).otherwise(F.col("total_score")).alias("total_score"),
        F.when(none, F.lit("GO" if allow_empty else "REJECTED")).otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(none, "No se detectaron riesgos.").otherwise(F.col("reason")).alias("reason"), F.coalesce("total_risks", F.lit(0)).alias("total_risks"))


def category_breakdown(risks: DataFrame) -> DataFrame:
    """Four rows per tender, zeros included; under the kill switch a category is worth 0 or 100."""
    one = lambda c: F.col("category") == c
    aggs = [F.bool_or(F.col("severity") == "critical").alias("kill")]
    for c in CATEGORIES:
        aggs += [F.sum(F.when(one(c), penalty()).otherwise(0)).alias(f"p_{c}"), F.sum(one(c).cast("long")).alias(f"n_{c}")]
    rows = F.array(*[F.struct(F.lit(i).alias("category_order"), F.lit(c).alias("category"), F.col(f"p_{c}").cast(MONEY).alias("p"), F.col(f"n_{c}").alias("risk_count")) for i, c in enumerate(CATEGORIES)])
    out = risks.groupBy("tender_id").agg(*aggs).select("tender_id", "kill", F.inline(rows))
    hit = F.col("risk_count") > 0
    total = F.when(F.col("kill"), F.when(hit, 100.0).otherwise(0.0)).otherwise(F.col("p").cast("double"))
    score = F.when(F.col("kill"), F.when(hit, 0.0).otherwise(100.0)).otherwise(F.greatest(F.lit(0).cast(MONEY), F.lit(100).cast(MONEY) - F.col("p")).cast("double"))
    return out.select("tender_id", "category_order", "category", F.round(score, 6).alias("score"), "risk_count", F.round(total, 6).alias("total_penalty"))


def risk_matrix(risks: DataFrame) -> DataFrame:
    """Non-empty cells of impact x probability per tender, with the descriptions and a colour."""
    impact = F.when(F.col("severity").isin("high", "critical"), "high").otherwise(F.col("severity"))
    p = F.col("probability")
    prob = F.when((p >= 0) & (p < LOW_BELOW), "low").when((p >= LOW_BELOW) & (p < MEDIUM_BELOW), "medium").otherwise("high")
    colour = F.lit("green")
    for i, q, c in COLOURS:
        colour = F.when((F.col("impact") == i) & (F.col("probability_level") == q), c).otherwise(colour)
    cells = risks.select("tender_id", "seq", "description", impact.alias("impact"), prob.alias("probability_level"))
    cells = cells.groupBy("tender_id", "impact", "probability_level").agg(F.array_sort(F.collect_list(F.struct("seq", "description"))).alias("r"))
    return cells.select("tender_id", "impact", "probability_level", F.transform("r", lambda x: x["description"]).alias("risks"), colour.alias("colour"))


def gate(scored: DataFrame) -> DataFrame:
    """Recommendation to risk level, compliance, gate and issue lines."""
    rec, s = F.col("recommendation"), F.col("total_score")
    level = F.when(s < REVIEW, "critical").when(s < GO, "high").when(rec == "GO", "low").when(rec == "REVIEW", "medium").otherwise("critical")
    note = F.format_string("[RiskScore] Score: %s/100. Rec: %s", s.cast("string"), rec)
    issues = F.array(note)
    if "reason" in scored.columns:
        issues = F.when(F.col("kill_switch"), F.array(note, F.concat(F.lit("[RiskScore] KILL SWITCH ACTIVATED: "), "reason"))).otherwise(issues)
    return scored.select(
        "tender_id", level.alias("risk_level"), F.when(rec == "GO", "approved").when(rec == "REVIEW", "pending").otherwise("rejected").alias("compliance_status"),
        (rec != "NO_GO").alias("gate_passed"), issues.alias("issues"))


def clean_issues(audits: DataFrame) -> DataFrame:
    """Unknown levels become medium / approved; empty and template issues go."""
    known = lambda c, values, other: F.when(F.coalesce(F.col(c).isin(*values), F.lit(False)), F.col(c)).otherwise(other)
    return audits.withColumns({
        "risk_level": known("risk_level", ["low", "medium", "high", "critical"], "medium"),
        "compliance_status": known("compliance_status", ["approved", "pending", "rejected"], "approved"),
        "issues": F.filter("issues", lambda i: i.isNotNull() & (i != "") & ~i.startswith("Lista SOLO"))})


def audit_bypass(answers: DataFrame) -> DataFrame:
    """Answers that aren't audited (short, errors, no documents): low / approved; unparsed audits: medium / approved."""
    low = F.lower("answer")
    skip = (F.length("answer") < 50) | low.contains("error") | low.contains("no hay documentos")
    route = F.when(skip, "bypass").when(~F.col("parsed"), "unparsed").otherwise("audit")
    return answers.withColumn("route", route).withColumns({
        "risk_level": F.when(F.col("route") == "bypass", "low").when(F.col("route") == "unparsed", "medium"),
        "compliance_status": F.when(F.col("route") != "audit", "approved")})


def report(scored: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Markdown report, one-line summary and traffic light per tender."""
    light = F.lit("🔴")
    for rec, sign in LIGHTS.items():
        light = F.when(F.col("recommendation") == rec, sign).otherwise(light)
    shown = F.format_string("%.1f", F.bround(F.col("total_score").cast(MONEY), 1).cast("double"))
    one = lambda c: F.format_string("%.1f", F.bround(F.col(c).cast(MONEY), 1).cast("double"))
    line = F.format_string("| %s | %s | %d | -%s |", F.initcap("category"), one("score"), F.col("risk_count"), one("total_penalty"))
    rows = breakdown.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("category_order", line.alias("line")))).alias("rows"))
    killed = F.when(F.col("kill_switch"), F.concat(
        F.array(F.lit("### ⚠️ Kill Switch Activado"), F.lit("Los siguientes riesgos críticos descalifican la propuesta:"), F.lit("")),
        F.transform("critical_flags", lambda f: F.concat(F.lit("- 🔴 "), f)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(
        F.array(F.lit("## Resultado de Evaluación de Viabilidad"), F.lit(""), F.format_string("**Score Total**: %s/100 %s", shown, light),
                F.concat(F.lit("**Recomendación**: "), "recommendation"), F.concat(F.lit("**Razón**: "), "reason"), F.lit("")),
        killed,
        F.array(F.lit("### Desglose por Categoría"), F.lit(""), F.lit("| Categoría | Score | Riesgos | Penalización |"), F.lit("|-----------|-------|---------|--------------|")),
        F.transform("rows", lambda r: r["line"])), "\n")
    summary = F.format_string("%s Score: %s/100 | Rec: %s | Riesgos: %d (%s)", light, shown, F.col("recommendation"), F.col("total_risks"), F.when(F.col("kill_switch"), "⚠️ Kill Switch").otherwise("Normal"))
    return scored.join(rows, "tender_id").select("tender_id", text.alias("report"), summary.alias("summary"), light.alias("light"))
