"""Batches of questions against a corpus: exact top-k, re-ranking, grading, routing, envelopes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.operators.compliance import any_of
from telar.operators.nearest import CLUSTER_ROWS, clustered, search

# Domains, words of data-heavy questions, defaults.
DOMAINS = ["legal", "technical", "financial", "timeline", "requirements", "general", "quantitative"]
DATA_WORDS = [
    "fecha", "cronograma", "plazo", "calendario", "hito", "presupuesto", "monto", "garantia", "pago", "financier", "tabla", "porcentaje", "%", "usd", "ars",
    "cantidad", "cuanto", "cuando", "timeline", "schedule",
]
ROUTES = [  # first match wins
    ("technical", ["sla", "disponibilidad", "uptime", "latencia", "arquitectura", "infraestructura", "data center", "api", "integracion", "iso "]),
    ("legal", ["penalidad", "normativa", "ley", "jurisdicción", "propiedad intelectual", "protección de datos", "sancion"]),
    ("requirements", ["requisito", "cumplimos", "gaps", "elegibilidad", "experiencia", "personal clave"]),
    ("financial", ["presupuesto", "monto", "pago", "garantía", "garantia", "factura", "patrimonio"]),
    ("timeline", ["fecha", "cronograma", "plazo", "fase", "duración", "calendario"]),
    ("quantitative", ["gráfico", "grafico", "comparar", "tendencia", "estadística", "visualiza"]),
]
SEPARATOR = "\n\n---\n\n"


def valid_query(question: Column, top_k: Column, threshold: Column, lam: Column) -> Column:
    fine = (F.length(F.trim(question)) >= 3) & top_k.between(1, 20) & threshold.between(0, 1) & lam.between(0, 1)
    return F.coalesce(fine, F.lit(False))


def metadata_filter(conditions: dict) -> Column:
    """All of: equality, or {"$gt" | "$gte" | "$lt" | "$lte" | "$contains": value}; an unknown operator is an error."""
    ops = {
        "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$contains": lambda c, v: c.contains(v),
    }
    out = F.lit(True)
    for name, want in conditions.items():
        for op, value in want.items() if isinstance(want, dict) else [("=", want)]:
            if op != "=" and op not in ops:
                raise ValueError(f"unknown operator {op}")
            out = out & (F.col(name) == value if op == "=" else ops[op](F.col(name), value))
    return out


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """The k most similar chunks (id, embedding) of each query (query_id, embedding) by cosine, to 12 decimals; ties go to the lesser id.

    Chunks are clustered and written once; a query meets only clusters that may hold one of its k best (see nearest). Rows
    without a vector are left out.
    """
    return search(clustered(chunks, cluster_rows), queries, k)


def mmr(chunks: DataFrame, queries: DataFrame, k: int = 4, lam: float = 0.5, fetch: int = 3) -> DataFrame:
    """Maximal marginal relevance among fetch x k candidates a query; scores are true cosines."""
    found = top_k(chunks, queries, fetch * k)
    # vectors are fetched for the candidates alone: none is moved in the search for them
    found = found.join(chunks.select(F.col("id").cast("long").alias("id"), "embedding"), "id")

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank").reset_index(drop=True)
        x = np.stack(df["embedding"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near, score, picked = (x[:, None] * x).sum(2), df["score"].to_numpy(), []  # pair by pair, so that copies tie
        while len(picked) < min(k, len(df)):
            value = np.round(lam * score - (1 - lam) * (near[:, picked].max(axis=1) if picked else 0), 12)  # ties go to the better rank
            value[picked] = -np.inf
            picked.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": df["query_id"].iloc[0], "id": df["id"].to_numpy()[picked], "score": score[picked], "rank": range(1, len(picked) + 1)})

    return found.groupBy("query_id").applyInPandas(choose, "query_id long, id long, score double, rank int")


def normalize_score(score: Column) -> Column:
    return F.when(score < 0, 0.0).when(score > 1, F.greatest(F.lit(0.0), 1 - score)).otherwise(score)


def threshold(queries: DataFrame, hits: DataFrame, least: float, top: int) -> DataFrame:
    """Per query: how many hits, how many kept, a warning or null; queries without hits stay."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_found"), F.sum((F.col("score") >= least).cast("long")).alias("kept"))
    out = queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("total_found", F.lit(0)).alias("total_found"), F.coalesce("kept", F.lit(0)).alias("kept"))
    none = F.format_string(f"Se encontraron %d resultados pero ninguno superó el umbral de confianza ({least}). Considere reducir el threshold o reformular la consulta.", F.col("total_found"))
    some = F.format_string(f"Solo %d de %d resultados superaron el umbral de confianza ({least}).", F.col("kept"), F.col("total_found"))
    return out.withColumn("warning", F.when((F.col("total_found") > 0) & (F.col("kept") == 0), none).when((F.col("kept") < top) & (F.col("total_found") > 0), some))


def order_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def citation() -> Column:
    return F.format_string("[%s, pág. %d]", F.col("source_file"), F.col("page_number"))


def cited_context(hits: DataFrame) -> DataFrame:
    """Per query: citations and the numbered context text, in rank order."""
    block = F.format_string("[Fuente %d: %s, pág. %d]\n%s", F.col("rank"), F.col("source_file"), F.col("page_number"), F.col("content"))
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", citation().alias("c"), block.alias("b")))).alias("r"))
    return per.select("query_id", F.array_join(F.transform("r", lambda x: x["c"]), "; ").alias("citations"), F.array_join(F.transform("r", lambda x: x["b"]), SEPARATOR).alias("context"))


def assemble_context(hits: DataFrame, each: int = 1500, whole: int = 6000, most: int = 5, suffix: str = "") -> DataFrame:
    """Per query: the first `most` texts, each and all cut to a length."""
    per = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, each).alias("t")))), 1, most).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), SEPARATOR)
    return per.select("query_id", F.when(F.length(text) > whole, F.concat(F.substring(text, 1, whole), F.lit(suffix))).otherwise(text).alias("context"))


def parse_grades(replies: DataFrame) -> DataFrame:
    """query_id, line, idx, relevant of reply lines idx:grade whose idx is a number within 1..n."""
    lines = replies.select("query_id", "n", F.posexplode(F.split(F.lower(F.trim("reply")), "\n")).alias("line", "text")).filter(F.col("text").contains(":"))
    idx, grade = F.trim(F.substring_index("text", ":", 1)).try_cast("int"), F.expr("substring(text, instr(text, ':') + 1)")
    out = lines.select("query_id", "n", "line", idx.alias("idx"), (grade.contains("relevant") & ~grade.contains("not_relevant")).alias("relevant"))
    return out.filter((F.col("idx") >= 1) & (F.col("idx") <= F.col("n"))).drop("n")


def is_data_heavy(question: Column) -> Column:
    return any_of(F.lower(question), DATA_WORDS)


def safety_net(retrieved: DataFrame, grades: DataFrame, questions: DataFrame, least: int = 3, first: int = 5) -> DataFrame:
    """Chosen documents (query_id, place, idx): the relevant ones in grade order, or the first five where too few are."""
    good = grades.filter("relevant").join(retrieved, ["query_id", "idx"])
    n = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = questions.select("query_id", is_data_heavy(F.col("question")).alias("heavy")).join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q = q.withColumn("fallback", (F.col("n") == 0) | (F.col("heavy") & (F.col("n") < least)))
    a = retrieved.join(q.filter("fallback").select("query_id"), "query_id").filter(F.col("idx") <= first).select("query_id", F.col("idx").alias("order"), "idx")
    b = good.join(q.filter("NOT fallback").select("query_id"), "query_id").select("query_id", F.col("line").alias("order"), "idx")
    w = Window.partitionBy("query_id").orderBy("order", "idx")
    return a.unionByName(b).select("query_id", F.row_number().over(w).alias("place"), "idx")


def normalize_domain(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(F.coalesce(low.isin(*DOMAINS), F.lit(False)), low).otherwise("general")


def route(question: Column) -> Column:
    """Domain by ordered word groups: penalties of service levels are technical, those of delay legal."""
    low = F.lower(question)
    out = F.lit("general")
    for domain, words in reversed(ROUTES):
        out = F.when(any_of(low, words), domain).otherwise(out)
    return out


def next_step(no_documents: Column, domain: Column, audit: Column, revisions: Column, most: int = 2) -> Column:
    return (
        F.when(no_documents, "end").when(audit.isNull() & (domain == "quantitative"), "quant").when(audit.isNull(), "specialist")
        .when((audit == "fail") & (revisions < most), "refine").otherwise("end"))


def envelope(states: DataFrame) -> DataFrame:
    """Response rows: sorted distinct sources of the filtered (else retrieved) documents, counts, specialist."""
    docs = F.when(F.size("filtered") > 0, F.col("filtered")).otherwise(F.col("retrieved"))
    sources = F.array_sort(F.array_distinct(F.filter(docs, lambda s: s.isNotNull() & (s != ""))))
    return states.select(
        "query_id", sources.alias("sources"), F.size("retrieved").alias("documents_retrieved"), F.size(docs).alias("documents_filtered"),
        F.when(F.col("domain") == "quantitative", "quant").otherwise(F.concat(F.lit("specialist_"), "domain")).alias("specialist_used"),
        F.when(F.col("risk_level").isNotNull(), F.struct("risk_level", F.coalesce("compliance_status", F.lit("pending")).alias("compliance_status"))).alias("risk_assessment"))


def pages_per_source(hits: DataFrame, most: int = 5) -> DataFrame:
    per = hits.groupBy("query_id", "source_file").agg(F.array_sort(F.collect_set("page_number")).alias("p"))
    return per.select("query_id", "source_file", F.array_join(F.transform(F.slice("p", 1, most), lambda x: x.cast("string")), ",").alias("pages"))


def question_key(question: Column) -> Column:
    return F.sha2(F.lower(F.trim(question)), 256)


def ttl_replay(log: DataFrame, seconds: int = 300) -> DataFrame:
    """hit or miss of each question (question_key, ts, seq): a hit lies within the time to live of the last miss, the limit included.

    After a pause longer than the time to live the next question is a miss whatever came before, so a key's rows are cut
    there and the parts replayed in different tasks. Rows of a part arrive sorted; only the last miss is kept.
    """
    rows = log.select("question_key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("question_key").orderBy("us", "seq")
    pause = F.col("us") - F.lag("us").over(w) > seconds * 1_000_000
    rows = rows.withColumn("part", F.sum(F.coalesce(pause, F.lit(False)).cast("long")).over(w))
    rows = rows.repartition("question_key", "part").sortWithinPartitions("question_key", "part", "us", "seq")

    def run(batches):
        import pyarrow as pa

        last = (None, 0)
        for b in batches:
            hit = []
            for key, us, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                fresh = (key, part) == last[0] and us - last[1] <= seconds * 1_000_000
                hit.append(fresh)
                if not fresh:
                    last = ((key, part), us)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.bool_())], names=["question_key", "seq", "hit"])

    return rows.mapInArrow(run, "question_key string, seq long, hit boolean")
