"""Queries on retrieval, grading and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import retrieval as r
from telar.plans.inputs import derive, oracle


def vectors(spark, d):
    return derive(spark, d, "SELECT vec_id AS id, embedding, label FROM {embeddings}")


def asked(spark, d):
    """The stated set of queries: every row whose id is divisible by 20."""
    return vectors(spark, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def best(spark, d, k=10):
    return r.top_k(vectors(spark, d), asked(spark, d), k)


def hits(spark, d, k=10):
    h = best(spark, d, k)
    return h.select("query_id", "id", "score", "rank", F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("source_file"), (F.col("id") % 9 + 1).cast("int").alias("page_number"), F.concat(F.lit("texto "), F.col("id").cast("string")).alias("content"))


QUESTIONS = """
SELECT c.conv_id AS query_id, CAST(count(*) AS INT) AS n, concat(min(CASE WHEN turn = 0 THEN text ELSE NULL END), CASE WHEN c.conv_id % 2 = 0 THEN ' presupuesto' ELSE '' END) AS question FROM {conversations} c GROUP BY c.conv_id"""
GRADES = "SELECT conv_id AS query_id, turn, concat(CAST(turn + 1 AS STRING), CASE (conv_id + turn) % 4 WHEN 0 THEN ':relevant' WHEN 1 THEN ': NOT_RELEVANT' WHEN 2 THEN ':not_relevant' ELSE 'x:relevant' END) AS line FROM {conversations}"


def questions(spark, d):
    return derive(spark, d, QUESTIONS)


def grades(spark, d):
    replies = derive(spark, d, GRADES).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("reply"), F.count(F.lit(1)).alias("n"))
    return r.parse_grades(replies.withColumn("reply", F.concat("reply", F.lit("\n99:relevant\nnada"))))


def validate_query(spark, d):
    q = derive(spark, d, "SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN '  a ' ELSE '¿Cuál es el plazo?' END AS question, CAST(o_orderkey % 25 AS INT) AS top_k, CAST(o_orderkey % 12 AS DOUBLE) / 10 AS threshold, 0.5 AS lam FROM {orders}")
    return q.select("seq", r.valid_query(F.col("question"), F.col("top_k"), F.col("threshold"), F.col("lam")).alias("valid"))


def similarity_topk(spark, d):
    return best(spark, d).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def metadata_filter(spark, d):
    keep = r.metadata_filter({"label": {"$gte": 2, "$lt": 7}, "id": {"$gt": 20}})
    return r.top_k(vectors(spark, d).filter(keep), asked(spark, d), 3).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def mmr_topk(spark, d):
    return r.mmr(vectors(spark, d), asked(spark, d)).withColumn("score", F.round("score", 4))


def score_normalize(spark, d):
    e = derive(spark, d, "SELECT event_id, value / 50 - 0.5 AS score FROM {events}")
    return e.select("event_id", F.round(r.normalize_score(F.col("score")), 6).alias("score"))


def score_threshold(spark, d):
    return r.threshold(asked(spark, d), best(spark, d), 0.45, 10)


def order_hits(spark, d):
    return r.order_hits(best(spark, d, 5).drop("rank")).select("query_id", "rank", "id")


def citations(spark, d):
    return r.cited_context(hits(spark, d, 3))


def context_assembly(spark, d):
    return r.assemble_context(hits(spark, d, 5), 7, 60, 5, "...")


def parse_grades(spark, d):
    return grades(spark, d)


def data_heavy(spark, d):
    return questions(spark, d).select("query_id", r.is_data_heavy(F.col("question")).alias("heavy"))


def safety_net(spark, d):
    got = derive(spark, d, "SELECT conv_id AS query_id, CAST(turn + 1 AS INT) AS idx FROM {conversations}")
    return r.safety_net(got, grades(spark, d), questions(spark, d))


LABELS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Legal ' WHEN 1 THEN 'TECHNICAL' WHEN 2 THEN 'otro' ELSE NULL END AS label, CASE event_id % 6 WHEN 0 THEN 'Penalidades por SLA incumplido' WHEN 1 THEN 'Penalidades por atraso' WHEN 2 THEN 'Monto de la garantía bancaria' WHEN 3 THEN 'Fechas del cronograma' WHEN 4 THEN '¿Cumplimos los requisitos?' ELSE 'Hola' END AS question FROM {events}"


def normalize_domain(spark, d):
    return derive(spark, d, LABELS).select("event_id", r.normalize_domain(F.col("label")).alias("domain"))


def keyword_route(spark, d):
    return derive(spark, d, LABELS).select("event_id", r.route(F.col("question")).alias("domain"))


STATES = """SELECT event_id AS query_id, event_id % 10 = 0 AS no_documents, CASE WHEN event_id % 3 = 0 THEN 'quantitative' ELSE 'legal' END AS domain, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fail' ELSE 'pass' END AS audit,
  CAST(event_id % 4 AS INT) AS revisions, CASE WHEN event_id % 2 = 0 THEN 'high' END AS risk_level, CAST(NULL AS STRING) AS compliance_status, concat('s', CAST(event_id % 3 AS STRING), ',,s', CAST(event_id % 5 AS STRING)) AS got,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('s', CAST(event_id % 7 AS STRING)) END AS kept FROM {events}"""


def branch_state(spark, d):
    return derive(spark, d, STATES).select("query_id", r.next_step(F.col("no_documents"), F.col("domain"), F.col("audit"), F.col("revisions")).alias("next_step"))


def response_envelope(spark, d):
    s = derive(spark, d, STATES).withColumns({"retrieved": F.split("got", ","), "filtered": F.when(F.col("kept") == "", F.array().cast("array<string>")).otherwise(F.split("kept", ","))})
    return r.envelope(s).select("query_id", F.array_join("sources", ",").alias("sources"), "documents_retrieved", "documents_filtered", "specialist_used", F.col("risk_assessment.compliance_status").alias("compliance_status"))


def pages_per_source(spark, d):
    return r.pages_per_source(hits(spark, d), 2)


def question_key(spark, d):
    q = derive(spark, d, "SELECT concat('  Evento ', event_type, ' ') AS question FROM {events}")
    return q.select(r.question_key(F.col("question")).alias("question_key")).dropDuplicates()


def ttl_replay(spark, d):
    log = derive(spark, d, "SELECT event_id AS seq, ts, concat(event_type, CAST(user_id AS STRING)) AS question_key FROM {events}")
    return r.ttl_replay(log, 86400)


QUERIES = {f.__name__: f for f in (
    validate_query, similarity_topk, metadata_filter, mmr_topk, score_normalize, score_threshold, order_hits, citations, context_assembly, parse_grades, data_heavy, safety_net,
    normalize_domain, keyword_route, branch_state, response_envelope, pages_per_source, question_key, ttl_replay)}


def ranked(k, where="true"):
    return f"""h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where}),
t AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INT) AS rank FROM h) WHERE rank <= {k})"""


def chosen(n):
    """The n-th choice of each query: the best mean of score and distance to what was chosen before; ties go to the better rank."""
    before = " UNION ALL ".join(f"SELECT query_id, id, v FROM m{i}" for i in range(1, n))
    near = f"LEFT JOIN (SELECT c.query_id, c.id, max(list_cosine_similarity(c.v, b.v)) AS near, bool_or(c.id = b.id) AS taken FROM c JOIN ({before}) b USING (query_id) GROUP BY 1, 2) x USING (query_id, id)" if n > 1 else ""
    value = "round(0.5 * score - 0.5 * near, 12)" if n > 1 else "score"
    return f"""m{n} AS (SELECT query_id, id, score, v, {n} AS place FROM (SELECT c.query_id, c.id, score, c.v, row_number() OVER (PARTITION BY c.query_id ORDER BY {value} DESC, rank) AS o
      FROM c {near} {'WHERE NOT taken' if n > 1 else ''}) WHERE o = 1)"""


HEAVY = "regexp_matches(lower(question), 'fecha|cronograma|plazo|calendario|hito|presupuesto|monto|garantia|pago|financier|tabla|porcentaje|%|usd|ars|cantidad|cuanto|cuando|timeline|schedule')"
G = f"""g AS (SELECT conv_id AS query_id, CAST(turn AS INT) AS line, CAST(turn + 1 AS INT) AS idx, (conv_id + turn) % 4 = 0 AS relevant FROM conversations WHERE (conv_id + turn) % 4 < 3)"""
ORACLES = {
    "validate_query": "SELECT o_orderkey AS seq, o_orderkey % 5 <> 0 AND o_orderkey % 25 BETWEEN 1 AND 20 AND o_orderkey % 12 <= 10 AS valid FROM orders",
    "similarity_topk": f"WITH {ranked(10)} SELECT query_id, rank, id, round(score, 4) AS score FROM t",
    "metadata_filter": f"WITH {ranked(3, 'e.label >= 2 AND e.label < 7 AND e.vec_id > 20')} SELECT query_id, rank, id, round(score, 4) AS score FROM t",
    "mmr_topk": f"""WITH {ranked(12)}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT query_id, t.id, round(score, 12) AS score, rank, v FROM t JOIN v USING (id)),
      {chosen(1)}, {chosen(2)}, {chosen(3)}, {chosen(4)} SELECT query_id, id, round(score, 4) AS score, CAST(place AS INT) AS rank FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4)""",
    "score_normalize": "SELECT event_id, round(CASE WHEN s < 0 THEN 0.0 WHEN s > 1 THEN greatest(0.0, 1 - s) ELSE s END, 6) AS score FROM (SELECT event_id, value / 50 - 0.5 AS s FROM events)",
    "score_threshold": f"""WITH {ranked(10)}, p AS (SELECT query_id, count(*) AS f, count(*) FILTER (WHERE score >= 0.45) AS k FROM t GROUP BY 1) SELECT query_id, f AS total_found, k AS kept,
      CASE WHEN k = 0 THEN 'Se encontraron ' || f || ' resultados pero ninguno superó el umbral de confianza (0.45). Considere reducir el threshold o reformular la consulta.' WHEN k < 10 THEN 'Solo ' || k || ' de ' || f || ' resultados superaron el umbral de confianza (0.45).' END AS warning FROM p""",
    "order_hits": f"WITH {ranked(5)} SELECT query_id, rank, id FROM t",
    "citations": f"""WITH {ranked(3)} SELECT query_id, string_agg('[f' || id % 5 || ', pág. ' || (id % 9 + 1) || ']', '; ' ORDER BY rank) AS citations,
      string_agg('[Fuente ' || rank || ': f' || id % 5 || ', pág. ' || (id % 9 + 1) || ']' || chr(10) || 'texto ' || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY 1""",
    "context_assembly": f"""WITH {ranked(5)}, c AS (SELECT query_id, string_agg(left('texto ' || id, 7), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM t GROUP BY 1) SELECT query_id, CASE WHEN length(c) > 60 THEN left(c, 60) || '...' ELSE c END AS context FROM c""",
    "parse_grades": f"WITH {G} SELECT query_id, line, idx, relevant FROM g",
    "data_heavy": f"WITH q AS ({oracle(QUESTIONS)}) SELECT query_id, {HEAVY} AS heavy FROM q",
    "safety_net": f"""WITH {G}, q AS ({oracle(QUESTIONS)}), n AS (SELECT q.query_id, {HEAVY} AS heavy, count(g.idx) FILTER (WHERE relevant) AS n FROM q LEFT JOIN g USING (query_id) GROUP BY 1, 2),
      c AS (SELECT query_id, CAST(turn + 1 AS INT) AS o, CAST(turn + 1 AS INT) AS idx FROM n JOIN conversations ON conv_id = query_id WHERE (n = 0 OR heavy AND n < 3) AND turn < 5 UNION ALL SELECT g.query_id, line, idx FROM g JOIN n USING (query_id) WHERE relevant AND NOT (n = 0 OR heavy AND n < 3))
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, idx) AS INT) AS place, idx FROM c""",
    "normalize_domain": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'technical' ELSE 'general' END AS domain FROM events",
    "keyword_route": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'technical' WHEN 1 THEN 'legal' WHEN 2 THEN 'financial' WHEN 3 THEN 'timeline' WHEN 4 THEN 'requirements' ELSE 'general' END AS domain FROM events",
    "branch_state": "SELECT event_id AS query_id, CASE WHEN event_id % 10 = 0 THEN 'end' WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'quant' ELSE 'specialist' END WHEN event_id % 4 = 1 THEN 'refine' ELSE 'end' END AS next_step FROM events",
    "response_envelope": """SELECT event_id AS query_id, CASE WHEN event_id % 5 = 0 THEN array_to_string(list_sort(list_distinct(['s' || event_id % 3, 's' || event_id % 5])), ',') ELSE 's' || event_id % 7 END AS sources, CAST(3 AS INT) AS documents_retrieved,
      CAST(CASE WHEN event_id % 5 = 0 THEN 3 ELSE 1 END AS INT) AS documents_filtered, CASE WHEN event_id % 3 = 0 THEN 'quant' ELSE 'specialist_legal' END AS specialist_used, CASE WHEN event_id % 2 = 0 THEN 'pending' END AS compliance_status FROM events""",
    "pages_per_source": f"WITH {ranked(10)} SELECT query_id, 'f' || id % 5 AS source_file, array_to_string(list_sort(list_distinct(list(id % 9 + 1)))[1:2], ',') AS pages FROM t GROUP BY 1, 2",
    "question_key": "SELECT DISTINCT sha256('evento ' || event_type) AS question_key FROM events",
    "ttl_replay": """WITH RECURSIVE o AS (SELECT event_id AS seq, ts, event_type || user_id AS k, row_number() OVER (PARTITION BY event_type || user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT seq, ts, k, i, ts AS miss, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.seq, o.ts, o.k, o.i, CASE WHEN o.ts - f.miss <= INTERVAL 86400 SECOND THEN f.miss ELSE o.ts END, o.ts - f.miss <= INTERVAL 86400 SECOND FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
      SELECT k AS question_key, seq, hit FROM f""",
}
