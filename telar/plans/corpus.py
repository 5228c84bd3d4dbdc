"""Queries on pages, chunks, the index and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.functions import chunks as ch
from telar.functions import text as tx
from telar.operators import ingest
from telar.sources import files
from telar.streaming import jobs
from telar.plans.inputs import derive, oracle

ROWS = """
SELECT source AS source_file, text, doc_id,
  CASE doc_id % 3 WHEN 0 THEN 'FAST' WHEN 1 THEN 'OCR_ONLY' ELSE 'HI_RES' END AS strategy,
  CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN 'short' ELSE text END AS native, concat('ocr ', CAST(doc_id AS STRING)) AS ocr
FROM {documents}"""
# for the other engine; here pages are numbered by ingest.number_pages()
NUMBERED = "SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY {0}) AS INT) AS page_number FROM ({1})"
LINES = """
SELECT o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN concat('Página ', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('Company Name  page ', CAST(o_orderkey AS STRING), ' end')
  WHEN 2 THEN concat(CAST(o_orderkey AS STRING), ' de 40') WHEN 3 THEN concat('  ', CAST(o_orderkey AS STRING), ' ') WHEN 4 THEN concat('Fecha 12-05-2024 ', CAST(o_orderkey AS STRING)) WHEN 5 THEN 'Anexo 12/05/2024' ELSE NULL END AS line
FROM {orders}"""


def pages(spark, d):
    return ingest.number_pages(derive(spark, d, ROWS), "doc_id")


def src_manifest(spark, d):
    f = derive(spark, d, "SELECT concat(CASE WHEN page_id % 7 = 0 THEN '' ELSE '/in/' END, CAST(page_id AS STRING), CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END) AS path, CASE WHEN page_id % 5 = 0 THEN html ELSE concat('%PDF-', html) END AS body FROM {pages}")
    return ingest.check_files(f.withColumn("content", F.encode("body", "UTF-8"))).select("path", "is_valid", "reject_reason")


def src_pages(spark, d):
    return pages(spark, d).groupBy("source_file").agg(F.max("page_number").alias("pages"), F.sum(F.length("text")).alias("chars"))


def page_limit(spark, d):
    return ingest.limit_pages(pages(spark, d), 48).select("source_file", "page_number", "accepted")


def text_strategy(spark, d):
    p = pages(spark, d).select("doc_id", ingest.choose_text(F.col("strategy"), F.col("native"), F.col("ocr")).alias("t"))
    return p.select("doc_id", F.md5("t.text").alias("text_md5"), "t.ocr_used")


def sparse_page(spark, d):
    return pages(spark, d).filter(ingest.is_sparse(F.col("native"))).select("doc_id", F.array_join(F.array(F.lit("probable scan")), ",").alias("warning"))


SPECS = """SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN '5-10' WHEN 1 THEN '15' WHEN 2 THEN '1,3,5-7, 3' WHEN 3 THEN 'All' WHEN 4 THEN 'x' ELSE '9-2' END AS spec, CAST(6 + o_orderkey % 5 AS INT) AS most FROM {orders}"""


def page_range(spark, d):
    return derive(spark, d, SPECS).select("seq", F.array_join(tx.page_numbers(F.col("spec"), F.col("most")), ",").alias("pages"))


def normalize_line(spark, d):
    return derive(spark, d, LINES).select("seq", tx.normalize_line(F.col("line")).alias("line"))


NOISY = """
SELECT concat('f', CAST(page_id % 20 AS STRING)) AS source_file, page_id,
  concat('Empresa ', CAST(page_id % 20 AS STRING), ' página ', CAST(page_id AS STRING), chr(10), CASE WHEN page_id % 3 = 0 THEN 'Sólo a veces' ELSE 'cuerpo del texto' END, chr(10), url, chr(10), 'Empresa ', CAST(page_id % 20 AS STRING), chr(10), 'pie 2 de 9 común') AS text
FROM {pages}"""


def noisy(spark, d):
    return ingest.number_pages(derive(spark, d, NOISY), "page_id")


def detect_noise(spark, d):
    return ingest.detect_noise(derive(spark, d, NOISY), 0.6)


def remove_noise(spark, d):
    p = noisy(spark, d)
    return ingest.remove_noise(p, ingest.detect_noise(p, 0.6)).select("source_file", "page_number", "text")


def paragraphs():
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def semantic_chunk(spark, d):
    c = pages(spark, d).select("doc_id", F.posexplode(ch.semantic_chunks(paragraphs(), 500)).alias("chunk_index", "content"))
    return c.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def recursive_chunk(spark, d):
    c = pages(spark, d).select("doc_id", F.posexplode(ch.recursive_chunks(F.col("text"))).alias("chunk_index", "content"))
    return c.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def chunked(spark, d):
    p = pages(spark, d)
    t = p.filter("doc_id % 4 = 0").select("source_file", "page_number", F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.col("doc_id").cast("string"))).alias("rows"))
    return ingest.emit_chunks(p, ch.semantic_chunks(paragraphs(), 500), t)


def emit_chunks(spark, d):
    return chunked(spark, d).select("source_file", "page_number", "chunk_type", "chunk_index", F.md5("content").alias("content_md5"), "table_rows")


def chunk_id(spark, d):
    return chunked(spark, d).select("source_file", "page_number", "chunk_type", "chunk_id")


def table_to_markdown(spark, d):
    rows = F.array(F.array(F.lit("Orden"), F.lit("Cliente | pie")), F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("a\n "), "o_orderpriority"), F.lit("cut")), F.array(F.lit(None).cast("string")))
    return derive(spark, d, "SELECT o_orderkey, o_orderpriority FROM {orders}").select("o_orderkey", tx.table_to_markdown(rows).alias("markdown"))


def load_summary(spark, d):
    p = pages(spark, d).withColumn("t", ingest.choose_text(F.col("strategy"), F.col("native"), F.col("ocr"))).select("source_file", "page_number", F.col("t.text").alias("text"), "t.ocr_used")
    return ingest.load_summary(p, chunked(spark, d))


def source_counts(spark, d):
    return ingest.source_counts(derive(spark, d, "SELECT CASE WHEN source = 'src3' THEN NULL ELSE source END AS source_file FROM {documents}"))


def index_stats(spark, d):
    return ingest.index_stats(derive(spark, d, "SELECT embedding FROM {embeddings}"))


def index_append(spark, d):
    path, rows = files.shared_path(spark, "index"), derive(spark, d, "SELECT doc_id, source, n_chars FROM {documents}")
    files.append_to_index(rows.filter("doc_id % 2 = 0"), path)
    files.append_to_index(rows.filter("doc_id % 2 = 1"), path)
    return files.read_index(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"))


def index_replace_clear(spark, d):
    path, rows = files.shared_path(spark, "index"), derive(spark, d, "SELECT doc_id, source, n_chars FROM {documents}")
    files.append_to_index(rows, path)
    files.clear_index(spark, path)
    files.append_to_index(rows, path)
    files.replace_in_index(rows.filter("source IN ('src1', 'src2')").withColumn("n_chars", F.lit(1).cast("bigint")), path)
    return files.read_index(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"))


def stream(spark, d, table):
    path = f"{d}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")  # a pattern: one file or a folder of files


def stream_ingest(spark, d):
    out, mark = files.shared_path(spark, "chunks"), files.shared_path(spark, "mark")
    rows = stream(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").cast("int").alias("page_number"), "text")
    jobs.run_once(jobs.ingest(rows), out, mark)
    return spark.read.parquet(out).select("source_file", "page_number", "chunk_index", F.length("content").alias("n_chars"), "chunk_id")


def stream_ttl_dedup(spark, d):
    out, mark = files.shared_path(spark, "questions"), files.shared_path(spark, "mark")
    rows = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.lower(F.concat("event_type", F.col("user_id").cast("string"))), 256).alias("question_key"))
    jobs.run_once(jobs.drop_repeats(rows, 6 * 3600), out, mark)
    return spark.read.parquet(out).groupBy("question_key").agg(F.count(F.lit(1)).alias("asked"))


def stream_source_counts(spark, d):
    out, mark = files.shared_path(spark, "counts"), files.shared_path(spark, "mark")
    jobs.run_once(jobs.live_counts(stream(spark, d, "documents").select("source")), out, mark, "update")
    return jobs.latest(spark.read.parquet(out), ["source"])


QUERIES = {f.__name__: f for f in (
    src_manifest, src_pages, page_limit, text_strategy, sparse_page, page_range, normalize_line, detect_noise, remove_noise, semantic_chunk, recursive_chunk, emit_chunks, chunk_id,
    table_to_markdown, load_summary, source_counts, index_stats, index_append, index_replace_clear, stream_ingest, stream_ttl_dedup, stream_source_counts)}

P = NUMBERED.format("doc_id", oracle(ROWS))
TEXT = "CASE strategy WHEN 'OCR_ONLY' THEN ocr WHEN 'FAST' THEN native ELSE CASE WHEN trim(native) = '' THEN ocr ELSE native END END"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?i)\b(página|page|pág\.?)\s*\d+\b', '', 'g'), '\b\d+\s*(de|of|/)\s*\d+\b', '', 'g'), '^\s*\d+\s*$', '', 'g'), '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}', '', 'g'), '\s+', ' ', 'g'))"
NOISE = f"""n AS ({NUMBERED.format("page_id", oracle(NOISY))}), l AS (SELECT source_file, string_split(text, chr(10)) AS ls FROM n),
z AS (SELECT source_file, 'h' AS zone, unnest(ls[1:3]) AS line FROM l UNION ALL SELECT source_file, 'f', unnest(ls[greatest(len(ls) - 2, 1):]) FROM l),
c AS (SELECT source_file, zone, {NORM.format('line')} AS pattern, count(*) AS k FROM z GROUP BY 1, 2, 3),
noise AS (SELECT DISTINCT c.source_file, pattern FROM c JOIN (SELECT source_file, count(*) AS np FROM n GROUP BY 1) t ON t.source_file = c.source_file WHERE length(pattern) > 5 AND np >= 3 AND k >= np * 0.6)"""
# paragraphs (here: lines) packed up to 500 characters, longer ones by sentences, as two folds over lists of (chunks so far, chunk at hand)
FOLD = """list_reduce(list_prepend({{'out': CAST([] AS VARCHAR[]), 'held': ''}}, list_transform({0}, lambda {1}: {{'out': CAST([] AS VARCHAR[]), 'held': {1}}})), lambda {2}, {3}: {4})"""
SENTENCES = FOLD.format("string_split(regexp_replace(x.held, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))", "s", "b", "y", """CASE WHEN length(b.held) + length(y.held) + 1 <= 500 THEN {'out': b.out, 'held': trim(b.held || ' ' || y.held)}
  ELSE {'out': b.out || CASE WHEN b.held = '' THEN [] ELSE [b.held] END, 'held': y.held} END""")
PACKED = FOLD.format("list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '')", "t", "a", "x", f"""CASE WHEN length(a.held) + length(x.held) + 2 <= 500 THEN {{'out': a.out, 'held': trim(a.held || chr(10) || chr(10) || x.held, ' ' || chr(10))}}
  WHEN length(x.held) <= 500 THEN {{'out': a.out || CASE WHEN a.held = '' THEN [] ELSE [a.held] END, 'held': x.held}}
  ELSE list_transform([{SENTENCES}], lambda w: {{'out': a.out || CASE WHEN a.held = '' THEN [] ELSE [a.held] END || w.out, 'held': w.held}})[1] END""")


def split_sql(text: str, size: int = 1000, overlap: int = 200, level: int = 0) -> str:
    """The pieces of a text as chunks.split_recursively() cuts it: for each mark a fold over (pieces so far, run at hand), the finer marks' folds within."""
    mark, gap = [("chr(10) || chr(10)", 2), ("chr(10)", 1), ("' '", 1), ("''", 0)][level]
    t, a, x, j, f, w = (f"{c}{level}" for c in ("t", "a", "x", "j", "f", "w"))
    total = lambda run: f"(coalesce(list_sum(list_transform({run}, lambda {w}: length({w}))), 0) + greatest(len({run}) - 1, 0) * {gap})"
    closed = lambda run: f"list_filter([regexp_replace(array_to_string({run}, {mark}), '^\\s+|\\s+$', '', 'g')], lambda {w}: {w} <> '')"
    p, rest = f"{x}.run[1]", f"{a}.run[{j} + 1:]"
    first = f"list_filter(range(0, len({a}.run) + 1), lambda {j}: {j} = len({a}.run) OR {total(rest)} <= {overlap} AND {total(rest)} + {gap} + length({p}) <= {size})[1]"
    finer = "" if level == 3 else f"WHEN length({p}) > {size} THEN {{'out': {a}.out || {closed(f'{a}.run')} || {split_sql(p, size, overlap, level + 1)}, 'run': CAST([] AS VARCHAR[])}}"
    step = f"""CASE {finer} WHEN len({a}.run) > 0 AND {total(f'{a}.run')} + {gap} + length({p}) > {size}
      THEN {{'out': {a}.out || {closed(f'{a}.run')}, 'run': list_append({a}.run[{first} + 1:], {p})}} ELSE {{'out': {a}.out, 'run': list_append({a}.run, {p})}} END"""
    empty = "CAST([] AS VARCHAR[])"
    items = f"list_transform(list_filter(string_split({t}, {mark}), lambda {w}: {w} <> ''), lambda {w}: {{'out': {empty}, 'run': [{w}]}})"
    fold = f"list_transform([list_reduce(list_prepend({{'out': {empty}, 'run': {empty}}}, {items}), lambda {a}, {x}: {step})], lambda {f}: {f}.out || {closed(f'{f}.run')})[1]"
    body = fold if level == 3 else f"CASE WHEN contains({t}, {mark}) THEN {fold} ELSE {split_sql(t, size, overlap, level + 1)} END"
    return f"list_transform([{text}], lambda {t}: {body})[1]"


PIECES = f"""p AS ({P}), q AS (SELECT *, {PACKED} AS f FROM p WHERE trim(text) <> ''), r AS (SELECT * EXCLUDE (f), list_filter(list_append(f.out, f.held), lambda c: c <> '') AS cs FROM q),
pieces AS (SELECT * EXCLUDE (cs), CAST(generate_subscripts(cs, 1) - 1 AS INT) AS chunk_index, unnest(cs) AS content FROM r)"""
CHUNKS = f"""{PIECES}, chunks AS (SELECT source_file, page_number, 'text' AS chunk_type, chunk_index, trim(content) AS content, CAST(NULL AS INT) AS table_rows FROM pieces
  UNION ALL SELECT source_file, page_number, 'table', 0, '| a | b\\|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |', 2 FROM p WHERE doc_id % 4 = 0)"""
ORACLES = {
    "src_manifest": """SELECT path, reason IS NULL AS is_valid, reason AS reject_reason FROM (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'relative path' WHEN page_id % 3 = 2 THEN 'not a .pdf name' WHEN page_id % 5 = 0 THEN 'no PDF header' END AS reason,
      (CASE WHEN page_id % 7 = 0 THEN '' ELSE '/in/' END) || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS path FROM pages)""",
    "src_pages": "SELECT source AS source_file, CAST(count(*) AS INT) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "page_limit": f"WITH p AS ({P}) SELECT source_file, page_number, count(*) OVER (PARTITION BY source_file) <= 48 AS accepted FROM p",
    "text_strategy": f"WITH p AS ({P}) SELECT doc_id, md5({TEXT}) AS text_md5, strategy = 'OCR_ONLY' OR strategy = 'HI_RES' AND trim(native) = '' AS ocr_used FROM p",
    "sparse_page": f"WITH p AS ({P}) SELECT doc_id, 'probable scan' AS warning FROM p WHERE length(trim(native)) < 10",
    "page_range": f"""WITH s AS ({oracle(SPECS)}) SELECT seq, CASE seq % 6 WHEN 0 THEN array_to_string(range(5, least(10, most) + 1), ',') WHEN 1 THEN CASE WHEN most >= 15 THEN '15' END WHEN 2 THEN array_to_string(list_filter([1, 3, 5, 6, 7], lambda x: x <= most), ',')
      WHEN 3 THEN array_to_string(range(1, most + 1), ',') END AS pages FROM s""",
    "normalize_line": f"WITH l AS ({oracle(LINES)}) SELECT seq, {NORM.format('line')} AS line FROM l",
    "detect_noise": f"WITH {NOISE} SELECT source_file, pattern FROM noise",
    "remove_noise": f"""WITH {NOISE}, x AS (SELECT source_file, page_number, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT source_file, page_number, string_split(text, chr(10)) AS ls FROM n)),
      y AS (SELECT x.*, {NORM.format('line')} AS nl FROM x)
      SELECT n.source_file, n.page_number, coalesce(string_agg(y.line, chr(10) ORDER BY i) FILTER (WHERE noise.pattern IS NULL), '') AS text FROM n LEFT JOIN y USING (source_file, page_number) LEFT JOIN noise ON noise.source_file = y.source_file AND noise.pattern = y.nl GROUP BY 1, 2""",
    "semantic_chunk": f"WITH {PIECES} SELECT doc_id, chunk_index, CAST(length(content) AS INT) AS n_chars, md5(content) AS content_md5 FROM pieces",
    "recursive_chunk": f"""WITH p AS ({P}), c AS (SELECT doc_id, {split_sql('text')} AS cs FROM p WHERE text <> '')
      SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, CAST(length(content) AS INT) AS n_chars, md5(content) AS content_md5 FROM (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS content FROM c)""",
    "emit_chunks": f"WITH {CHUNKS} SELECT source_file, page_number, chunk_type, chunk_index, md5(content) AS content_md5, table_rows FROM chunks",
    "chunk_id": f"WITH {CHUNKS} SELECT source_file, page_number, chunk_type, left(md5(source_file || ':' || page_number || ':' || content[1:100]), 12) AS chunk_id FROM chunks",
    "table_to_markdown": r"SELECT o_orderkey, '| Orden | Cliente \| pie |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | a ' || o_orderpriority || ' |' || chr(10) || '|  |  |' AS markdown FROM orders",
    "load_summary": f"""WITH {CHUNKS}, s AS (SELECT source_file, count(DISTINCT page_number) AS total_pages, bool_or(strategy = 'OCR_ONLY' OR strategy = 'HI_RES' AND trim(native) = '') AS ocr_used, CAST(count(*) FILTER (WHERE length(trim({TEXT})) < 10) AS INT) AS warnings FROM p GROUP BY 1),
      c AS (SELECT source_file, count(*) AS chunks, count(*) FILTER (WHERE chunk_type = 'table') AS tables_extracted FROM chunks GROUP BY 1) SELECT source_file, total_pages, chunks, tables_extracted, ocr_used, warnings FROM s JOIN c USING (source_file)""",
    "source_counts": "SELECT CASE WHEN source = 'src3' THEN 'unknown' ELSE source END AS source, count(*) AS chunks FROM documents GROUP BY 1",
    "index_stats": "SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INT) AS dimension FROM embeddings",
    "index_append": "SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "index_replace_clear": "SELECT source, count(*) AS chunks, CAST(sum(CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "stream_ingest": """WITH x AS (SELECT source AS source_file, CAST(doc_id AS INT) AS page_number, text, unnest(range(0, length(text), 1000)) AS a FROM documents)
      SELECT source_file, page_number, CAST(a / 1000 AS INT) AS chunk_index, CAST(length(text[a + 1:a + 1000]) AS INT) AS n_chars, left(md5(source_file || ':' || page_number || ':' || text[a + 1:least(a + 100, a + 1000)]), 12) AS chunk_id FROM x""",
    "stream_ttl_dedup": """WITH RECURSIVE o AS (SELECT ts, sha256(lower(event_type || user_id)) AS k, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS i FROM events),
      f AS (SELECT k, i, ts AS kept, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN o.ts - f.kept > INTERVAL 6 HOUR THEN o.ts ELSE f.kept END, CASE WHEN o.ts - f.kept > INTERVAL 6 HOUR THEN 1 ELSE 0 END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
      SELECT k AS question_key, CAST(sum(n) AS BIGINT) AS asked FROM f GROUP BY 1""",
    "stream_source_counts": "SELECT source, count(*) AS chunks FROM documents GROUP BY 1",
}
