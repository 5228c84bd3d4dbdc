"""The pipeline's stages, applied one after another, against plain Python over the same rows."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import contaminated, groups, spans_of

import corpus_pipeline


@pytest.mark.parametrize("name", ["op2_license_scan", "op9_chat_format"])
def test_registered(spark, sf_dir, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, sf_dir).count() > 0


def test_chat_sql(spark, sf_dir):
    from compare import duck_rows, spark_rows

    import __spark_entry__ as e

    assert spark_rows(e.queries()["op9_chat_format"](spark, sf_dir)) == duck_rows(e.oracle_sql()["op9_chat_format"], sf_dir)


def test_run(spark, sf_dir):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    kept = {i for i, _ in docs} - {i for i, _, _, k in groups(docs, 5) if not k}
    docs = [(i, t) for i, t in docs if i in kept]
    clean = {i for i, _, hit, _ in contaminated(docs, items) if not hit}
    docs = [(i, t) for i, t in docs if i in clean]
    tok, want = Tokenizer.from_file(path("byte_bpe_50k.json")), {}
    for i, t in docs:
        out, at = "", 0
        for a, _, z in spans_of(t):
            if z > at:
                out += (t[at:a] + "[SECRET]") if a >= at else ""
                at = z
        text = out + t[at:]
        want[i] = (tok.encode(text, add_special_tokens=False).ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_empty_and_null_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    hard = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "token=abcdefghijk " + "word " * 9000, None, None, None), (4, "123", "en", "s", 3), (3, "token=abcdefghijk " + "word " * 9000, None, None, None)]
    for rows in ([], hard):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            last, docs = docs, stage(spark, docs, sf_dir)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert docs.columns == last.columns
        assert {r["doc_id"] for r in docs.collect()} == ({3} if rows else set())


def test_clashing_columns(spark, sf_dir):
    """Columns that bear the names of the operators' own stay, with their values, and a null language is filled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 40")
    names = ["lang_pred", "score", "claimed", "und_reason", "n_words", "hits", "cuts", "items", "key", "found", "component_id", "kept", "ids", "id", "maybe"]
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == want, name
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names) and all(r["lang"] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
