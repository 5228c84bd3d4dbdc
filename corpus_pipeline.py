"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import Scratch, hidden, read, shown
from telar.llm.op3_secret_scan import redact_secrets
from telar.llm.op4_near_dedup import keep_one
from telar.llm.op6_bpe_codec import encode_decode
from telar.llm.op7_decontaminate import decontaminate
from telar.llm.op8_language_id import identify


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (null and empty texts too); those without a language get the predicted one.

    Where nothing is labelled there is no prediction, and all that have a letter stay. Repeated rows are judged alike;
    columns stay as they are, whatever their names.
    """
    df, names = hidden(docs)
    out = identify(df, names["doc_id"], names["text"], names["lang"], scratch=Scratch(spark)).filter("und_reason IS NULL OR und_reason <> 'no letter'")
    return shown(out, names, lang=F.coalesce(F.col(names["lang"]), F.when(F.col("lang_pred") != "und", F.col("lang_pred"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that with the least id.

    Rows of an id with several texts are judged each by its text; rows without an id, and documents without words, stay.
    """
    return keep_one(docs, Scratch(spark), size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows are judged alike."""
    df, names = hidden(docs)
    out = decontaminate(df, read(spark, sf_dir, "benchmark"), names["text"], scratch=Scratch(spark))
    return shown(out.filter(F.size("hits") == 0), names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows. All rows stay, null and empty texts as they are."""
    out = redact_secrets(docs, Scratch(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to as a digest; null and empty texts have no ids. Every row gives a row."""
    out = encode_decode(docs, Scratch(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
]

#: Near-duplicate components, language models and token ids are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
