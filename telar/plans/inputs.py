"""Inputs of the registered queries, derived from the tables by SQL that Spark and the checking engine both run."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of `sql`, whose {table} names stand for the tables in sf_dir."""
    mark = zlib.crc32(sf_dir.encode())
    for t in TABLES:
        if "{" + t + "}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"telar_{t}_{mark}")
            sql = sql.replace("{" + t + "}", f"telar_{t}_{mark}")
    return spark.sql(sql)


def oracle(sql: str) -> str:
    """The same SQL for the other engine."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer input splits than there are cores are dealt to all cores, so that costly column functions don't share
    one task; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


RISKS = """
SELECT o_custkey AS tender_id, o_orderkey AS seq, concat('risk ', CAST(o_orderkey AS STRING)) AS description,
  CASE o_orderkey % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'legal' WHEN 2 THEN 'technical' ELSE 'reputational' END AS category,
  CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'low' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium'
       WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0 THEN 'critical' ELSE 'high' END AS severity,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS probability
FROM {orders}"""

VERDICTS = """
SELECT o_custkey AS tender_id, o_orderkey AS seq, CAST(1 + o_orderkey % 40 AS INT) AS page,
  CASE o_orderkey % 11 WHEN 0 THEN 'non_compliant' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing_info' ELSE 'compliant' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'desirable' ELSE 'mandatory' END AS severity,
  CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN 'no json here { broken' ELSE concat('Verdict: {"status": "',
    CASE o_orderkey % 11 WHEN 0 THEN 'NON_COMPLIANT' WHEN 1 THEN 'partial' WHEN 2 THEN 'unclear' ELSE 'compliant' END,
    '"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', "severity_detected": "', CASE o_orderkey % 3 WHEN 0 THEN 'desirable' ELSE 'mandatory' END, '"') END,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(', "confidence_score": 0.', CAST(10 + o_orderkey % 90 AS STRING)) END,
    ', "gap_analysis": null} end') END AS reply,
  concat('El sistema ', CASE o_orderkey % 4 WHEN 0 THEN 'deberá' WHEN 1 THEN 'puede, deseable,' WHEN 2 THEN 'should' ELSE 'x' END, ' cumplir ', CAST(o_orderkey AS STRING)) AS requirement_text
FROM {orders}"""
