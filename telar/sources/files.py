"""Reading input files and keeping an index of chunks, partitioned by source."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "source_file string, page_number int, text string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="telar-")
    return f"{base.rstrip('/')}/telar-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended already; the folder goes with it
        pass


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe when executors are lost. Deleted when the driver ends."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as (path, content), for check_files()."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Page rows from parquet or JSON lines."""
    return spark.read.schema(PAGES).format(kind).load(path)


def append_to_index(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Add chunks to the index; each task writes what it has of a source, no batch loop."""
    chunks.write.mode(mode).partitionBy("source").parquet(path)


def replace_in_index(chunks: DataFrame, path: str) -> None:
    """Replace the sources that occur in chunks; others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def clear_index(spark: SparkSession, path: str) -> None:
    """Leave an empty index of the same columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("source", F.col("source").cast("string"))
