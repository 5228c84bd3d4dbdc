"""Structured Streaming jobs: ingest of page files, repeated questions, live counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions.text import chunk_id


def ingest(pages: DataFrame, size: int = 1000) -> DataFrame:
    """Streaming pages to chunk rows of `size` characters with ids; stateless."""
    places = F.sequence(F.lit(1), F.length("text"), F.lit(size))
    rows = pages.filter(F.length("text") > 0).select("source_file", "page_number", F.posexplode(F.transform(places, lambda a: F.substring(F.col("text"), a, F.lit(size)))).alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("page_number"), F.col("content")))


def drop_repeats(questions: DataFrame, seconds: int = 300) -> DataFrame:
    """Questions (question_key, ts) but those asked again within the time to live of the last one that was kept, the limit included.

    The state of a key is one time, dropped when the watermark has passed it by the time to live. Rows of a batch are
    taken in the order of time; one that comes late is measured against the last one kept.
    """
    def fresh(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, kept = (state.get[0] if state.exists else None), []
        for us in np.sort(np.concatenate([f["us"].to_numpy() for f in frames])).tolist():
            if last is None or us - last > seconds * 1_000_000:
                last = us
                kept.append(us)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        if kept:
            yield pd.DataFrame({"question_key": [key[0]] * len(kept), "ts": pd.to_datetime(kept, unit="us", utc=True)})

    rows = questions.select("question_key", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", f"{seconds} seconds")
    return rows.groupBy("question_key").applyInPandasWithState(fresh, "question_key string, ts timestamp", "last long", "append", "EventTimeTimeout")


def live_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the keys that a batch has changed in a folder of the batch's own, so that a batch done again replaces what it wrote."""
    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keep


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """What upsert() keeps, one row a key: that of the last batch which changed it."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and end; parquet for appended rows, else the changed keys of each batch, for latest()."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", path).start() if mode == "append" else writer.foreachBatch(upsert(path)).start()
    query.awaitTermination()
