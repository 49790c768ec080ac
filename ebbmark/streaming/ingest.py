"""Structured Streaming into a log. Late rows are always accepted: the sequence rule alone decides what is visible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Sequence numbers of a micro-batch lie in a range of its own.
PER_BATCH = 1 << 32


def batch_seq(batch: int, call: int = 0) -> int:
    return batch * PER_BATCH + call + 1


def ingest(stream: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of (ts, ...) to the inserts below folder. Each micro-batch is one call with one sequence number, written to a folder of its own, which a repeated micro-batch overwrites: exactly once."""

    def save(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.withColumn("seq", F.lit(batch_seq(number)).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucket_counts(stream: DataFrame, size: str, late: str, ts: str = "ts") -> DataFrame:
    """Counts in tumbling windows of a stream of timestamps, final once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
