"""Deletes by age and by size of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LEAST


def delete_rows(spark, ranges: list[tuple[int, int | None, int]]) -> DataFrame:
    """A delete table from (t1, t2, seq); a t2 of None is open. Empty ranges take no row; t1 > t2 is an error."""
    for t1, t2, _ in ranges:
        if t2 is not None and t1 > t2:
            raise ValueError("a range must not end before it starts")
    return spark.createDataFrame([(s, a, b) for a, b, s in ranges if b is None or a < b], "seq long, t1 long, t2 long")


def age_cutoff(rows: DataFrame, keep: int) -> int | None:
    """Latest visible timestamp - keep; None for an empty log."""
    latest = rows.agg(F.max("ts")).head()[0]
    return None if latest is None else max(LEAST, latest - keep)


def oldest_batches(rows: DataFrame, target: int, batch: str = "seq") -> DataFrame:
    """(batch, first_ts, last_ts, n): the oldest batches, as few as leave at most `target` rows. Batches are counted before they are put in order."""
    counts = rows.groupBy(batch).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc(batch)).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("kept", newer).filter(F.col("kept") > target).drop("kept")
