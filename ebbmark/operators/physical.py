"""Files of a log: windows, compaction, what it drops and must keep, delete debt, spans, layout figures and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LEAST, MOST, window_end, window_id, window_start
from .skyline import skyline
from .visibility import covered, visible

#: Windows beyond which the debt counts as full.
MOST_WINDOWS = 1000


def with_window(rows: DataFrame, size: int, origin: int = 0) -> DataFrame:
    return rows.withColumn("window_id", window_id("ts", size, origin))


def compacted(rows: DataFrame, deletes: DataFrame, size: int, origin: int = 0) -> DataFrame:
    """What compaction writes: the visible rows with their window."""
    return with_window(visible(rows, deletes), size, origin)


def dropped(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """What it removes: exactly the other rows."""
    return covered(rows, deletes)


def residual(deletes: DataFrame, first_window: int, last_window: int, size: int, origin: int = 0) -> DataFrame:
    """Deletes to keep after windows first to last were rewritten: what of each lies outside of them."""
    spark = deletes.sparkSession
    lo, hi = spark.range(1).select(window_start(f"{first_window}L", size, origin), window_end(f"{last_window}L", size, origin)).head()
    left = deletes.filter(F.col("t1") < lo).withColumn("t2", F.least(F.coalesce("t2", F.lit(lo)), F.lit(lo))).filter("t1 < t2") if lo > LEAST else deletes.limit(0)
    if hi is None:
        return left
    right = deletes.filter(F.col("t2").isNull() | (F.col("t2") > hi)).withColumn("t1", F.greatest("t1", F.lit(hi)))
    return left.unionByName(right)


def delete_debt(deletes: DataFrame, size: int, origin: int = 0) -> DataFrame:
    """One row, debt: the largest covered share of a window. 1 if a delete has no end, or covers more than MOST_WINDOWS windows; 0 without deletes."""
    steps = skyline(deletes)
    wide = steps.withColumns({"lo": window_id("start", size, origin), "hi": window_id("end - 1L", size, origin)})
    full = F.col("end").isNull() | (F.col("hi").cast("decimal(38,0)") - F.col("lo") >= MOST_WINDOWS)
    debt = wide.filter(~full).withColumn("window_id", F.explode(F.sequence("lo", "hi")))
    overlap = F.least("end", F.coalesce(window_end("window_id", size, origin), F.lit(MOST))) - F.greatest("start", window_start("window_id", size, origin))
    by = debt.groupBy("window_id").agg((F.sum(overlap) / F.lit(size)).alias("debt"))
    all_ = by.select("debt").union(wide.filter(full).limit(1).select(F.lit(1.0)))
    return all_.agg(F.least(F.coalesce(F.max("debt"), F.lit(0.0)), F.lit(1.0)).alias("debt"))


def spans(rows: DataFrame, by: list[str], t1: int | None = None, t2: int = MOST) -> DataFrame:
    """A row for each stored part (file, window or page, as `by` names) that has rows in [t1, t2): how many, and the first and last of their timestamps. Deletes don't count here."""
    inside = rows.filter((F.col("ts") < t2) & (F.col("ts") >= t1 if t1 is not None else F.lit(True)))
    return inside.groupBy(*by).agg(F.count("*").alias("rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))


def file_spans(table: DataFrame, t1: int | None = None, t2: int = MOST) -> DataFrame:
    """spans by file, of rows that were read from files."""
    return spans(table.withColumn("file", F.col("_metadata.file_path")), ["file"], t1, t2)


def layout(rows: DataFrame, deletes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row of figures. raw_min_ts and raw_max_ts hold before deletes and take in the deletes' own ends; visible_rows after them."""
    raw = rows.agg(F.count("*").alias("rows"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("seq").alias("last_insert"))
    cuts = deletes.agg(F.count("*").alias("deletes"), F.min("t1").alias("c"), F.max(F.coalesce("t2", F.lit(MOST))).alias("d"), F.max("seq").alias("last_delete"))
    seen = visible(rows, deletes, snapshot=snapshot).agg(F.count("*").alias("visible_rows"))
    one = raw.join(F.broadcast(cuts)).join(F.broadcast(seen))
    return one.select("rows", "visible_rows", "deletes", F.least("a", "c").alias("raw_min_ts"), F.greatest("b", "d").alias("raw_max_ts"), F.greatest("last_insert", "last_delete").alias("op_seq"))


def check_windows(table: DataFrame, size: int, origin: int = 0) -> DataFrame:
    """Rows outside of their window; none in a sound table."""
    return table.filter(F.col("window_id") != window_id("ts", size, origin))


def check_steps(steps: DataFrame) -> DataFrame:
    """Steps that are empty, overlap, or could be merged; none in a sound step function. By sorting ranges, one task for all: meant for tests and small sets."""
    from pyspark.sql import Window

    w = Window.orderBy("start")
    before, height = F.lag(F.coalesce("end", F.lit(MOST))).over(w), F.lag("max_seq").over(w)
    marked = steps.withColumns({"before": before, "height": height})
    return marked.filter("start >= coalesce(end, 9223372036854775807) OR before > start OR (before = start AND height = max_seq)")


def check_compaction(rows: DataFrame, kept: DataFrame, gone: DataFrame, key: str = "rid") -> DataFrame:
    """One row: input, kept and dropped rows, and whether they add up."""
    n = rows.agg(F.count("*").alias("input")).join(F.broadcast(kept.agg(F.count("*").alias("kept")))).join(F.broadcast(gone.agg(F.count("*").alias("dropped"))))
    return n.withColumn("sound", F.col("input") == F.col("kept") + F.col("dropped"))
