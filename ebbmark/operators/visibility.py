"""The rows of a log that a snapshot shows.

A log is two tables: inserts (seq, ts, ...) and deletes (seq, t1, t2; the half-open range [t1, t2), open where t2 is
null). Every call takes the next sequence number. A row is visible in snapshot S if its seq is at most S and no delete up
to S that covers its ts has a larger seq; at equal seq the row stays. Equal timestamps and equal rows all stay.

Two plans give that: with few deletes they are broadcast into a range anti-join; with many, deletes are cut at bucket
bounds and rows meet them in an equi-join on the bucket, which Spark shuffles, splits where a bucket is large, or
broadcasts as their size asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LEAST, MOST, floor_div

#: Deletes up to which the range join is taken (measured in bench.py: the bucketed join wins from tens of deletes on).
FEW = 32
#: Buckets across the rows' range: so many for each delete, within bounds.
PER_DELETE, FEWEST, MOST_BUCKETS = 4, 64, 1 << 16
#: Levels of dyadic ranges: enough for MOST_BUCKETS and one more.
LEVELS = 17


def as_of(rows: DataFrame, snapshot: int | None) -> DataFrame:
    return rows if snapshot is None else rows.filter(F.col("seq") <= snapshot)


def in_range(column: str, t1: int | None, t2: int | None) -> Column:
    """t1 <= column < t2; an end that is None is open. Plain comparisons, so they reach the Parquet reader."""
    out = F.lit(True)
    if t1 is not None and t1 > LEAST:
        out = out & (F.col(column) >= t1)
    if t2 is not None:
        out = out & (F.col(column) < t2)
    return out


def overlapping(deletes: DataFrame, t1: int | None, t2: int | None) -> DataFrame:
    """The deletes that matter in a range, clipped to it."""
    out = deletes.filter(F.col("t2").isNull() | (F.col("t1") < F.col("t2")))
    if t1 is not None:
        out = out.filter(F.col("t2").isNull() | (F.col("t2") > t1)).withColumn("t1", F.greatest("t1", F.lit(t1)))
    if t2 is not None:
        out = out.filter(F.col("t1") < t2).withColumn("t2", F.least(F.coalesce("t2", F.lit(t2)), F.lit(t2)))
    return out


def by_range_join(rows: DataFrame, deletes: DataFrame, how: str = "left_anti") -> DataFrame:
    """Join on the range; deletes are broadcast, so call it with few. how: left_anti for the rows that stay, left_semi for those that deletes hide."""
    d = F.broadcast(deletes.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("seq").alias("__seq")))
    return rows.join(d, (F.col("ts") >= F.col("__t1")) & (F.col("__t2").isNull() | (F.col("ts") < F.col("__t2"))) & (F.col("__seq") > F.col("seq")), how)


def _nodes(a: Column, b: Column) -> Column:
    """The dyadic ranges (level, index) that make up buckets a to b, at most two a level."""
    node = lambda level, index: F.array(F.struct(level.cast("int").alias("level"), index.alias("index")))
    none = F.array().cast("array<struct<level:int,index:bigint>>")

    def step(s: Column, level: Column) -> Column:
        going = s["l"] < s["r"]
        left, right = going & (s["l"] % 2 == 1), going & (s["r"] % 2 == 1)
        found = F.concat(s["nodes"], F.when(left, node(level, s["l"])).otherwise(none), F.when(right, node(level, s["r"] - 1)).otherwise(none))
        up = lambda x: F.shiftright(x, 1)
        return F.struct(up(s["l"] + F.when(left, 1).otherwise(0)).alias("l"), up(s["r"] - F.when(right, 1).otherwise(0)).alias("r"), found.alias("nodes"))

    start = F.struct(a.alias("l"), (b + 1).alias("r"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["nodes"])


def pieces(deletes: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """(bucket, first, last, seq): deletes cut at bucket bounds between least and most, both ends included. Of deletes that cover a whole bucket only the latest stays: they are counted by dyadic ranges of buckets, so a delete over any number of buckets is a few rows, and those go down to the buckets, whose number is bounded."""
    ends = deletes.filter(F.col("t2").isNull() | (F.col("t1") < F.col("t2"))).select(
        F.greatest("t1", F.lit(least)).alias("first"), F.least(F.when(F.col("t2").isNull(), F.lit(MOST)).otherwise(F.col("t2") - 1), F.lit(most)).alias("last"), "seq"
    )
    base, top = least // width, most // width
    cut = ends.filter("first <= last").withColumns({"lo": floor_div("first", width), "hi": floor_div("last", width)})
    none = F.lit(None).cast("long")
    piece = lambda bucket, first, last: F.struct(bucket.alias("bucket"), first.alias("first"), last.alias("last"))
    edges = F.when(F.col("lo") == F.col("hi"), F.array(piece(F.col("lo"), F.col("first"), F.col("last")))).otherwise(F.array(piece(F.col("lo"), F.col("first"), none), piece(F.col("hi"), none, F.col("last"))))
    parts = cut.select(F.explode(edges).alias("p"), "seq").select("p.*", "seq")
    long = cut.filter("hi - lo >= 2").select(F.explode(_nodes(F.col("lo") + 1 - base, F.col("hi") - 1 - base)).alias("node"), "seq").groupBy("node").agg(F.max("seq").alias("seq"))
    grid = deletes.sparkSession.range(top - base + 1).select((F.col("id") + base).alias("bucket"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.expr("id").alias("index")))).alias("n"))
    grid = grid.select("bucket", F.struct(F.col("n.level").alias("level"), F.expr("shiftright(n.index, n.level)").alias("index")).alias("node"))
    whole = grid.join(long, "node").groupBy("bucket").agg(F.max("seq").alias("seq")).select("bucket", none.alias("first"), none.alias("last"), "seq")
    return parts.unionByName(whole).groupBy("bucket", "first", "last").agg(F.max("seq").alias("seq"))


def by_buckets(rows: DataFrame, deletes: DataFrame, width: int, least: int, most: int, how: str = "left_anti") -> DataFrame:
    """Join on the bucket, then the range. least, most: bounds of the rows' timestamps."""
    p = pieces(deletes, width, least, most).select(F.col("bucket").alias("__bucket"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("seq").alias("__seq"))
    hit = (F.col("__b") == F.col("__bucket")) & (F.col("__first").isNull() | (F.col("ts") >= F.col("__first"))) & (F.col("__last").isNull() | (F.col("ts") <= F.col("__last"))) & (F.col("__seq") > F.col("seq"))
    return rows.withColumn("__b", floor_div("ts", width)).join(p, hit, how).drop("__b")


def _joined(rows: DataFrame, deletes: DataFrame, few: int, width: int | None, how: str) -> DataFrame | None:
    """None where no delete or no row is there."""
    n = deletes.limit(few + 1).count()
    if not n:
        return None
    if n <= few:
        return by_range_join(rows, deletes, how)
    least, most = rows.agg(F.min("ts"), F.max("ts")).head()
    if least is None:
        return None
    if width is None:
        width = max(1, (most - least) // min(MOST_BUCKETS, max(FEWEST, PER_DELETE * deletes.count())) + 1)
    return by_buckets(rows, deletes, min(width, MOST), least, most, how)


def visible(rows: DataFrame, deletes: DataFrame, t1: int | None = None, t2: int | None = None, snapshot: int | None = None, few: int = FEW, width: int | None = None) -> DataFrame:
    """The visible rows with t1 <= ts < t2. few: deletes up to which the range join is taken; width: of buckets, else from the rows' bounds."""
    shown = as_of(rows, snapshot).filter(in_range("ts", t1, t2))
    out = _joined(shown, overlapping(as_of(deletes, snapshot), t1, t2), few, width, "left_anti")
    return shown if out is None else out


def covered(rows: DataFrame, deletes: DataFrame, snapshot: int | None = None, few: int = FEW) -> DataFrame:
    """The rows that deletes hide: what compaction drops."""
    all_ = as_of(rows, snapshot)
    out = _joined(all_, overlapping(as_of(deletes, snapshot), None, None), few, None, "left_semi")
    return all_.limit(0) if out is None else out
