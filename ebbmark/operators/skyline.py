"""Sets of delete intervals as a step function: (start, end, max_seq), sorted, disjoint, neighbours of equal height merged; a null end is open.

The steps are made bucket by bucket, so no task sees all deletes; only the first and last step of each bucket, of which
there are at most BUCKETS, meet in one task to be merged across bucket bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LEAST, MOST, floor_div
from .visibility import pieces

BUCKETS = 1024


def _merged(steps: DataFrame, *by: str) -> DataFrame:
    """Neighbouring steps (first, last, seq) of equal height as one, within by."""
    w = Window.partitionBy(*by).orderBy("first") if by else Window.orderBy("first")
    joins = (F.lag("seq").over(w) == F.col("seq")) & (F.lag("last").over(w) == F.col("first") - 1)
    runs = steps.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return runs.groupBy(*by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("seq").alias("seq")).drop("run")


def skyline(deletes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The step function of deletes (seq, t1, t2). Empty ranges count for nothing."""
    real = deletes.filter(F.col("t2").isNull() | (F.col("t1") < F.col("t2")))
    ends = real.select(F.explode(F.array(F.when(F.col("t1") > LEAST, F.col("t1")), F.when(F.col("t2").isNotNull(), F.col("t2")))).alias("p"))
    least, most = ends.agg(F.min("p"), F.max("p")).head()
    if least is None:
        return real.groupBy().agg(F.min("t1").alias("start"), F.lit(None).cast("long").alias("end"), F.max("seq").alias("max_seq")).filter("max_seq IS NOT NULL")
    # Between the least and the largest end; outside of them the function has one step each.
    width = min(MOST, max(1, (most - least) // buckets + 1))
    cut = pieces(real, width, least, most).withColumns({
        "first": F.coalesce("first", F.greatest(_start("bucket", width), F.lit(least))),
        "last": F.coalesce("last", F.least(_last("bucket", width), F.lit(most))),
    }).persist()  # fmt: skip  # four branches below read it
    points = cut.select("bucket", F.col("first").alias("p")).union(cut.filter(F.col("last") < MOST).select("bucket", (F.col("last") + 1).alias("p"))).distinct()
    spans = points.withColumn("q", F.lead("p").over(Window.partitionBy("bucket").orderBy("p")) - 1).filter("q IS NOT NULL")
    rest = cut.groupBy("bucket").agg(F.max("last").alias("end"))
    spans = spans.union(points.groupBy("bucket").agg(F.max("p").alias("p")).join(rest, "bucket").filter("p <= end").select("bucket", "p", "end"))
    steps = spans.join(cut, "bucket").filter("first <= p AND last >= q").groupBy("bucket", "p", "q").agg(F.max("seq").alias("seq")).select("bucket", F.col("p").alias("first"), F.col("q").alias("last"), "seq")
    inner = _merged(steps, "bucket")
    around = Window.partitionBy("bucket")
    marked = inner.withColumn("edge", (F.col("first") == F.min("first").over(around)) | (F.col("last") == F.max("last").over(around)))
    low = real.filter(F.col("t1") == LEAST).agg(F.max("seq").alias("seq")).filter(F.col("seq").isNotNull() & F.lit(least > LEAST)).select(F.lit(LEAST).alias("first"), F.lit(max(least - 1, LEAST)).alias("last"), "seq")
    high = real.filter(F.col("t2").isNull()).agg(F.max("seq").alias("seq")).filter(F.col("seq").isNotNull() & F.lit(most < MOST)).select(F.lit(min(most + 1, MOST)).alias("first"), F.lit(MOST).alias("last"), "seq")
    edges = _merged(marked.filter("edge").select("first", "last", "seq").union(low).union(high))
    whole = marked.filter("NOT edge").select("first", "last", "seq").union(edges)
    open_end = real.filter(F.col("t2").isNull()).limit(1).count() > 0
    end = F.when(F.col("last") < MOST, F.col("last") + 1)
    return whole.select(F.col("first").alias("start"), end.alias("end") if open_end else F.coalesce(end, F.lit(MOST)).alias("end"), F.col("seq").alias("max_seq"))


def _start(bucket: str, width: int):
    return F.expr(f"CAST(greatest(CAST({bucket} AS DECIMAL(38,0)) * {width}, CAST({LEAST} AS DECIMAL(38,0))) AS BIGINT)")


def _last(bucket: str, width: int):
    return F.expr(f"CAST(least((CAST({bucket} AS DECIMAL(38,0)) + 1) * {width} - 1, CAST({MOST} AS DECIMAL(38,0))) AS BIGINT)")


def union(*sets: DataFrame) -> DataFrame:
    """The step function of several: the larger height where they overlap."""
    rows = [s.select(F.col("max_seq").alias("seq"), F.col("start").alias("t1"), F.col("end").alias("t2")) for s in sets]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return skyline(out.persist())  # it is read several times, and may itself be a long plan


def clip(steps: DataFrame, t1: int | None = None, t2: int | None = None) -> DataFrame:
    """Within [t1, t2); a bound that is None is open."""
    start = F.greatest("start", F.lit(t1)) if t1 is not None else F.col("start")
    end = F.least(F.coalesce("end", F.lit(t2)), F.lit(t2)) if t2 is not None else F.col("end")
    return steps.select(start.alias("start"), end.alias("end"), "max_seq").filter("end IS NULL OR start < end")


def lookup(steps: DataFrame, probes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """probes (ts) with the height at each, null where nothing covers it: an as-of join on buckets."""
    bounds = probes.agg(F.min("ts"), F.max("ts")).head()
    if bounds[0] is None:
        return probes.withColumn("max_seq", F.lit(None).cast("long"))
    width = min(MOST, max(1, (bounds[1] - bounds[0]) // buckets + 1))
    cut = pieces(steps.select(F.col("start").alias("t1"), F.col("end").alias("t2"), F.col("max_seq").alias("seq")), width, *bounds)
    p = cut.select(F.col("bucket").alias("__bucket"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("seq").alias("max_seq"))
    hit = (F.col("__b") == F.col("__bucket")) & (F.col("__first").isNull() | (F.col("ts") >= F.col("__first"))) & (F.col("__last").isNull() | (F.col("ts") <= F.col("__last")))
    return probes.withColumn("__b", floor_div("ts", width)).join(p, hit, "left").drop("__b", "__bucket", "__first", "__last")


def max_seq_at(deletes: DataFrame, ts: int) -> DataFrame:
    """One row: the largest seq of deletes that cover ts, or null."""
    return deletes.filter((F.col("t1") <= ts) & (F.col("t2").isNull() | (F.col("t2") > ts))).agg(F.max("seq").alias("max_seq"))


def covered_span(steps: DataFrame) -> DataFrame:
    """One row: how many timestamps the set covers, at most the largest 64-bit integer; that too if an end is open."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return steps.agg(F.when(F.max(F.col("end").isNull()), F.lit(MOST)).otherwise(F.least(F.coalesce(F.sum(wide("end") - wide("start")), F.lit(0)), F.lit(MOST).cast("decimal(38,0)")).cast("long")).alias("covered"))
