"""Queries over ranges of visible rows. Those that are time-bucketed count from the smallest visible timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from .scans import first

#: Parts that interpolated() cuts a bucket of values into, and rows up to which a bucket is cut into its single values.
CUTS = 8192


def head_window(rows: DataFrame, span: int) -> DataFrame:
    """Rows of [first, first + span), with column start: the smallest timestamp. The smallest comes first, so the range reaches the reader as a literal."""
    start = rows.agg(F.min("ts")).head()[0]
    if start is None:
        return rows.limit(0).withColumn("start", F.lit(0).cast("long"))
    return rows.filter((F.col("ts") >= start) & (F.col("ts") < start + span)).withColumn("start", F.lit(start).cast("long"))


def bucket_counts(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket, n, average): counts in each of the first buckets, empty ones too."""
    counts = head_window(rows, size * buckets).groupBy(floor_div("ts - start", size).alias("bucket")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).withColumn("average", F.avg("n").over(Window.partitionBy(F.lit(1))))


def spikes(rows: DataFrame, size: int, buckets: int, times: float = 2.0) -> DataFrame:
    """Buckets with more than `times` the average count."""
    return bucket_counts(rows, size, buckets).filter(F.col("n") > times * F.col("average"))


def ratio(rows: DataFrame, is_buy: Column) -> DataFrame:
    """buys, sells (all others), and buys / sells, infinite without sells."""
    counts = rows.agg(F.count_if(is_buy).alias("buys"), F.count_if(~F.coalesce(is_buy, F.lit(False))).alias("sells"))
    return counts.withColumn("ratio", F.when(F.col("sells") > 0, F.col("buys") / F.col("sells")).otherwise(F.lit(float("inf"))))


def vwap(rows: DataFrame, filled: Column, bid: Column, ask: Column, amount: Column) -> DataFrame:
    """Mean price by volume of filled rows; a missing or zero bid falls back to the ask; 0 without volume."""
    price = F.when(bid.isNull() | (bid == 0), ask).otherwise(bid)
    sums = rows.filter(filled).agg(F.coalesce(F.sum(price * amount), F.lit(0.0)).alias("value"), F.coalesce(F.sum(amount), F.lit(0)).alias("volume"))
    return sums.select("volume", F.when(F.col("volume") > 0, F.col("value") / F.col("volume")).otherwise(0.0).alias("vwap"))


def shares(rows: DataFrame, status: Column, filled: str, open_: str) -> DataFrame:
    """filled, opened and partial (all others), and filled / all; 0 without rows."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(status == filled).alias("filled"), F.count_if(status == open_).alias("opened"))
    return counts.select("filled", "opened", (F.col("total") - F.col("filled") - F.col("opened")).alias("partial"), F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(0.0).alias("fill_rate"))


def top_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys; ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def spread(rows: DataFrame, bid: Column, ask: Column) -> DataFrame:
    """Average, least and largest ask - bid over rows with a bid; 0 without any."""
    gap = F.when(bid.isNotNull(), ask - bid)
    return rows.agg(*[F.coalesce(f(gap), F.lit(0.0)).alias(n) for f, n in ((F.avg, "average"), (F.min, "least"), (F.max, "largest"))])


def gaps(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """(gap): differences of neighbouring timestamps in order, zeros too; in time buckets, whose bounds alone meet in one task."""
    least, most = rows.agg(F.min("ts"), F.max("ts")).head()
    if least is None:
        return rows.select(F.col("ts").alias("gap"))
    width = (most - least) // buckets + 1
    placed = rows.select("ts").withColumn("b", floor_div(f"(ts - {least}L)", width))
    inner = placed.select((F.col("ts") - F.lag("ts").over(Window.partitionBy("b").orderBy("ts"))).alias("gap")).filter("gap IS NOT NULL")
    edges = placed.groupBy("b").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return inner.union(edges.select((F.col("lo") - F.lag("hi").over(Window.orderBy("b"))).alias("gap")).filter("gap IS NOT NULL"))


def gap_histogram(rows: DataFrame, edges: tuple[int, ...] = (1_000, 10_000, 100_000, 1_000_000)) -> DataFrame:
    """(bucket, n, mean_gap): gaps below the first edge (zeros too), between edges, and from the last on; empty buckets too."""
    g = gaps(rows)
    place = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        place = F.when(F.col("gap") < edges[k], k).otherwise(place)
    counts = g.groupBy(place.cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("gap").alias("sum"))
    grid = rows.sparkSession.range(len(edges) + 1).select(F.col("id").alias("bucket"))
    every = Window.partitionBy(F.lit(1))
    full = grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum", F.lit(0)).alias("sum"))
    return full.select("bucket", "n", F.when(F.sum("n").over(every) > 0, F.sum("sum").over(every) / F.sum("n").over(every)).otherwise(0.0).alias("mean_gap"))


def describe_ts(rows: DataFrame) -> DataFrame:
    """Least, largest, mean and population deviation of timestamps, the latter two around the least, so that doubles suffice."""
    least = rows.agg(F.min("ts")).head()[0] or 0
    off = (F.col("ts") - F.lit(least)).cast("double")
    return rows.agg(F.min("ts").alias("least"), F.max("ts").alias("largest"), F.avg(off).alias("mean_offset"), F.stddev_pop(off).alias("deviation"))


def mean_gap(rows: DataFrame) -> DataFrame:
    """Mean difference of neighbours: the range over the number of gaps; null with fewer than two rows."""
    return rows.agg(F.when(F.count("*") > 1, (F.max("ts") - F.min("ts")) / (F.count("*") - 1)).alias("mean_gap"))


def lifecycle(rows: DataFrame, key: str, status: str, opened: str, filled: str, most: int = 100_000) -> DataFrame:
    """(ts, status) of the first opened key, from its opening until it is filled, at most so many rows."""
    start = first(rows.filter(F.col(status) == opened), 1).select(F.col(key).alias("__key"), F.col("ts").alias("__from"))
    own = rows.join(F.broadcast(start), F.col(key) == F.col("__key")).filter(F.col("ts") >= F.col("__from"))
    end = own.filter(F.col(status) == filled).agg(F.min("ts").alias("__to"))
    cut = own.join(F.broadcast(end), F.col("__to").isNull() | (F.col("ts") <= F.col("__to")))
    return cut.orderBy("ts", "seq").limit(most).select("ts", status)


def replay(rows: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows as offsets from the first timestamp."""
    start = rows.agg(F.min("ts")).head()[0] or 0
    return first(rows, n).withColumn("offset", F.col("ts") - start)


def quantile(values: DataFrame, column: str, percents: tuple[float, ...]) -> DataFrame:
    """(percent, value): the element at index int(p / 100 * (n - 1)) of the sorted values, without interpolation. Exact: values are counted first, so the sort is over distinct ones, and by range in as many tasks as they need."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
    parts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    upto = parts.join(before, parts.part == before.p).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    total = values.filter(F.col(column).isNotNull()).count()
    ranks = values.sparkSession.createDataFrame([(float(p), int(p / 100 * (total - 1))) for p in percents] if total else [], "percent double, rank long")
    hit = upto.join(F.broadcast(ranks), (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.select("percent", "value")


def disorder(rows: DataFrame, arrival: str, chunk: int = 1 << 20) -> DataFrame:
    """One row: rows with ts below the one before (adjacent), and below any before (overall), in order of arrival. Chunks of arrivals are scanned apart; their last and largest timestamps carry over."""
    placed = rows.select(F.col(arrival).alias("a"), "ts").withColumn("c", floor_div("a", chunk))
    w = Window.partitionBy("c").orderBy("a")
    inside = placed.withColumns({"before": F.lag("ts").over(w), "peak": F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    across = Window.orderBy("c")
    edges = placed.groupBy("c").agg(F.max_by("ts", "a").alias("last"), F.max("ts").alias("top"))
    edges = edges.select(F.col("c").alias("k"), F.lag("last").over(across).alias("last"), F.max("top").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("top"))
    both = inside.join(edges, F.col("c") == F.col("k")).select("ts", F.coalesce("before", "last").alias("before"), F.greatest("peak", "top").alias("peak"))
    return both.agg(F.count_if(F.col("ts") < F.col("before")).alias("adjacent"), F.count_if(F.col("ts") < F.col("peak")).alias("overall"))


def _buckets(values: DataFrame, span: Column, key: Column) -> list:
    """(span, key, n, lo, hi) of values v, in order of span and key."""
    return sorted(values.groupBy(span.alias("span"), key.alias("key")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())


def interpolated(rows: DataFrame, column: Column, shares: tuple[float, ...]) -> list[float | None]:
    """Interpolated percentiles, as F.percentile has them, which holds every value in one task; None without values. Nulls aren't counted, NaN is the largest.
    Exact: values are counted in buckets, by exponent first, and only buckets that a wanted rank lies in are cut again, until each holds one value: rows are read seven times at most, and CUTS + 1 counts a rank leave a task at most."""
    v = F.col("v")
    values = rows.select(column.cast("double").alias("v")).filter("v IS NOT NULL")
    exponent = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0))) + 1100  # 26 to 2124 for numbers, 2200 for infinity
    buckets = {0: _buckets(values, F.lit(0), F.when(F.isnan(v), 9999.0).when(v == 0, 0.0).otherwise(F.signum(v) * exponent))}
    total = sum(b.n for b in buckets[0])
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * share for share in shares]
    ranks = {f(p) for p in places for f in (math.floor, math.ceil)}
    spans, found = [(0, None, None, total)], {}
    while spans:
        cut = []
        for k, (before, *_) in enumerate(spans):
            for b in buckets[k]:
                inside = [r for r in ranks if before <= r < before + b.n]
                if inside and (b.lo == b.hi or math.isnan(b.lo)):
                    found |= dict.fromkeys(inside, b.lo)
                elif inside:
                    cut.append((before, b.lo, b.hi, b.n))
                before += b.n
        spans, within, span, key = cut, F.lit(False), F.lit(None), F.lit(None)
        for k, (_, lo, hi, n) in enumerate(spans):
            here = v.between(lo, hi)
            within, span = within | here, F.when(here, k).otherwise(span)
            key = F.when(here, v if n <= CUTS else F.floor((v - lo) / (F.lit(hi) - lo) * CUTS).cast("double")).otherwise(key)
        if spans:
            counted = _buckets(values.filter(within), span, key)
            buckets = {k: [b for b in counted if b.span == k] for k in range(len(spans))}
    ends = [(p, found[math.floor(p)], found[math.ceil(p)]) for p in places]
    return [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in ends]


def sample_stats(rows: DataFrame, column: str) -> DataFrame:
    """Median, interpolated 95th percentile, and median absolute deviation; nulls without values."""
    median, p95 = interpolated(rows, F.col(column), (0.5, 0.95))
    mad = None if median is None else interpolated(rows, F.abs(F.col(column) - F.lit(median)), (0.5,))[0]
    return rows.sparkSession.createDataFrame([(median, p95, mad)], "median double, p95 double, mad double")


def power_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Exponent, intercept and r2 of y against x in logarithms."""
    a, b = F.ln(x), F.ln(y)
    return rows.agg(F.regr_slope(b, a).alias("exponent"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def linear_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
