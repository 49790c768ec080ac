"""Reads of visible rows: ranges, points, batches, counts, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq", "rid")


def ordered(rows: DataFrame) -> DataFrame:
    """By time; ties by sequence number, then row id, so that reading again gives the same order."""
    return rows.orderBy(*[c for c in ORDER if c in rows.columns])


def first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in order: a top-k, not a sort."""
    return ordered(rows).limit(n)


def at(rows: DataFrame, ts: int) -> DataFrame:
    """Rows at exactly ts. An equality, so the largest timestamp works too."""
    return rows.filter(F.col("ts") == ts)


def at_each(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows at any of the timestamps in probes (ts): one job for all of them. Rows aren't repeated for repeated probes."""
    return rows.join(probes.select("ts").distinct(), "ts", "left_semi")


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def least_ts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("ts").alias("ts"))


def most_ts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("ts").alias("ts"))


def next_ts(rows: DataFrame, ts: int) -> DataFrame:
    """The least timestamp above ts; null if there is none."""
    return rows.filter(F.col("ts") > ts).agg(F.min("ts").alias("ts"))


def prev_ts(rows: DataFrame, ts: int) -> DataFrame:
    """The largest timestamp below ts; null if there is none."""
    return rows.filter(F.col("ts") < ts).agg(F.max("ts").alias("ts"))


def neighbours(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """(ts, prev_ts, next_ts) for each distinct timestamp. Each bucket of time finds its own neighbours; only the bounds of buckets, at most that many rows, are put in order in one task."""
    times = rows.select("ts").distinct()
    least, most = times.agg(F.min("ts"), F.max("ts")).head()
    if least is None:
        return times.withColumns({"prev_ts": F.col("ts"), "next_ts": F.col("ts")})
    width = (most - least) // buckets + 1
    placed = times.withColumn("b", ((F.col("ts").cast("decimal(38,0)") - least) / width).cast("decimal(38,6)")).withColumn("b", F.floor("b").cast("long"))
    w, across = Window.partitionBy("b").orderBy("ts"), Window.orderBy("b")
    edges = placed.groupBy("b").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    edges = edges.select("b", F.lag("hi").over(across).alias("before"), F.lead("lo").over(across).alias("behind"))
    inner = placed.withColumns({"p": F.lag("ts").over(w), "n": F.lead("ts").over(w)})
    return inner.join(edges, "b").select("ts", F.coalesce("p", "before").alias("prev_ts"), F.coalesce("n", "behind").alias("next_ts"))


def every_nth(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Rows 0, n, 2n .. in order, at most `most` of them: a sample of the first n * most rows."""
    head = first(rows, n * (most - 1) + 1) if most else rows.limit(0)
    return head.withColumn("__k", F.row_number().over(Window.orderBy(*[c for c in ORDER if c in rows.columns])) - 1).filter(F.col("__k") % n == 0).drop("__k")


def union_all(*logs: DataFrame) -> DataFrame:
    """All rows of several sources, equal ones too."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, as multisets."""
    return a.exceptAll(b)
