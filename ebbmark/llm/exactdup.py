"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Each round splits the open groups by the next bytes of their texts. A group that is down to one document, or whose texts
end, is settled; the rest goes on with the bytes that follow. Chunks widen from round to round, so the longest text of n
bytes takes about log(n) rounds. Groups are compared by their bytes, never by a digest. Counting is pre-aggregated, and
where a group holds more than a partition's even share of rows, its rows meet it in as many places as it holds such shares.

Null texts count as empty. Repeated rows (same id, same text) are copies of each other. A null id is the smallest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of, written

#: Bytes of the first chunk, and how many times wider each chunk is than the one before.
FIRST, WIDER = 64, 16


def spread(rows: DataFrame, groups: DataFrame, by: list[str], partitions: int) -> tuple[DataFrame, DataFrame]:
    """rows and groups (by, n) with a column part, to be joined on by and part: groups of more than an even share of rows have several parts. What is broadcast are two numbers for each of these, of which there are at most as many as partitions."""
    share = max(1, -(-(groups.agg(F.sum("n")).head()[0] or 0) // partitions))
    place = F.xxhash64(*by)  # only says where a row goes: equal places are harmless
    hot = groups.filter(F.col("n") > share).groupBy(place.alias("place")).agg(F.max(F.ceil(F.col("n") / share)).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = rows.withColumn("place", place).join(F.broadcast(hot), "place", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts))
    right = groups.withColumn("place", place).join(F.broadcast(hot), "place", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left.drop("place", "parts"), right.drop("place", "parts")


def _settled(docs: DataFrame, key: str, text: str, first: int, wider: int, carry: list[str]) -> DataFrame:
    """Per row: key, text_sha256, keep_id, group_size, group (a number of the group of equal texts, null where it has one row), and the columns to carry."""
    data, partitions = text_of(text).cast("binary"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    still = docs.select(F.col(key).cast("long").alias("key"), F.sha2(data, 256).alias("text_sha256"), F.lit(0).cast("long").alias("group"), data.alias("rest"), *carry)
    done, width = [], first
    while True:
        head = still.withColumns({"chunk": F.substring("rest", 1, width), "ended": F.length("rest") <= width})
        by = ["group", "chunk", "ended"]
        # A group's number is fixed by being written; groups of one need none. They grow with the input, so they are never broadcast.
        groups = written(head.groupBy(*by).agg(F.count("*").alias("n"), F.max("key").alias("keep")).filter("n > 1").withColumn("next", F.monotonically_increasing_id()))
        left, right = spread(head, groups, by, partitions)
        settled = F.col("n").isNull() | F.col("ended")
        split = written(
            left.join(right.hint("merge"), [*by, "part"], "left").select(
                "key", "text_sha256", settled.alias("settled"), "next", *carry,
                F.coalesce("n", F.lit(1)).alias("group_size"), F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep")).alias("keep_id"),
                F.when(~settled, F.substring("rest", width + 1, 2**31 - 1 - width)).alias("rest"),
            )
        )
        done.append(split.filter("settled").select("key", "text_sha256", "keep_id", "group_size", F.lit(len(done)).alias("round"), F.col("next").alias("group"), *carry))
        still = split.filter("NOT settled").select("key", "text_sha256", F.col("next").alias("group"), "rest", *carry)
        if still.isEmpty():
            return reduce(DataFrame.unionAll, done)
        width *= wider


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """One row per document: key, keep_id (largest key of the group of equal texts), group_size, kept (key is keep_id), and text_sha256."""
    out = _settled(docs, key, text, first, wider, [])
    return out.select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: one with the largest key (null is the smallest), any one where that key is repeated. Each row is decided by itself, whatever other rows its key has."""
    names = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    rows = _settled(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(n) for c, n in names.items()]), "__key", "__text", FIRST, WIDER, list(names.values()))
    best = rows.filter(F.col("key").eqNullSafe(F.col("keep_id")))
    single, several = best.filter("group IS NULL"), best.filter("group IS NOT NULL")
    # Rows of a repeated key: one for each group and key, pre-aggregated before they meet.
    one = several.groupBy("round", "group").agg(F.first(F.struct(*names.values())).alias("r")).select("r.*")
    return single.select(*names.values()).unionAll(one).toDF(*names)
