"""Connected components of a link table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that can be reached.

    Stars around smallest ids, which most links of a table form, are seen by each node's least and largest neighbour and
    done at once. Else rounds follow: every node goes to the smallest id around it, and links are drawn between what their
    ends went to; those that end in one node are gone. From the third round on nodes go all the way down, so the number of
    nodes that are left halves at least. Minima are pre-aggregated, and no node's links meet in one task.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels, number = None, 0
    while True:
        number += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        down = written(around.select(F.col("a").alias("id"), F.least("a", "low").alias("to"), ((F.col("low") < F.col("a")) & (F.col("low") < F.col("high"))).alias("open")))
        stars, down = down.filter("open").isEmpty(), down.drop("open")
        while number > 2 and not stars:
            then = down.select(F.col("id").alias("via"), F.col("to").alias("far"))
            jumped = written(down.join(then.hint("merge"), F.col("to") == F.col("via")).select("id", F.col("far").alias("to"), (F.col("to") != F.col("far")).alias("moved")))
            down = jumped.select("id", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = down.select("id", F.col("to").alias("component")) if labels is None else _followed(labels, down)
        if stars:
            return labels
        ends = [down.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")).hint("merge") for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("a_to <> b_to")
        edges = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _followed(labels: DataFrame, down: DataFrame) -> DataFrame:
    """labels (id, component), each component replaced by what it goes to in down (id, to)."""
    then = down.toDF("via", "far")
    return labels.join(then.hint("merge"), labels.component == then.via, "left").select("id", F.coalesce("far", "component").alias("component"))
