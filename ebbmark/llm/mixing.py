"""Mixing sources to target weights by Poisson replication.

Each source has a target rate of repetition: its target share of the mixture times the mixture's size, over its own size.
A document's number of copies is drawn from the Poisson distribution with that mean, by inverting the distribution at a
number from 0 to 1 hashed from seed and document. So a document's count depends on nothing but itself and the rates, and
any task that is run again draws the same. A rate too high for one draw is drawn as a sum of several. Copies are then spread over the whole output by a second hash.

Sizes are counted over all documents. A null source is a source of its own; null texts count as empty (size 0); null ids
hash as an empty string. Repeated rows draw equal counts. A source of size 0, and one that the weights don't name, has
rate 0 unless every weight is left to the rule. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of, written

#: The default rule: a source's weight is its size to this power, which lifts small sources.
POWER = 0.7
SEED = 7
#: Highest rate of one draw; exp(-rate) must not vanish. A higher rate is the sum of as many independent draws as it needs.
MOST_RATE = 500.0
#: Sources up to which their rates are broadcast (some 20 kB each at the highest rate, far less usually).
MOST_BROADCAST = 1_000
#: Uniform numbers have this many bits, all exact in a double.
BITS = 52


def uniform(seed: int, what: str, *columns: str, draw: Column | None = None) -> Column:
    """From 0 to below 2**BITS, hashed from a label, the number of the draw (none for the first), and columns."""
    label = [F.lit(f"{seed}|{what}")] if draw is None else [F.concat(F.lit(f"{seed}|{what}"), draw.cast("string"))]
    text = F.concat_ws("|", *label, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2 .. as integers below 2**BITS, until its complement is under 1e-14 for any rate: far enough beyond the mean."""
    most = (rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(F.array(F.floor(F.exp(-rate) * F.lit(float(2**BITS))).cast("long")).alias("steps"), F.exp(-rate).alias("p"), F.exp(-rate).alias("sum")),
        lambda a, k: F.struct(
            F.array_append(a["steps"], F.floor((a["sum"] + a["p"] * rate / k) * F.lit(float(2**BITS))).cast("long")).alias("steps"),
            (a["p"] * rate / k).alias("p"),
            (a["sum"] + a["p"] * rate / k).alias("sum"),
        ),
        lambda a: a["steps"],
    )


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source", text: str = "text", power: float = POWER) -> DataFrame:
    """Per source: its size in characters, target share, and rate. weights: by source (others get none); without them the rule of POWER. total: the mixture's size, by default that of docs."""
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.length(text_of(text))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("__source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    sizes = written(sizes)
    weights_sum, size_sum = sizes.agg(F.sum("weight"), F.sum("size")).head()
    share = F.col("weight") / F.lit(weights_sum) if weights_sum else F.lit(0.0)
    rate = F.when(F.col("size") > 0, F.lit(float(total or size_sum or 0)) * F.col("share") / F.col("size")).otherwise(0.0)
    return written(sizes.withColumn("share", share).select("__source", "size", "share", rate.alias("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, power: float = POWER, partitions: int | None = None) -> DataFrame:
    """docs with each row as often as drawn, in an order that mixes all sources, with columns rate, copies, copy (from 0) and place (a hash; rows are sorted by it)."""
    names = {"rate", "copies", "copy", "place"}
    rates = source_rates(docs, weights, total, source, text, power)
    few = rates.count() <= MOST_BROADCAST
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE).cast("int"))
    rates = rates.withColumn("__draws", draws).select("__source", "rate", "__draws", poisson_steps(F.col("rate") / F.col("__draws")).alias("__steps"))
    rows = docs.select(*[c for c in docs.columns if c not in names])
    joined = rows.join(F.broadcast(rates) if few else rates, F.col(source).eqNullSafe(F.col("__source")))
    # Inversion: the count is the number of steps at or below the uniform number, which is where the number after it sorts.
    one = lambda u: F.array_position(F.sort_array(F.array_append("__steps", u + 1)), u + 1) - 1
    more = F.aggregate(F.sequence(F.lit(1), F.col("__draws") - 1), F.lit(0).cast("long"), lambda a, j: a + one(uniform(seed, "count", key, draw=j)))
    copies = one(uniform(seed, "count", key)) + F.when(F.col("__draws") > 1, more).otherwise(0)
    drawn = joined.withColumn("copies", copies.cast("int"))
    copied = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("__source", "__steps", "__draws")
    placed = copied.withColumn("place", uniform(seed, "place", key, "copy"))
    spread = placed.repartitionByRange(partitions, "place") if partitions else placed.repartition(F.pmod(F.col("place"), F.lit(1 << 20)))
    return spread.sortWithinPartitions("place", key, "copy")
