"""Order-book events: CSV, a seeded synthetic stream, sources that repeat, and exports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of an order-book file, their types, and the values of its two enumerations.
SCHEMA = "timestamp BIGINT, ticker STRING, isin STRING, direction STRING, status STRING, amount BIGINT, ask_price DOUBLE, bid_price DOUBLE, order_id BIGINT, commission DOUBLE"
DIRECTIONS, STATUSES = ("BUY", "SELL"), ("OPEN", "PARTIAL", "FILLED")
START_NS = 1_609_459_200_000_000_000


#: What a row must have besides values that read as their types: bid_price and isin may be empty.
REQUIRED = ("timestamp", "ticker", "direction", "status", "amount", "ask_price", "order_id", "commission")


def read_csv(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """Order-book rows of CSV files with a header. Not trusted: rows with too many fields, without a required value, or with a value that doesn't read as its type or isn't of its enumeration go. Any number is allowed, a negative one too, and a ticker or isin may be blank, which reads as an empty text."""
    if trusted:
        return spark.read.schema(SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    # Whole rows are parsed, whatever columns are read: a row is judged by all of its values.
    rows = spark.read.schema(SCHEMA).option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)
    rows = rows.withColumns({"ticker": F.coalesce("ticker", F.lit("")), "isin": F.coalesce("isin", F.lit(""))})  # too short rows are malformed, so null is blank here
    sound = F.col("direction").isin(*DIRECTIONS) & F.col("status").isin(*STATUSES)
    for name in REQUIRED:
        sound = sound & F.col(name).isNotNull()
    return rows.filter(sound)


def as_inserts(rows: DataFrame, seq: str, first: int = 1) -> DataFrame:
    """A log's insert table from order rows: one batch each for equal values of column seq."""
    return rows.select((F.col(seq) + first).cast("long").alias("seq"), F.col("timestamp").alias("ts"), F.xxhash64("order_id", "status", "timestamp", "amount").alias("rid"), *[c for c in rows.columns if c not in ("timestamp", seq)])


@dataclass(frozen=True)
class Market:
    """How synthetic events are drawn. mean_gap: nanoseconds between events, exponential; late_share of them are stamped up to `late` nanoseconds earlier. An order has a number of fills that is geometric with fill_mean, the last of them complete. Prices walk: a ticker's price starts between low and high and moves by steps of `step` of it, one for each `pace` events."""

    tickers: int = 64
    mean_gap: float = 40_000.0
    late_share: float = 0.05
    late: int = 250_000
    fill_mean: float = 2.0
    most_fills: int = 8
    lots: int = 100
    most_lots: int = 90
    low: float = 20.0
    high: float = 400.0
    step: float = 0.002
    pace: int = 1 << 12
    half_spread: float = 0.0008
    fee: float = 0.0003


def uniform(seed: int, what: str, *columns: str) -> Column:
    """From above 0 to below 1, hashed from a label and columns, so that any task that is run again draws the same."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}|{what}"), *columns), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)


def _running(rows: DataFrame, value: str, out: str, chunk: int = 1 << 16) -> DataFrame:
    """rows (id, ..) with the sum of value up to and with each id: within chunks of ids, and over the sums of chunks, which are few."""
    placed = rows.withColumn("__chunk", F.floor(F.col("id") / chunk))
    sums = placed.groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    before = sums.select("__chunk", (F.sum("__sum").over(Window.orderBy("__chunk")) - F.col("__sum")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__chunk").orderBy("id"))
    return placed.join(before, "__chunk").withColumn(out, F.col("__before") + inside).drop("__chunk", "__before")


def prices(spark: SparkSession, n: int, seed: int, market: Market) -> DataFrame:
    """(ticker_no, tick, price): each ticker's walk, a price for each `pace` events."""
    ticks = spark.range(n // market.pace + 1).select(F.col("id").alias("tick"))
    grid = ticks.crossJoin(F.broadcast(spark.range(market.tickers).select(F.col("id").alias("ticker_no"))))
    moves = grid.withColumn("move", F.when(F.col("tick") > 0, F.when(uniform(seed, "move", "ticker_no", "tick") < 0.5, -1).otherwise(1)).otherwise(0))
    steps = F.sum("move").over(Window.partitionBy("ticker_no").orderBy("tick"))
    start = market.low + uniform(seed, "start", "ticker_no") * (market.high - market.low)
    return moves.select("ticker_no", "tick", (start * F.pow(F.lit(1 + market.step), steps)).alias("price"))


def synthetic(spark: SparkSession, n: int, seed: int = 0, market: Market = Market()) -> DataFrame:
    """n events with arrival numbers (id), of orders that are opened, partly filled and filled in turn."""
    u = lambda what, *c: uniform(seed, what, *(c or ("id",)))
    # Fills of order k: geometric. n orders have n events at least; the events of an order follow one another.
    fills = F.least(F.lit(market.most_fills), (1 + F.floor(F.log(u("fills")) / math.log(1 - 1 / market.fill_mean))).cast("int")) if market.fill_mean > 1 else F.lit(1)
    orders = _running(spark.range(n // 2 + 1).withColumn("events", (fills + 1).cast("long")), "events", "upto").withColumnRenamed("id", "order_id")
    events = orders.select("order_id", "upto", "events", F.explode(F.sequence(F.lit(0).cast("long"), F.col("events") - 1)).alias("step"))
    events = events.select("order_id", "step", (F.col("step") == F.col("events") - 1).alias("last"), (F.col("upto") - F.col("events") + F.col("step")).alias("id")).filter(F.col("id") < n)
    timed = _running(events.withColumn("gap", F.greatest(F.lit(1), F.floor(-F.log(u("gap")) * market.mean_gap)).cast("long")), "gap", "at")
    late = F.when(u("late") < market.late_share, F.floor(u("back") * market.late).cast("long")).otherwise(0)
    placed = timed.withColumns({"ticker_no": F.floor(u("ticker", "order_id") * market.tickers).cast("long"), "tick": F.floor(F.col("id") / market.pace).cast("long")})
    priced = placed.join(prices(spark, n, seed, market), ["ticker_no", "tick"])
    return (
        priced.withColumns({
            "timestamp": F.lit(START_NS) + F.col("at") - late, "ticker": F.format_string("SYM%03d", "ticker_no"), "isin": F.format_string("XS%09d0", "ticker_no"),
            "direction": F.when(u("direction", "order_id") < 0.5, "BUY").otherwise("SELL"),
            "status": F.when(F.col("step") == 0, "OPEN").when(F.col("last"), "FILLED").otherwise("PARTIAL"),
            "amount": ((1 + F.floor(u("lots") * market.most_lots)) * market.lots).cast("long"),
        })
        .withColumns({
            "ask_price": F.round(F.col("price") * (1 + market.half_spread), 4), "bid_price": F.when(F.col("step") > 0, F.round(F.col("price") * (1 - market.half_spread), 4)),
            "commission": F.when(F.col("step") > 0, F.round(F.col("amount") * F.col("price") * market.fee, 4)).otherwise(0.0),
        })
        .select("id", "timestamp", "ticker", "isin", "direction", "status", "amount", "ask_price", "bid_price", "order_id", "commission")
    )


def rolling(rows: DataFrame, cycles: int, ts: str = "timestamp") -> DataFrame:
    """rows again and again, each cycle's timestamps behind those of the one before, with column cycle."""
    bounds = rows.agg(F.min(ts), F.max(ts)).head()
    span = 0 if bounds[0] is None else bounds[1] - bounds[0] + 1
    return rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn(ts, F.col(ts) + F.col("cycle") * F.lit(span))


def mixed(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of two sources, with column src."""
    return a.withColumn("src", F.lit(names[0])).unionByName(b.withColumn("src", F.lit(names[1])), allowMissingColumns=True)


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes rows as files of json (one object a line), csv (with a header) or parquet."""
    writer = rows.write.mode("overwrite")
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[kind](path)
