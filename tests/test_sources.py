import collections
import itertools
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ebbmark.functions import scalar
from ebbmark.functions.scalar import LEAST, MOST
from ebbmark.operators import analytics, scans
from ebbmark.sources import orders


def test_synthetic_is_seeded_and_out_of_order(spark):
    market = orders.Market(late_share=0.2)
    a = orders.synthetic(spark, 3000, 1, market).collect()
    assert sorted(a) == sorted(orders.synthetic(spark, 3000, 1, market).collect()) != sorted(orders.synthetic(spark, 3000, 2, market).collect())
    assert sorted(r["id"] for r in a) == list(range(3000))
    late = analytics.disorder(spark.createDataFrame(a).select("id", F.col("timestamp").alias("ts")), "id", 500).head()
    assert 300 < late["adjacent"] <= late["overall"] < 1500
    by = collections.defaultdict(list)
    for r in sorted(a, key=lambda r: r["id"]):
        by[r["order_id"]].append(r)
    whole = [rows for k, rows in by.items() if k < max(by)]
    assert all([r["status"] for r in rows] == ["OPEN"] + ["PARTIAL"] * (len(rows) - 2) + ["FILLED"] for rows in whole) and {len(rows) for rows in whole} >= {2, 3, 4}
    assert all(r["bid_price"] is None if r["status"] == "OPEN" else r["bid_price"] < r["ask_price"] for r in a)


def test_prices_walk(spark):
    market = orders.Market(tickers=3, pace=10)
    walk = orders.prices(spark, 1000, 5, market).orderBy("ticker_no", "tick").collect()
    assert len(walk) == 3 * 101
    for x, y in itertools.pairwise(walk):
        if x["ticker_no"] == y["ticker_no"]:
            assert abs(abs(math.log(y["price"] / x["price"])) - math.log(1 + market.step)) < 1e-9


def test_csv(spark, tmp_path):
    rows = orders.synthetic(spark, 30).drop("id")
    orders.export(rows.select([c.split()[0] for c in orders.SCHEMA.split(", ")]), f"{tmp_path}/good", "csv")
    assert orders.read_csv(spark, f"{tmp_path}/good").count() == 30
    lines = [
        "timestamp,ticker,isin,direction,status,amount,ask_price,bid_price,order_id,commission", "1,T,X,BUY,OPEN,10,1.5,,1,0", "x,T,X,BUY,OPEN,10,1.5,,2,0", "1,T,X,HOLD,OPEN,10,1.5,,3,0",
        "1,T,X,SELL,OPEN,-5,-1.5,-2,4,-1", "1,T,X,SELL,OPEN,1,1.5,,5,", "1,T,X,SELL,OPEN,1,1.5,,6", "1,T,X,SELL,GONE,1,1.5,,7,0", "1,,,SELL,FILLED,1,1.5,,8,0", "1,T,X,SELL,FILLED,1,1.5,,9,0,more", "1,T,X,SELL,FILLED,1.5,1.5,,10,0",
    ]
    (tmp_path / "bad.csv").write_text("\n".join(lines) + "\n")
    got = {r["order_id"]: r for r in orders.read_csv(spark, f"{tmp_path}/bad.csv").collect()}
    assert sorted(got) == [1, 4, 8] and got[1]["bid_price"] is None and got[4]["amount"] == -5 and got[8]["ticker"] == ""


def test_rolling_and_mixed(spark):
    a = spark.createDataFrame([(1,), (3,)], "timestamp long")
    assert sorted(r[0] for r in orders.rolling(a, 3).select("timestamp").collect()) == [1, 3, 4, 6, 7, 9]
    assert orders.mixed(a, a.withColumn("x", F.lit(1))).groupBy("src").count().count() == 2


def test_floor_division_at_the_ends(spark):
    values = [LEAST, LEAST + 1, -8, -7, -1, 0, 1, 6, 7, MOST - 1, MOST]
    for b in (1, 7, 3_600_000, MOST):
        df = spark.createDataFrame([(v,) for v in values], "x long").select("x", scalar.floor_div("x", b).alias("q"))
        assert all(r["q"] == r["x"] // b for r in df.collect())


def test_windows_at_the_ends(spark):
    df = spark.createDataFrame([(MOST // 10,), (LEAST // 10,)], "w long").select(scalar.window_start("w", 10).alias("a"), scalar.window_end("w", 10).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(MOST // 10 * 10, None), (LEAST, LEAST // 10 * 10 + 10)]
    with pytest.raises(Exception, match="overflow"):
        spark.createDataFrame([(LEAST,)], "ts long").select(scalar.window_id("ts", 10, 5)).collect()


def test_vwap_falls_back_to_ask(spark):
    rows = spark.createDataFrame([(None, 10.0, 1), (0.0, 20.0, 1), (40.0, 1.0, 2)], "bid double, ask double, amount long")
    assert analytics.vwap(rows, F.lit(True), F.col("bid"), F.col("ask"), F.col("amount")).head()["vwap"] == (10 + 20 + 80) / 4
    assert analytics.spread(rows, F.col("bid"), F.col("ask")).head()["largest"] == 20.0
    empty = rows.limit(0)
    assert analytics.vwap(empty, F.lit(True), F.col("bid"), F.col("ask"), F.col("amount")).head()["vwap"] == 0.0
    assert analytics.ratio(rows, F.lit(True)).head()["ratio"] == float("inf")


def test_quantile_truncates(spark):
    values = spark.createDataFrame([(x,) for x in (10.0, 20.0, 30.0)], "v double")
    assert {r["percent"]: r["value"] for r in analytics.quantile(values, "v", (0.0, 50.0, 95.0, 100.0)).collect()} == {0.0: 10.0, 50.0: 20.0, 95.0: 20.0, 100.0: 30.0}


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sample_stats_moves_counts_not_values(spark):
    rows = spark.range(1_000_000).select((F.xxhash64("id") % 50_000_000 / 100).alias("v"))
    before = shuffled(spark)
    got = analytics.sample_stats(rows, "v").head()
    assert shuffled(spark) - before < 8e6  # of values, 27 MB were
    want = rows.agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.95).alias("p")).head()
    assert (got["median"], got["p95"]) == tuple(want)
    assert got["mad"] == rows.agg(F.percentile(F.abs(F.col("v") - want["m"]), 0.5)).head()[0]


def test_sample_stats_without_values(spark):
    rows = spark.createDataFrame([(None,), (None,)], "v double")
    assert [tuple(r) for r in analytics.sample_stats(rows, "v").collect()] == [(None, None, None)]
    assert [tuple(r) for r in analytics.sample_stats(rows.limit(0), "v").collect()] == [(None, None, None)]


@pytest.mark.parametrize("kind", ["double", "long", "decimal(20,3)"])
def test_interpolated_percentiles_of_odd_values(spark, monkeypatch, kind):
    monkeypatch.setattr(analytics, "CUTS", 32)
    big = 1.7976931348623157e308
    if kind == "double":
        near = [2.0**k * (1 + d * 2**-52) for k in (-3, 0, 10) for d in range(-2, 40)]
        values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, big, -big, *near, *[-x for x in near], *[7.25] * 50]
    else:
        values = [None, 0, *range(-9, 60), *range(2**53 - 40, 2**53 + 40), *[-(2**45)] * 40]
        values = values if kind == "long" else [None if v is None else Decimal(v) / 1000 for v in values]
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    shares = (0.0, 0.001, 0.25, 0.5, 0.613, 0.95, 0.99, 1.0)
    want = rows.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).head()[0]
    assert repr(analytics.interpolated(rows, F.col("v"), shares)) == repr(want)


def test_every_nth(spark):
    rows = spark.range(10).select(F.col("id").alias("ts"), F.col("id").alias("seq"), F.col("id").alias("rid"))
    assert [r["ts"] for r in scans.every_nth(rows, 3, 3).collect()] == [0, 3, 6]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
