import pytest
from pyspark.sql import functions as F

from ebbmark.functions.scalar import LEAST, MOST
from ebbmark.operators import physical, retention, scans, skyline
from ebbmark.operators.visibility import by_buckets, by_range_join, covered, visible

import oracle


def frames(spark, inserts, deletes):
    return spark.createDataFrame(inserts, "seq long, ts long, rid long"), spark.createDataFrame(deletes, "seq long, t1 long, t2 long")


def rows(df):
    return sorted((r["seq"], r["ts"], r["rid"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_both_plans_follow_the_rule(spark, seed):
    inserts, deletes = oracle.random_ops(seed)
    i, d = frames(spark, inserts, deletes)
    want = oracle.visible(inserts, deletes)
    assert rows(visible(i, d, few=10**6)) == want
    assert rows(visible(i, d, few=0)) == want
    assert rows(visible(i, d, snapshot=200)) == oracle.visible(inserts, deletes, 200)
    assert rows(covered(i, d, few=0)) == sorted(set(inserts) - set(want))
    assert rows(visible(i, d, -300, 400)) == [r for r in want if -300 <= r[1] < 400]


@pytest.mark.parametrize("inserts, deletes, want", [
    ([(1, 100, 1), (3, 100, 2)], [(2, 100, 200)], [2]),  # insert again after a delete
    ([(2, 100, 1)], [(2, 50, 200)], [1]),  # equal numbers keep the row
    ([(5, 100, 1)], [(2, 50, 200)], [1]),  # a delete from before hides nothing
    ([(1, 7, 1), (1, 7, 2), (2, 7, 3)], [], [1, 2, 3]),  # equal timestamps stay
    ([(1, MOST, 1), (1, LEAST, 2)], [(2, LEAST, MOST)], [1]),  # no range with an end holds the largest
    ([(1, MOST, 1)], [(2, 0, None)], []),
])
def test_small_cases(spark, inserts, deletes, want):
    i, d = frames(spark, inserts, deletes)
    for few in (0, 100):
        assert sorted(r["rid"] for r in visible(i, d, few=few).collect()) == want


def test_ranges_at_the_ends(spark):
    i, d = frames(spark, [(1, LEAST, 1), (1, 0, 2), (1, MOST, 3)], [])
    ids = lambda df: sorted(r["rid"] for r in df.collect())
    assert ids(visible(i, d, LEAST, None)) == [1, 2, 3]
    assert ids(visible(i, d, None, MOST)) == [1, 2]
    assert ids(visible(i, d, MOST, None)) == [3]
    assert ids(scans.at(i, MOST)) == [3]
    assert scans.next_ts(i, MOST).head()[0] is None and scans.prev_ts(i, MOST).head()[0] == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    i, d = frames(spark, [(k, k, k) for k in range(100)], [(1000, 10, 20)])
    i.write.parquet(f"{tmp_path}/x")
    df = visible(spark.read.parquet(f"{tmp_path}/x"), d, 5, 50)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,5)" in plan and "LessThan(ts,50)" in plan
    assert df.count() == 35


def naive_steps(deletes):
    points = sorted({p for _, a, b in deletes for p in (a, MOST if b is None else b)})
    out = []
    for a, b in zip(points, points[1:]):
        m = max((s for s, x, y in deletes if x <= a and (y is None or y >= b)), default=None)
        if m is None:
            continue
        if out and out[-1][1] == a and out[-1][2] == m:
            out[-1] = (out[-1][0], b, m)
        else:
            out.append((a, b, m))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_skyline(spark, seed):
    _, deletes = oracle.random_ops(seed, 300)
    d = spark.createDataFrame(deletes, "seq long, t1 long, t2 long")
    got = sorted((r["start"], MOST if r["end"] is None else r["end"], r["max_seq"]) for r in skyline.skyline(d, 16).collect())
    assert got == naive_steps(deletes)
    assert physical.check_steps(skyline.skyline(d, 16)).isEmpty()


def test_skyline_of_nothing_and_of_everything(spark):
    none = spark.createDataFrame([], "seq long, t1 long, t2 long")
    assert skyline.skyline(none).collect() == []
    assert skyline.covered_span(skyline.skyline(none)).head()[0] == 0
    all_ = spark.createDataFrame([(4, LEAST, None)], "seq long, t1 long, t2 long")
    assert [tuple(r) for r in skyline.skyline(all_).collect()] == [(LEAST, None, 4)]
    assert skyline.covered_span(skyline.skyline(all_)).head()[0] == MOST


def test_debt_is_the_naive_one(spark):
    deletes = [(k, 7 * k, 7 * k + 3 + k % 4) for k in range(1, 40)]
    d = spark.createDataFrame(deletes, "seq long, t1 long, t2 long")
    hit = {t for _, a, b in deletes for t in range(a, b)}
    want = max(sum(1 for t in range(w * 20, w * 20 + 20) if t in hit) / 20 for w in range(20))
    assert physical.delete_debt(d, 20).head()[0] == pytest.approx(want)
    assert physical.delete_debt(spark.createDataFrame([(1, 0, None)], "seq long, t1 long, t2 long"), 20).head()[0] == 1.0
    assert physical.delete_debt(spark.createDataFrame([(1, 0, 10**9)], "seq long, t1 long, t2 long"), 20).head()[0] == 1.0


def test_many_rows_of_one_bucket(spark):
    i = spark.range(3000).select((F.col("id") + 1).alias("seq"), F.lit(5).cast("long").alias("ts"), F.col("id").alias("rid"))
    d = retention.delete_rows(spark, [(0, 10, 1500)])
    assert by_buckets(i, d, 3, 5, 5).count() == by_range_join(i, d).count() == 1501


def test_bad_and_empty_ranges(spark):
    with pytest.raises(ValueError):
        retention.delete_rows(spark, [(5, 4, 1)])
    assert retention.delete_rows(spark, [(5, 5, 1)]).count() == 0


def test_prefix_deletes_make_few_pieces(spark):
    """Pieces grow with the deletes, not with the buckets that each covers."""
    from ebbmark.operators.visibility import pieces

    for n in (50, 200, 400):
        deletes = spark.createDataFrame([(k, -(2**63), 1000 * k + 500) for k in range(n)], "seq long, t1 long, t2 long")
        assert pieces(deletes, 250, 0, 1000 * n).count() <= 4 * n + 2 * n + 2
