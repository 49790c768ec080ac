"""Queries over the driver's tables, by name, and SQL that gives the same rows.

`events` is a log in which arrival is permuted: event e is the insert with sequence number 2 * (e * 7919 % n + 1), n being
the number of events, and DELETES are odd numbers between. `orders` is one with many rows of equal timestamps.
Timestamps are microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import LEAST, MOST, floor_div, micros
from ..operators import adaptive, analytics, physical, retention, scans, skyline
from ..operators.visibility import by_buckets, covered, visible

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
START = 1_704_067_200_000_000  # 2024-01-01
#: (t1, t2, share of all calls before it): a range, a range that is hit again, a prefix, a single day late, and one that is all but open.
DELETES = [(START + 2 * DAY, START + 4 * DAY, 0.5), (START + 3 * DAY, START + 6 * DAY, 0.25), (LEAST, START + DAY, 0.9), (START + 20 * DAY, START + 21 * DAY, 1.0), (START + 27 * DAY, MOST, 0.1)]
#: For orders: a delete of a day every few weeks, many of them, early and late ones in turn.
DAYS_1992 = 694_224_000_000_000  # 1992-01-01
MANY = [(DAYS_1992 + k * 17 * DAY, DAYS_1992 + (k * 17 + 1 + k % 5) * DAY, (k % 7) / 6) for k in range(140)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, t1: int | None = None, t2: int | None = None) -> DataFrame:
    """Rows with t1 <= ts < t2. The bounds are also filters on the stored column, as Parquet can't skip by a computed one."""
    e = table(spark, sf_dir, "events")
    n = e.count()
    e = e.filter(f"ts >= {scalar.ntz(t1)}") if t1 is not None else e
    e = e.filter(f"ts < {scalar.ntz(t2)}") if t2 is not None else e
    return e.select((2 * (F.col("event_id") * 7919 % n + 1)).alias("seq"), micros("ts").alias("ts"), F.col("event_id").alias("rid"), "user_id", "event_type", "value")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = o.count()
    return o.select((2 * (F.col("o_orderkey") * 7919 % n + 1)).alias("seq"), micros("o_orderdate").alias("ts"), F.col("o_orderkey").alias("rid"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), micros("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rid"), "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def deletes(spark: SparkSession, rows: DataFrame, ranges=DELETES) -> DataFrame:
    n = rows.count()
    return retention.delete_rows(spark, [(a, b, 2 * int(n * share) + 1) for a, b, share in ranges])


EVENTS = "SELECT 2 * (event_id * 7919 % (SELECT count(*) FROM events) + 1) AS seq, epoch_us(ts) AS ts, event_id AS rid, user_id, event_type, value FROM events"
ORDERS = "SELECT 2 * (o_orderkey * 7919 % (SELECT count(*) FROM orders) + 1) AS seq, epoch_us(o_orderdate) AS ts, o_orderkey AS rid, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders"
LINES = "SELECT l_orderkey * 8 + l_linenumber AS seq, epoch_us(l_shipdate) AS ts, l_orderkey * 8 + l_linenumber AS rid, l_orderkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem"


def deletes_sql(name: str, ranges=DELETES) -> str:
    values = ", ".join(f"({a if a > LEAST else '(-9223372036854775808)'}::BIGINT, {b}::BIGINT, {share!r}::DOUBLE)" for a, b, share in ranges)
    return f"SELECT t1, t2, 2 * CAST(floor((SELECT count(*) FROM {name}) * share) AS BIGINT) + 1 AS seq FROM (VALUES {values}) d(t1, t2, share)"


def with_log(body: str, log: str = EVENTS, ranges=DELETES, snapshot: str | None = None) -> str:
    """body over l (all inserts), d (deletes) and v (visible rows)."""
    name = {EVENTS: "events", ORDERS: "orders", LINES: "lineitem"}[log]
    upto = f" WHERE seq <= {snapshot}" if snapshot else ""
    return f"WITH l AS (SELECT * FROM ({log}) x{upto}), d AS (SELECT * FROM ({deletes_sql(name, ranges)}) x{upto}), v AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE l.ts >= d.t1 AND l.ts < d.t2 AND d.seq > l.seq)) {body}"


def view(spark: SparkSession, sf_dir: str, t1=None, t2=None, snapshot=None) -> DataFrame:
    return visible(events_log(spark, sf_dir, t1, t2), deletes(spark, table(spark, sf_dir, "events")), t1, t2, snapshot)


# Scans

A, B = START + 3 * DAY + 5, START + 22 * DAY + 7


@query(with_log(f"SELECT ts, seq, rid, value FROM v WHERE ts >= {A} AND ts < {B}"))
def range_visible(spark, sf_dir):
    return scans.ordered(view(spark, sf_dir, A, B).select("ts", "seq", "rid", "value"))


@query(with_log(f"SELECT ts, rid FROM v WHERE ts >= {B}"))
def since_visible(spark, sf_dir):
    return view(spark, sf_dir, B).select("ts", "rid")


@query(with_log(f"SELECT ts, rid FROM v WHERE ts < {A}"))
def until_visible(spark, sf_dir):
    return view(spark, sf_dir, None, A).select("ts", "rid")


@query(with_log("SELECT ts, seq, rid FROM v"))
def all_visible(spark, sf_dir):
    return view(spark, sf_dir).select("ts", "seq", "rid")


@query(with_log("SELECT ts, rid, event_type FROM v WHERE ts = (SELECT max(ts) FROM v WHERE ts < 1705000000000000)"))
def point_equal(spark, sf_dir):
    rows = view(spark, sf_dir)
    ts = scans.prev_ts(rows, 1_705_000_000_000_000).head()[0]
    return scans.at(rows, ts).select("ts", "rid", "event_type")


@query(with_log("SELECT ts, rid, o_custkey FROM v WHERE ts = 852076800000000", ORDERS, MANY))
def point_many_rows(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return scans.at(visible(rows, deletes(spark, rows, MANY), 852_076_800_000_000), 852_076_800_000_000).select("ts", "rid", "o_custkey")


@query(with_log("SELECT ts, rid FROM v WHERE ts IN (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts, seq, rid) - 1 AS k FROM v) WHERE k % 100 = 0 AND k <= 99900)"))
def point_batch(spark, sf_dir):
    rows = view(spark, sf_dir)
    return scans.at_each(rows, scans.every_nth(rows, 100, 1000)).select("ts", "rid")


@query(with_log(f"SELECT ts, rid, value FROM v WHERE ts >= {A} AND ts < {B} AND event_type = (SELECT min(event_type) FROM events) AND value > 50"))
def range_payload_filter(spark, sf_dir):
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).head()[0]
    return view(spark, sf_dir, A, B).filter((F.col("event_type") == kind) & (F.col("value") > 50)).select("ts", "rid", "value")


@query(with_log("SELECT ts, rid FROM v ORDER BY ts, seq, rid LIMIT 100"))
def early_stop(spark, sf_dir):
    return scans.first(view(spark, sf_dir), 100).select("ts", "rid")


@query(with_log(f"SELECT ts, rid FROM (SELECT *, row_number() OVER (ORDER BY ts, seq, rid) AS k FROM v WHERE ts >= {A}) WHERE k > 1000 AND k <= 2000"))
def next_batch(spark, sf_dir):
    from pyspark.sql import Window

    head = scans.first(view(spark, sf_dir, A), 2000)
    return head.withColumn("k", F.row_number().over(Window.orderBy("ts", "seq", "rid"))).filter("k > 1000").select("ts", "rid")


@query(f"SELECT ts, rid FROM ({EVENTS}) WHERE ts >= 5 AND ts < 5")
def range_empty(spark, sf_dir):
    return view(spark, sf_dir, 5, 5).select("ts", "rid")


@query(with_log("SELECT ts, rid, 'events' AS src FROM v UNION ALL SELECT epoch_us(o_orderdate), o_orderkey, 'orders' FROM orders"))
def merge_sources(spark, sf_dir):
    a = view(spark, sf_dir).select("ts", "rid", F.lit("events").alias("src"))
    return scans.union_all(a, orders_log(spark, sf_dir).select("ts", "rid", F.lit("orders").alias("src")))


# Visibility


@query(with_log("SELECT ts, rid, o_custkey FROM v", ORDERS, MANY))
def visible_many_deletes(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return visible(rows, deletes(spark, rows, MANY)).select("ts", "rid", "o_custkey")


@query(with_log("SELECT ts, rid FROM v", ORDERS, MANY))
def visible_bucketed(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    least, most = rows.agg(F.min("ts"), F.max("ts")).head()
    return by_buckets(rows, deletes(spark, rows, MANY), 30 * DAY, least, most).select("ts", "rid")


@query(with_log("SELECT ts, rid, seq FROM v", snapshot="(SELECT count(*) FROM events)"))
def snapshot_read(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return visible(rows, deletes(spark, rows), snapshot=rows.count()).select("ts", "rid", "seq")


@query(with_log("SELECT ts, rid, seq FROM l WHERE EXISTS (SELECT 1 FROM d WHERE l.ts >= d.t1 AND l.ts < d.t2 AND d.seq > l.seq)"))
def covered_rows(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return covered(rows, deletes(spark, rows)).select("ts", "rid", "seq")


@query(
    f"""WITH l AS ({EVENTS}), r AS (SELECT ts, seq, rid FROM l UNION ALL SELECT ts, 4 * (SELECT count(*) FROM events) + 2, rid + 1000000000 FROM l WHERE ts >= {START + 10 * DAY} AND ts < {START + 11 * DAY} AND rid % 2 = 0)
    SELECT ts, seq, rid FROM r WHERE NOT (ts >= {START + 9 * DAY} AND ts < {START + 12 * DAY} AND 4 * (SELECT count(*) FROM events) + 1 > seq)"""
)
def reinsert_after_delete(spark, sf_dir):
    rows = events_log(spark, sf_dir).select("ts", "seq", "rid")
    n = rows.count()
    again = rows.filter((F.col("ts") >= START + 10 * DAY) & (F.col("ts") < START + 11 * DAY) & (F.col("rid") % 2 == 0)).select("ts", F.lit(4 * n + 2).cast("long").alias("seq"), (F.col("rid") + 1_000_000_000).alias("rid"))
    return visible(scans.union_all(rows, again), retention.delete_rows(spark, [(START + 9 * DAY, START + 12 * DAY, 4 * n + 1)]))


@query(with_log("SELECT ts, seq, rid FROM l EXCEPT ALL SELECT ts, seq, rid FROM v"))
def multiset_difference(spark, sf_dir):
    return scans.difference(events_log(spark, sf_dir).select("ts", "seq", "rid"), view(spark, sf_dir).select("ts", "seq", "rid"))


# Deletes


def deleted(ranges: list[tuple[int, int]]):
    """A query for inserts after which the ranges are deleted, and its SQL."""

    def run(spark, sf_dir):
        rows = events_log(spark, sf_dir)
        return visible(rows, retention.delete_rows(spark, [(a, b, MOST - 9 + k) for k, (a, b) in enumerate(ranges)])).select("ts", "rid")

    return run, f"SELECT ts, rid FROM ({EVENTS}) l WHERE NOT (" + " OR ".join(f"(ts >= ({a}) AND ts < {b})".replace(f"({LEAST})", "(-9223372036854775808)::BIGINT") for a, b in ranges) + ")"


EXACT = 1_704_067_207_179_575
for _name, _ranges in {
    "delete_range": [(A, A + 2 * DAY)], "delete_before": [(LEAST, A)], "delete_point": [(EXACT, EXACT + 1)], "delete_from": [(B, MOST)], "delete_everything": [(LEAST, MOST)], "delete_overlapping": [(A, A + 3 * DAY), (A + DAY, A + 5 * DAY)],
}.items():
    QUERIES[_name], ORACLES[_name] = deleted(_ranges)


@query(f"WITH l AS ({EVENTS}) SELECT ts, rid FROM l WHERE ts >= (SELECT max(ts) FROM l) - {7 * DAY}")
def retention_by_age(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return visible(rows, retention.delete_rows(spark, [(LEAST, retention.age_cutoff(rows, 7 * DAY), MOST)])).select("ts", "rid")


BATCHED = f"SELECT ts, rid, rid // 500 AS batch FROM ({EVENTS})"


@query(
    f"""WITH b AS (SELECT batch, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM ({BATCHED}) GROUP BY batch), k AS (SELECT *, sum(n) OVER (ORDER BY batch DESC) AS kept FROM b)
    SELECT batch, first_ts, last_ts, n FROM k WHERE kept > 2000"""
)
def retention_by_count(spark, sf_dir):
    return retention.oldest_batches(events_log(spark, sf_dir).withColumn("batch", floor_div("rid", 500)), 2000, "batch")


@query(with_log("SELECT (SELECT count(*) FROM l) AS before, (SELECT count(*) FROM v) AS after"))
def counts_before_after(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return scans.count(rows).withColumnRenamed("n", "before").join(F.broadcast(scans.count(visible(rows, deletes(spark, rows))).withColumnRenamed("n", "after")))


# Counts and neighbours


@query(with_log("SELECT count(*) AS n FROM v"))
def count_all(spark, sf_dir):
    return scans.count(view(spark, sf_dir))


@query(with_log(f"SELECT count(*) AS n FROM v WHERE ts >= {A} AND ts < {B}"))
def count_range(spark, sf_dir):
    return scans.count(view(spark, sf_dir, A, B))


@query(with_log("SELECT min(ts) AS least, max(ts) AS largest FROM v"))
def bounds(spark, sf_dir):
    return view(spark, sf_dir).agg(F.min("ts").alias("least"), F.max("ts").alias("largest"))


@query(with_log(f"SELECT min(ts) AS ts FROM v WHERE ts > {A}"))
def next_timestamp(spark, sf_dir):
    return scans.next_ts(view(spark, sf_dir), A)


@query(with_log(f"SELECT max(ts) AS ts FROM v WHERE ts < {A}"))
def prev_timestamp(spark, sf_dir):
    return scans.prev_ts(view(spark, sf_dir), A)


@query(with_log("SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT ts FROM v)", ORDERS, MANY))
def neighbours(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return scans.neighbours(visible(rows, deletes(spark, rows, MANY)))


# Delete intervals as steps

STEPS = """
    e AS (SELECT DISTINCT p FROM (SELECT t1 AS p FROM d UNION ALL SELECT t2 FROM d)), s AS (SELECT p AS a, lead(p) OVER (ORDER BY p) AS b FROM e),
    h AS (SELECT a, b, (SELECT max(seq) FROM d WHERE d.t1 <= a AND d.t2 >= b) AS m FROM s WHERE b IS NOT NULL),
    g AS (SELECT *, CASE WHEN lag(b) OVER (ORDER BY a) = a AND lag(m) OVER (ORDER BY a) = m THEN 0 ELSE 1 END AS new FROM h WHERE m IS NOT NULL),
    r AS (SELECT *, sum(new) OVER (ORDER BY a) AS run FROM g), steps AS (SELECT min(a) AS start, max(b) AS "end", max(m) AS max_seq FROM r GROUP BY run)"""


def steps_sql(body: str, name: str = "orders", ranges=MANY) -> str:
    return f"WITH d AS ({deletes_sql(name, ranges)}), {STEPS} {body}"


def orders_steps(spark, sf_dir) -> DataFrame:
    return skyline.skyline(deletes(spark, orders_log(spark, sf_dir), MANY + NESTED))


#: Long ranges over and under those of MANY.
NESTED = [(DAYS_1992 + 100 * DAY, DAYS_1992 + 900 * DAY, 0.4), (DAYS_1992 + 700 * DAY, DAYS_1992 + 1500 * DAY, 0.6), (LEAST, DAYS_1992 + 20 * DAY, 0.1)]


@query(steps_sql('SELECT start, "end", max_seq FROM steps', ranges=MANY + NESTED))
def interval_steps(spark, sf_dir):
    return orders_steps(spark, sf_dir)


@query(steps_sql('SELECT start, "end", max_seq FROM steps', ranges=MANY + NESTED))
def interval_union(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return skyline.union(skyline.skyline(deletes(spark, rows, MANY)), skyline.skyline(deletes(spark, rows, NESTED)))


CLIP = (DAYS_1992 + 333 * DAY, DAYS_1992 + 1333 * DAY)


@query(steps_sql(f'SELECT greatest(start, {CLIP[0]}) AS start, least("end", {CLIP[1]}) AS "end", max_seq FROM steps WHERE greatest(start, {CLIP[0]}) < least("end", {CLIP[1]})', ranges=MANY + NESTED))
def interval_clip(spark, sf_dir):
    return skyline.clip(orders_steps(spark, sf_dir), *CLIP)


@query(steps_sql('SELECT DISTINCT epoch_us(o_orderdate) AS ts, max_seq FROM orders LEFT JOIN steps ON epoch_us(o_orderdate) >= start AND epoch_us(o_orderdate) < "end"', ranges=MANY + NESTED))
def interval_lookup(spark, sf_dir):
    return skyline.lookup(orders_steps(spark, sf_dir), orders_log(spark, sf_dir).select("ts").distinct())


@query(f"WITH d AS ({deletes_sql('orders', MANY + NESTED)}) SELECT max(seq) AS max_seq FROM d WHERE t1 <= {CLIP[0]} AND t2 > {CLIP[0]}")
def interval_max_at(spark, sf_dir):
    return skyline.max_seq_at(deletes(spark, orders_log(spark, sf_dir), MANY + NESTED), CLIP[0])


@query(steps_sql('SELECT sum("end" - start)::BIGINT AS covered FROM steps'))
def interval_span(spark, sf_dir):
    return skyline.covered_span(skyline.skyline(deletes(spark, orders_log(spark, sf_dir), MANY)))


# Files

WINDOW, ORIGIN = 36 * HOUR, 12_345


@query(f"SELECT rid, CAST(floor((ts - {ORIGIN})::DECIMAL(38,0) / {WINDOW}) AS BIGINT) AS window_id FROM ({EVENTS})")
def window_ids(spark, sf_dir):
    return physical.with_window(events_log(spark, sf_dir), WINDOW, ORIGIN).select("rid", "window_id")


@query(
    """SELECT x, CAST((x::HUGEINT - ((x::HUGEINT % 7 + 7) % 7)) // 7 AS BIGINT) AS q
    FROM (SELECT k AS x FROM range(-30, 31) r(k) UNION ALL SELECT (-9223372036854775808)::BIGINT + k FROM range(0, 10) r(k) UNION ALL SELECT 9223372036854775807::BIGINT - k FROM range(0, 10) r(k))"""
)
def floor_division(spark, sf_dir):
    ends = spark.range(10)
    x = spark.range(-30, 31).unionAll(ends.select(F.lit(LEAST) + F.col("id"))).unionAll(ends.select(F.lit(MOST) - F.col("id"))).toDF("x")
    return x.select("x", floor_div("x", 7).alias("q"))


@query(f"SELECT k AS window_id, k * {WINDOW} + {ORIGIN} AS start, (k + 1) * {WINDOW} + {ORIGIN} AS \"end\" FROM range(-5, 6) r(k)")
def window_bounds(spark, sf_dir):
    return spark.range(-5, 6).select(F.col("id").alias("window_id"), scalar.window_start("id", WINDOW, ORIGIN).alias("start"), scalar.window_end("id", WINDOW, ORIGIN).alias("end"))


@query(with_log(f"SELECT ts, seq, rid, ts // {WINDOW} AS window_id FROM v"))
def compaction_output(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return physical.compacted(rows, deletes(spark, rows), WINDOW).select("ts", "seq", "rid", "window_id")


@query(with_log("SELECT ts, seq, rid FROM l WHERE EXISTS (SELECT 1 FROM d WHERE l.ts >= d.t1 AND l.ts < d.t2 AND d.seq > l.seq)", ORDERS, MANY))
def compaction_dropped(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return physical.dropped(rows, deletes(spark, rows, MANY)).select("ts", "seq", "rid")


LO, HI = DAYS_1992 // (30 * DAY) + 10, DAYS_1992 // (30 * DAY) + 40


@query(
    f"""WITH d AS ({deletes_sql("orders", MANY + NESTED)}) SELECT seq, t1, least(t2, {LO * 30 * DAY}) AS t2 FROM d WHERE t1 < {LO * 30 * DAY} AND t1 < least(t2, {LO * 30 * DAY})
    UNION ALL SELECT seq, greatest(t1, {(HI + 1) * 30 * DAY}), t2 FROM d WHERE t2 > {(HI + 1) * 30 * DAY}"""
)
def compaction_residual(spark, sf_dir):
    return physical.residual(deletes(spark, orders_log(spark, sf_dir), MANY + NESTED), LO, HI, 30 * DAY)


@query(
    steps_sql(
        f"""SELECT round(max(s), 9) AS debt FROM (SELECT w, sum(least("end", (w + 1) * {30 * DAY}) - greatest(start, w * {30 * DAY})) / {30 * DAY} AS s
        FROM steps, range({DAYS_1992 // (30 * DAY)}, {DAYS_1992 // (30 * DAY) + 120}) r(w) WHERE start < (w + 1) * {30 * DAY} AND "end" > w * {30 * DAY} GROUP BY w)"""
    )
)
def delete_debt(spark, sf_dir):
    d = physical.delete_debt(deletes(spark, orders_log(spark, sf_dir), MANY), 30 * DAY)
    return d.select(F.round("debt", 9).alias("debt"))


@query(f"SELECT ts // {WINDOW} AS window_id, count(*) AS rows, min(ts) AS start_ts, max(ts) AS last_ts FROM ({EVENTS}) WHERE ts >= {A} AND ts < {B} GROUP BY 1")
def spans(spark, sf_dir):
    return physical.spans(physical.with_window(events_log(spark, sf_dir), WINDOW), ["window_id"], A, B)


@query(f"SELECT count(*) AS rows, min(ts) AS start_ts, max(ts) AS last_ts FROM ({EVENTS})")
def file_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(micros("ts").alias("ts"), F.col("_metadata.file_path").alias("file"))
    return physical.spans(rows, ["file"]).drop("file")


@query(
    with_log(
        """SELECT (SELECT count(*) FROM l) AS rows, (SELECT count(*) FROM v) AS visible_rows, (SELECT count(*) FROM d) AS deletes, least((SELECT min(ts) FROM l), (SELECT min(t1) FROM d)) AS raw_min_ts,
        greatest((SELECT max(ts) FROM l), (SELECT max(t2) FROM d)) AS raw_max_ts, greatest((SELECT max(seq) FROM l), (SELECT max(seq) FROM d)) AS op_seq"""
    )
)
def layout_stats(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return physical.layout(rows, deletes(spark, rows))


@query(with_log("SELECT (SELECT count(*) FROM l) AS input, (SELECT count(*) FROM v) AS kept, (SELECT count(*) FROM l) - (SELECT count(*) FROM v) AS dropped, true AS sound"))
def compaction_check(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    d = deletes(spark, rows)
    return physical.check_compaction(rows, physical.compacted(rows, d, WINDOW), physical.dropped(rows, d))


@query(f"SELECT ts, rid FROM ({EVENTS}) WHERE rid % 97 = 0")
def window_violations(spark, sf_dir):
    """Every 97th row is put into the window behind its own: exactly those are found."""
    rows = physical.with_window(events_log(spark, sf_dir), WINDOW)
    return physical.check_windows(rows.withColumn("window_id", F.col("window_id") + F.when(F.col("rid") % 97 == 0, 1).otherwise(0)), WINDOW).select("ts", "rid")


@query(
    f"""WITH d AS ({deletes_sql("orders", MANY + NESTED)}) SELECT t1 AS start FROM (SELECT *, lag(t2) OVER (ORDER BY t1) AS b, lag(seq) OVER (ORDER BY t1) AS h FROM d)
    WHERE t1 >= t2 OR b > t1 OR (b = t1 AND h = seq)"""
)
def step_violations(spark, sf_dir):
    """The raw deletes overlap, so they are no step function; their own steps, checked beside them, add nothing."""
    raw = deletes(spark, orders_log(spark, sf_dir), MANY + NESTED).select(F.col("t1").alias("start"), F.col("t2").alias("end"), F.col("seq").alias("max_seq"))
    return physical.check_steps(raw).select("start").unionAll(physical.check_steps(orders_steps(spark, sf_dir)).select("start"))


# Analytics

HEAD = "h AS (SELECT *, (SELECT min(ts) FROM v) AS start FROM v WHERE ts < (SELECT min(ts) FROM v) + {span})"


def head_sql(body: str, span: int, log: str = EVENTS, ranges=DELETES) -> str:
    return with_log(", " + HEAD.format(span=span) + " " + body, log, ranges).replace(") , h AS", "), h AS")


@query(head_sql(f"SELECT k AS bucket, count(ts) AS n, round(sum(count(ts)) OVER () / 10.0, 6) AS average FROM range(10) r(k) LEFT JOIN h ON (ts - start) // {DAY} = k GROUP BY k", 10 * DAY))
def bucket_counts(spark, sf_dir):
    return analytics.bucket_counts(view(spark, sf_dir), DAY, 10).withColumn("average", F.round("average", 6))


@query(head_sql(f"SELECT bucket, n FROM (SELECT k AS bucket, count(ts) AS n FROM range(240) r(k) LEFT JOIN h ON (ts - start) // {HOUR} = k GROUP BY k) QUALIFY n > 1.2 * avg(n) OVER ()", 240 * HOUR))
def spikes(spark, sf_dir):
    return analytics.spikes(view(spark, sf_dir), HOUR, 240, 1.2).select("bucket", "n")


@query(head_sql("SELECT count(*) FILTER (event_type = 'click') AS buys, count(*) FILTER (event_type <> 'click') AS sells, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type <> 'click'), 9) AS ratio FROM h", 10 * DAY))
def buy_sell_ratio(spark, sf_dir):
    rows = analytics.head_window(view(spark, sf_dir), 10 * DAY)
    return analytics.ratio(rows, F.col("event_type") == "click").withColumn("ratio", F.round("ratio", 9))


BID = "CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 0.0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END"
ASK = "CAST(round(l_extendedprice * 101) AS BIGINT)"
PRICED = f"SELECT *, {BID} AS bid, {ASK} AS ask FROM ({LINES})"


def lines_priced(spark, sf_dir) -> DataFrame:
    return lines_log(spark, sf_dir).withColumns({"bid": F.expr(BID), "ask": F.expr(ASK), "amount": F.col("l_quantity").cast("long")})


@query(
    f"""WITH p AS ({PRICED}), h AS (SELECT * FROM p WHERE ts < (SELECT min(ts) FROM p) + {300 * DAY} AND l_linestatus = 'F')
    SELECT sum(l_quantity)::BIGINT AS volume, round(sum(CASE WHEN bid IS NULL OR bid = 0 THEN ask ELSE bid END * l_quantity) / sum(l_quantity), 3) AS vwap FROM h"""
)
def vwap(spark, sf_dir):
    rows = analytics.head_window(lines_priced(spark, sf_dir), 300 * DAY)
    return analytics.vwap(rows, F.col("l_linestatus") == "F", F.col("bid"), F.col("ask"), F.col("amount")).withColumn("vwap", F.round("vwap", 3))


@query(
    f"""WITH l AS ({ORDERS}), h AS (SELECT * FROM l WHERE ts < (SELECT min(ts) FROM l) + {2000 * DAY})
    SELECT count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'O') AS opened, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS partial, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS fill_rate FROM h"""
)
def fill_rate(spark, sf_dir):
    rows = analytics.head_window(orders_log(spark, sf_dir), 2000 * DAY)
    return analytics.shares(rows, F.col("o_orderstatus"), "F", "O").withColumn("fill_rate", F.round("fill_rate", 9))


@query(with_log("SELECT user_id, count(*) AS n FROM v GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5"))
def top_users(spark, sf_dir):
    return analytics.top_counts(view(spark, sf_dir), "user_id", 5)


@query(with_log("SELECT count(DISTINCT user_id) AS n FROM v"))
def distinct_users(spark, sf_dir):
    return view(spark, sf_dir).agg(F.count_distinct("user_id").alias("n"))


@query(f"WITH p AS ({PRICED}) SELECT round(avg(ask - bid), 3) AS average, min(ask - bid)::DOUBLE AS least, max(ask - bid)::DOUBLE AS largest FROM p WHERE bid IS NOT NULL")
def spread(spark, sf_dir):
    return analytics.spread(lines_priced(spark, sf_dir), F.col("bid"), F.col("ask")).withColumn("average", F.round("average", 3))


@query(with_log("SELECT sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM v"))
def commission_sum(spark, sf_dir):
    return view(spark, sf_dir).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(
    f"""WITH g AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap FROM ({LINES})), c AS (SELECT CASE WHEN gap < {HOUR} THEN 0 WHEN gap < {DAY} THEN 1 WHEN gap < {2 * DAY} THEN 2 WHEN gap < {3 * DAY} THEN 3 ELSE 4 END AS bucket, count(*) AS n, sum(gap) AS s FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT k AS bucket, coalesce(n, 0) AS n, round((SELECT sum(s) / sum(n) FROM c), 3) AS mean_gap FROM range(5) r(k) LEFT JOIN c ON k = bucket"""
)
def gap_histogram(spark, sf_dir):
    return analytics.gap_histogram(lines_log(spark, sf_dir), (HOUR, DAY, 2 * DAY, 3 * DAY)).withColumn("mean_gap", F.round("mean_gap", 3))


@query(with_log("SELECT min(ts) AS least, max(ts) AS largest, round(avg(ts - (SELECT min(ts) FROM v)) / 1000000, 3) AS mean_offset, round(stddev_pop(ts - (SELECT min(ts) FROM v)) / 1000000, 3) AS deviation FROM v"))
def describe_timestamps(spark, sf_dir):
    return analytics.describe_ts(view(spark, sf_dir)).withColumns({c: F.round(F.col(c) / 1_000_000, 3) for c in ("mean_offset", "deviation")})


@query(with_log("SELECT round((max(ts) - min(ts)) / (count(*) - 1), 3) AS mean_gap FROM v"))
def mean_gap(spark, sf_dir):
    return analytics.mean_gap(view(spark, sf_dir)).select(F.round("mean_gap", 3).alias("mean_gap"))


@query(
    with_log(
        """, f AS (SELECT user_id AS u, ts AS a FROM v WHERE event_type = 'view' ORDER BY ts, seq, rid LIMIT 1), o AS (SELECT v.* FROM v, f WHERE user_id = u AND ts >= a)
        SELECT ts, event_type FROM o WHERE ts <= coalesce((SELECT min(ts) FROM o WHERE event_type = 'purchase'), 9223372036854775807)"""
    ).replace(") , f AS", "), f AS")
)
def lifecycle(spark, sf_dir):
    return analytics.lifecycle(view(spark, sf_dir), "user_id", "event_type", "view", "purchase")


@query(with_log('SELECT rid, ts - (SELECT min(ts) FROM v) AS "offset" FROM v ORDER BY ts, seq, rid LIMIT 100'))
def replay(spark, sf_dir):
    return analytics.replay(view(spark, sf_dir)).select("rid", "offset")


@query(with_log("SELECT ts, rid FROM (SELECT ts, rid, row_number() OVER (ORDER BY ts, seq, rid) - 1 AS k FROM v) WHERE k % 1000 = 0 AND k < 100000"))
def audit_points(spark, sf_dir):
    return scans.every_nth(view(spark, sf_dir), 1000, 100).select("ts", "rid")


@query(head_sql(f"SELECT (ts - start) // {60_000_000} AS bucket, count(*) AS n FROM h GROUP BY 1", 1000 * 60_000_000))
def micro_windows(spark, sf_dir):
    rows = analytics.head_window(view(spark, sf_dir), 1000 * 60_000_000)
    return rows.groupBy(floor_div("ts - start", 60_000_000).alias("bucket")).agg(F.count("*").alias("n"))


PERCENTS = (50.0, 95.0, 99.0)


@query(f"WITH r AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT p AS percent, value FROM r, (VALUES (50.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE)) x(p) WHERE k = CAST(floor(p / 100 * (n - 1)) AS BIGINT)")
def percentiles(spark, sf_dir):
    return analytics.quantile(table(spark, sf_dir, "orders"), "o_totalprice", PERCENTS)


@query(f"WITH l AS ({EVENTS}), o AS (SELECT ts, lag(ts) OVER (ORDER BY seq) AS b, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l) SELECT count(*) FILTER (ts < b) AS adjacent, count(*) FILTER (ts < m) AS overall FROM o")
def arrival_disorder(spark, sf_dir):
    return analytics.disorder(events_log(spark, sf_dir), "seq", 1000)


@query("WITH m AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.95) AS p FROM orders) SELECT round(any_value(m), 1) AS median, round(any_value(p), 1) AS p95, round(median(abs(o_totalprice - m)), 1) AS mad FROM orders, m")
def sample_statistics(spark, sf_dir):
    s = analytics.sample_stats(table(spark, sf_dir, "orders"), "o_totalprice")
    return s.select(*[F.round(c, 1).alias(c) for c in ("median", "p95", "mad")])


PER_CUSTOMER = "SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey"


def per_customer(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"))


@query(f"SELECT round(regr_slope(ln(total), ln(n)), 6) AS exponent, round(regr_intercept(ln(total), ln(n)), 6) AS intercept, round(regr_r2(ln(total), ln(n)), 6) AS r2 FROM ({PER_CUSTOMER})")
def scaling_exponent(spark, sf_dir):
    return analytics.power_fit(per_customer(spark, sf_dir), "n", "total").select(*[F.round(c, 6).alias(c) for c in ("exponent", "intercept", "r2")])


@query(f"SELECT round(regr_slope(total, n), 3) AS slope, round(regr_intercept(total, n), 3) AS intercept, round(regr_r2(total, n), 6) AS r2 FROM ({PER_CUSTOMER})")
def linear_scaling(spark, sf_dir):
    return analytics.linear_fit(per_customer(spark, sf_dir), "n", "total").select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT event_id, value + 0.0 AS value, c::INT AS cycle, epoch_us(ts) + c * (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) + 1 FROM events) AS ts FROM events, range(3) r(c)")
def rolling_source(spark, sf_dir):
    from ..sources.orders import rolling

    return rolling(table(spark, sf_dir, "events").select("event_id", "value", micros("ts").alias("ts")), 3, "ts")


@query("""SELECT sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest, count(*) AS n FROM events GROUP BY user_id, event_type""")
def payload_digests(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(scalar.payload_digest("user_id", "event_type").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT k AS x, CASE WHEN k = 0 THEN NULL ELSE 9223372036854775807 - 1 + (1 - k) END AS total FROM range(0, 2) r(k)")
def checked_arithmetic(spark, sf_dir):
    two = F.when(F.col("id") == 0, F.lit(2)).otherwise(F.lit(0)).cast("long")
    return spark.range(2).select(F.col("id").alias("x"), scalar.checked("add", F.lit(MOST - 1).cast("long"), two).alias("total"))


@query(f"SELECT max(window_id) - min(window_id) + 1 AS windows, count(DISTINCT window_id) AS used FROM (SELECT ts // {HOUR} AS window_id FROM ({EVENTS}))")
def window_usage(spark, sf_dir):
    return physical.with_window(events_log(spark, sf_dir), HOUR).agg((F.max("window_id") - F.min("window_id") + 1).alias("windows"), F.count_distinct("window_id").alias("used"))


@query(
    f"""WITH RECURSIVE f AS (
        SELECT row_number() OVER (ORDER BY flush) AS i, n / (most - least + 1) AS d FROM (SELECT rid // 500 AS flush, count(*)::DOUBLE AS n, min(ts) AS least, max(ts) AS most FROM ({EVENTS}) GROUP BY 1)
    ), r AS (SELECT i, d AS s FROM f WHERE i = 1 UNION ALL SELECT f.i, 0.3 * f.d + 0.7 * r.s FROM r JOIN f ON f.i = r.i + 1),
    w AS (SELECT s, least(2000 / s, {30 * DAY}) AS wish FROM r ORDER BY i DESC LIMIT 1)
    SELECT round(s * 1e12, 6) AS density, least((floor(wish + 0.5)::BIGINT + 30000000) // 60000000 * 60000000, {30 * DAY}) AS "window" FROM w"""
)
def adaptive_density(spark, sf_dir):
    """Of a history of flushes of 500 rows: the smoothed density (for 10^12 microseconds), and the window that it asks for."""
    rows = events_log(spark, sf_dir).withColumn("flush", floor_div("rid", 500))
    history = rows.groupBy("flush").agg(F.count("*").alias("records"), F.min("ts").alias("least"), F.max("ts").alias("most"))
    density = adaptive.smoothed_density(history, 0.3).head()[0]
    config = adaptive.Adaptive(target_records=2000, alpha=0.3, window_quantum=60_000_000, max_window=30 * DAY)
    window = adaptive.next_window(adaptive.State(density, 20, 20), config, HOUR)
    return spark.createDataFrame([(round(density * 1e12, 6), window)], "density double, window long")


@query()
def synthetic_orders(spark, sf_dir):
    from ..sources.orders import synthetic

    n = table(spark, sf_dir, "events").count()
    return synthetic(spark, n, seed=42)


@query("SELECT event_id % 4 AS part, 1::BIGINT AS batches, count(*) AS n, sum(event_id)::BIGINT AS ids, min(epoch_us(ts)) AS least, max(epoch_us(ts)) AS largest FROM events GROUP BY 1")
def streaming_ingest(spark, sf_dir):
    """Micro-batches of events appended to a log, one for each of four parts: what each part's rows came to, and in how many batches."""
    import uuid

    from ..sources.store import shared_root
    from ..streaming.ingest import PER_BATCH, ingest

    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(4):
        table(spark, sf_dir, "events").filter(F.col("event_id") % 4 == k).select(micros("ts").alias("ts"), "event_id").coalesce(1).write.parquet(f"{root}/source/part={k}")
    stream = spark.readStream.schema("ts long, event_id long, part int").option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    ingest(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{root}/log").withColumn("batch", floor_div("seq", PER_BATCH))
    return rows.groupBy((F.col("event_id") % 4).alias("part")).agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min("ts").alias("least"), F.max("ts").alias("largest"))


#: Cutoffs, one a week, early and late ones in turn: each hides all that lies before it.
PREFIXES = [(LEAST, DAYS_1992 + k * 7 * DAY, (k * 37 % 300) / 300) for k in range(300)]


@query(with_log("SELECT ts, rid FROM v", ORDERS, PREFIXES))
def visible_many_prefixes(spark, sf_dir):
    rows = orders_log(spark, sf_dir)
    return visible(rows, deletes(spark, rows, PREFIXES)).select("ts", "rid")


@query(
    f"""WITH e AS (SELECT 7 + rid % 3 AS seq, 10 * (rid % 90) AS ts, rid FROM ({EVENTS}) UNION ALL SELECT 1, 100, -1 UNION ALL SELECT 9, 105, -2)
    SELECT ts, rid FROM e WHERE NOT ((ts < 500 AND seq < 8) OR (ts >= 100 AND ts < 200 AND seq < 9))"""
)
def log_lifecycle(spark, sf_dir):
    """A real log on shared storage: appends, deletes, a flush, a compaction and reopening, then what it shows."""
    import uuid

    from ..log import Log
    from ..sources.store import shared_root

    log = Log(spark, f"{shared_root(spark)}/log-{uuid.uuid4().hex}", "rid2 BIGINT", time_unit="us", maintenance="disabled", window_size=70, window_origin=3)
    rows = events_log(spark, sf_dir)
    log.append(100, (-1,))
    for k in range(3):  # calls 2, 4 and 6 stand for the sequence numbers 7, 8 and 9 of the SQL
        log.append_frame(rows.filter(F.col("rid") % 3 == k).select((10 * (F.col("rid") % 90)).alias("ts"), F.col("rid").alias("rid2")))
        if k == 0:
            log.delete_before(500)
        if k == 1:
            log.delete_range(100, 200)
            log.compact_now()
    log.append(105, (-2,))
    log.flush()
    log.close()
    log.reopen()
    return log.frame().select("ts", F.col("rid2").alias("rid"))
