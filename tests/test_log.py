import random
from dataclasses import replace

import pytest

from ebbmark.errors import LogError
from ebbmark.functions.scalar import LEAST, MOST
from ebbmark.log import Log, clipped, meets, timestamp, union
from ebbmark.operators.adaptive import Adaptive, State, nearest_multiple, next_window, observe


@pytest.fixture
def log(spark, tmp_path):
    out = Log(spark, f"file://{tmp_path}/log", time_unit="s", maintenance="disabled")
    yield out
    out.close()


def test_reads_and_deletes(log):
    log.extend([(10, "a"), (20, "b"), (30, {"x": 1})], insert_on_error=False)
    log[20] = "again"
    assert list(log[15:30]) == [(20, "b"), (20, "again")]
    assert log[20] == ["b", "again"] and log.at(99) == [] and len(log) == 4
    del log[20]
    assert [t for t, _ in log] == [10, 30]
    log[20] = "new"
    assert log[20] == ["new"]
    assert (log.min_ts(), log.max_ts(), log.next_ts(10), log.prev_ts(10)) == (10, 30, 20, None)
    log.delete_before(20)
    assert [t for t, _ in log[:]] == [20, 30]
    with pytest.raises(ValueError):
        log.range(5, 4)
    assert list(log.range(5, 5)) == []


def test_same_answers_in_every_state(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=10)
    log.extend([(t, t) for t in [5, 1, 9, 12, 25, 25]], insert_on_error=False)
    log.delete_range(8, 13)
    log.append(9, "late")
    want = [(1, 1), (5, 5), (9, "late"), (25, 25), (25, 25)]
    before = log.snapshot()
    assert list(log) == want
    log.flush()
    assert list(log) == want and sum(map(len, log.views())) == 7
    gone = log.compact_now()
    assert sorted(r["ts"] for r in gone.collect()) == [9, 12]
    assert list(log) == want and sum(map(len, log.views())) == 5 and list(before.all()) == want
    assert list(log[9:25]) == [(9, "late")]
    log.validate()
    log.append(3, "x")
    assert list(before.all()) == want and len(log) == 6
    other = Log(spark, f"file://{tmp_path}/log", maintenance="disabled")
    assert list(other) == want  # what wasn't flushed is lost
    assert log.vacuum()
    assert len(log) == 6


def test_a_second_writer_loses_nothing(spark, tmp_path):
    a, b = (Log(spark, f"file://{tmp_path}/log", maintenance="disabled") for _ in range(2))
    a.append(1, 100)
    b.append(2, 200)
    a.flush()
    with pytest.raises(FileExistsError):
        b.flush()
    assert list(Log(spark, f"file://{tmp_path}/log", maintenance="disabled")) == [(1, 100)] and list(b) == [(2, 200)]


def test_flushes_are_counted_over_reopening(spark, tmp_path):
    options = dict(maintenance="disabled", adaptive={"target_records": 10, "alpha": 0.5})
    log = Log(spark, f"file://{tmp_path}/log", **options)
    for k in range(3):
        log.extend([(10 * k, 1), (10 * k + k + 1, 2)], insert_on_error=False)
        log.flush()
    log.append_frame(spark.createDataFrame([(50, "3"), (70, "4")], "ts long, payload string"))
    again = Log(spark, f"file://{tmp_path}/log", **options)
    assert again.stats()["operational"]["flushes_total"] == 4 and again.window() == log.window()


def test_pruning_with_an_origin(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=10, window_origin=3)
    log.extend([(t, t) for t in range(-30, 60)], insert_on_error=False)
    log.compact_now()
    for a, b in ((-12, 7), (3, 13), (0, 59), (12, 14)):
        assert [t for t, _ in log[a:b]] == list(range(a, b))
    plan = log.frame(12, 14)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(window_id" in plan


def test_compaction_with_a_cap_keeps_deletes(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", compaction_max_inputs=1, window_size=10)
    for t in (1, 2, 3):
        log.append(t, t)
        log.flush()
    log.delete_range(2, 4)
    log.compact()
    assert log.maint_step() and [t for t, _ in log] == [1]
    assert log.stats()["storage"]["tombstones"] == 1
    log.append(3, "new")
    for _ in range(4):
        log.compact()
        log.maint_step()
    assert [t for t, _ in log] == [1, 3]


def test_compaction_rewrites_only_what_it_must(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=10)
    log.extend([(t, t) for t in range(60)], insert_on_error=False)
    log.compact_now()
    (first, _, _), = log._m.windows
    old = log.snapshot()
    log.append(25, "new")
    log.delete_range(41, 43)
    gone = log.compact_now()
    assert sorted(r["ts"] for r in gone.collect()) == [41, 42]
    windows = {name: [w[0] for w in entries] for name, _, entries in log._m.windows}
    assert windows.pop(first) == [0, 1, 3, 5] and list(windows.values()) == [[2, 4]] and log._deletes == []
    assert [t for t, _ in log] == sorted([*range(41), 25, *range(43, 60)]) and old.count() == len(old.all()) == 60
    assert sum(map(len, log.views())) == 59
    log.validate()
    again = Log(spark, f"file://{tmp_path}/log", maintenance="disabled")
    assert len(again) == 59 and again._m == log._m
    log.delete_before(60)
    assert sum(1 for _ in log.compact_now().collect()) == 59 and len(log) == 0 and log._m.windows == () and log._deletes == []
    assert list(log) == [] and first in log.vacuum()


def test_a_failed_compaction_changes_nothing(spark, tmp_path):
    options = dict(maintenance="disabled", window_size=1000, adaptive={"target_records": 10, "alpha": 0.5, "failure_backoff_threshold": 2, "failure_backoff_pct": 50})
    a, b = (Log(spark, f"file://{tmp_path}/log", **options) for _ in range(2))
    a.extend([(t, t) for t in range(20)], insert_on_error=False)
    a.delete_range(3, 8)
    a.flush()
    b.append(1, "first")
    b._m = replace(a._m, deltas=(), sizes=())  # another writer that takes the next number
    b.flush()
    before = a.window()
    for failures in (1, 2):
        with pytest.raises(FileExistsError):
            a.compact_now()
        assert a.stats()["adaptive"]["failures"] == failures and len(a) == 15 and a._deletes == [(2, 3, 8)]
    assert (before, a.window()) == (10, 15)
    a._m = replace(a._m, version=b._m.version)  # as if there were no other writer
    a.compact_now()
    assert a.stats()["adaptive"]["failures"] == 0 and len(a) == 15 and a._m.window == 15


def test_caps_of_compaction(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=10, compaction_max_windows=2)
    for a in (0, 10, 20, 30):
        log.extend([(t, t) for t in range(a, a + 10)], insert_on_error=False)
        log.flush()
    log.compact_now()
    assert [w[0] for _, _, entries in log._m.windows for w in entries] == [0, 1] and len(log._m.deltas) == 2
    log.compact_now()
    log.delete_range(5, 35)
    assert len(log.compact_now().collect()) == 15 and log._deletes == [(5, 20, 35)] and len(log) == 10
    assert len(log.compact_now().collect()) == 15 and log._deletes == [] and [t for t, _ in log] == [*range(5), *range(35, 40)]
    small = Log(spark, f"file://{tmp_path}/small", maintenance="disabled", compaction_target_bytes=1)
    for t in (1, 2):
        small.append(t, t)
        small.flush()
    small.compact_now()
    assert len(small._m.deltas) == 1 and len(small) == 2


def test_counts_from_the_manifest(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=10)
    log.extend([(t, t) for t in range(100)], insert_on_error=False)
    log.compact_now()
    log.extend([(t, t) for t in range(50, 60)], insert_on_error=False)
    log.flush()
    snapshot, read = log.snapshot(), []
    log._store.read = lambda m, get=log._store.read: (read.append([w[0] for _, _, entries in m.windows for w in entries]), get(m))[1]
    assert len(log) == 110 and log.count_range(20, 60) == 50 and log.count_range(7, 7) == 0 and read == []
    assert log.count_range(15, 43) == 28 and read == [[1, 4]]
    log.delete_range(71, 75)
    log.append(3, "waits")
    assert len(log) == 107 and read[1:] == [[7]] and log.count_range(0, 10) == 11 and snapshot.count() == 110


def test_any_order_of_writes_and_compactions(spark, tmp_path):
    draw = random.Random(5)
    log = Log(spark, f"file://{tmp_path}/log", maintenance="disabled", window_size=7, window_origin=3, compaction_max_inputs=2, compaction_max_windows=3)
    model, dropped, removed = [], [], []
    for step in range(24):
        what = draw.choice(["add", "add", "flush", "cut", "compact"])
        if what == "add":
            new = [(draw.randrange(-30, 30), step * 100 + k) for k in range(draw.randrange(1, 9))]
            log.extend(new, insert_on_error=False)
            model += new
        elif what == "cut":
            a = draw.randrange(-30, 30)
            b = a + draw.randrange(1, 15)
            log.delete_range(a, b)
            removed += [x for x in model if a <= x[0] < b]
            model = [x for x in model if not a <= x[0] < b]
        elif what == "flush":
            log.flush()
        else:
            dropped += [(r["ts"], int(r["payload"])) for r in log.compact_now().collect()]
            assert sorted(log) == sorted(model)
        assert len(log) == len(model) and log.count_range(-9, 11) == sum(-9 <= t < 11 for t, _ in model)
    while log._m.deltas or log._buffer or log._deletes:
        dropped += [(r["ts"], int(r["payload"])) for r in log.compact_now().collect()]
    assert sorted(log) == sorted(model) and sorted(dropped) == sorted(removed)
    log.validate()


def test_ranges_of_deletes():
    ranges = union([(1, 5, 9), (2, 0, 3), (3, 3, 4), (4, 20, None), (5, 30, 40)])
    assert ranges == [(0, 4), (5, 9), (20, None)]
    assert [meets(ranges, a, b) for a, b in ((4, 4), (3, 3), (9, 19), (8, 9), (9, 20), (MOST, MOST), (LEAST, -1))] == [False, True, False, True, True, True, False]
    assert clipped([(1, 0, 100), (2, 12, 14), (3, 25, None), (4, LEAST, 6)], [(5, 9), (20, 30)]) == [(1, 5, 31), (3, 25, 31), (4, 5, 6)]
    assert clipped([(1, 0, None)], [(7, MOST)]) == [(1, 7, None)] and clipped([(1, 0, 9)], []) == []


def test_iterators(log):
    log.extend([(t, t) for t in range(10)], insert_on_error=False)
    rows = log.since(4)
    assert len(rows) == 6 and rows.next_batch(2) == [(4, 4), (5, 5)] and len(rows) == 4 and rows.next_batch(0) == []
    with pytest.raises(ValueError):
        rows.next_batch(-1)
    assert len(rows.next_batch(99)) == 4 and list(rows) == []
    with log.all() as rows:
        assert next(rows) == (0, 0)
    assert rows.closed and len(rows) == 0 and list(rows) == []
    seen = []
    log.scan(0, 10, lambda t, _: seen.append(t) or t < 3)
    assert seen == [0, 1, 2, 3]


def test_the_ends_of_time(log):
    log.extend([(LEAST, 1), (MOST, 2)], insert_on_error=False)
    assert [t for t, _ in log.until(MOST)] == [LEAST] and [t for t, _ in log.since(MOST)] == [MOST]
    with pytest.raises(ValueError):
        log.delete(MOST)
    del log[:]
    assert [t for t, _ in log] == [MOST]


def test_arguments(spark, log, tmp_path):
    for bad, error in ((True, TypeError), (1.5, TypeError), ("1", TypeError), (2**63, OverflowError)):
        with pytest.raises(error):
            timestamp(bad)
    for step in (2, True, 1.0):
        with pytest.raises(ValueError):
            log[1:2:step]
    with pytest.raises(ValueError):
        log.views(1)
    with pytest.raises(ValueError):
        log.extend([1, 2], ["a"])
    with pytest.raises(TypeError):
        log.extend(iter([(1, 2)]), insert_on_error=False)
    log.extend([(True, 0), (2**70, 0), (1, "good")])
    assert list(log) == [(1, "good")]
    with pytest.raises(OverflowError):
        log.extend([(2, "no"), (2**70, 0)], insert_on_error=False)
    assert len(log) == 1
    with pytest.raises(ValueError):
        log.extend([5])
    with pytest.raises(ValueError):
        Log(spark, f"file://{tmp_path}/x", adaptive={"alpha": 0.1}, adaptive_alpha=0.2)
    with pytest.raises(ValueError):
        Log(spark, f"file://{tmp_path}/x", compaction={"nothing": 1})
    with pytest.raises(TypeError):
        Log(spark, f"file://{tmp_path}/x", adaptive=5)
    with pytest.raises(LogError):
        log.reopen()


def test_empty_log_and_sequence_numbers(log):
    assert (log.min_ts(), log.max_ts(), log.next_ts(0), log.prev_ts(0), len(log)) == (None, None, None, None, 0)
    log.delete_range(5, 5)
    log.delete_before(LEAST)
    log.extend([])
    assert log.stats()["operational"]["op_seq"] == 0
    log.extend([(1, 1), (2, 2)], insert_on_error=False)
    assert log.stats()["operational"]["op_seq"] == 1


def test_min_ts(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", min_ts=10)
    with pytest.raises(ValueError):
        log.append(9, "x")
    log.append(10, "y")
    assert list(log) == [(10, "y")]
    log.close()
    with pytest.raises(LogError):
        log.append(11, "z")
    log.reopen(min_ts=None)
    log.append(3, "w")
    assert log.at(3) == ["w"]


def test_typed_payload(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", "kind STRING, value DOUBLE", maintenance="disabled")
    log.append_frame(spark.createDataFrame([(3, "a", 1.0), (4, "b", 2.0)], "ts long, kind string, value double"))
    log.append(5, ("c", 3.0))
    assert log.frame().filter("value > 1.5").select("kind").collect() == [("b",), ("c",)]
    assert log.at(5) == [("c", 3.0)] and log.at_each([3, 5, 7]).count() == 2


CONFIG = dict(target_records=1000, alpha=0.5)


@pytest.mark.parametrize("state, config, current, want", [
    (State(2.0, 5, 5), {}, 10, 500),
    (State(2.0, 5, 5), {"warmup_flushes": 6}, 10, 10),
    (State(None, 5, 0), {}, 10, 10),
    (State(2.0, 9, 5), {"stale_flushes": 3}, 10, 10),
    (State(2.0, 9, 5), {"stale_flushes": 4}, 10, 500),
    (State(2.0, 5, 5), {"hysteresis_pct": 10}, 455, 455),
    (State(2.0, 5, 5), {"hysteresis_pct": 25}, 400, 500),  # a change of just the limit counts
    (State(2.0, 5, 5, 3), {"failure_backoff_threshold": 3, "failure_backoff_pct": 50}, 10, 750),
    (State(2.0, 5, 5), {"max_window": 300}, 10, 300),
    (State(2.0, 5, 5), {"window_quantum": 300}, 10, 600),
    (State(2.0, 5, 5), {"window_quantum": 300, "max_window": 550}, 10, 550),
])
def test_next_window(state, config, current, want):
    assert next_window(state, Adaptive(**CONFIG | config), current) == want


def test_density_and_rounding():
    c = Adaptive(**CONFIG)
    s = observe(State(), c, 100, 0, 49)
    assert s == State(2.0, 1, 1)
    s = observe(s, c, 0, 0, 0)
    assert s == State(2.0, 2, 1)
    assert observe(s, c, 40, 0, 9).density == 3.0
    assert observe(s, c, 40, LEAST, MOST).density == 2.0
    assert [nearest_multiple(x, 7) for x in (3, 4, 10, 11)] == [0, 7, 7, 14] and [nearest_multiple(x, 8) for x in (3, 4)] == [0, 8]
    with pytest.raises(ValueError):
        Adaptive(target_records=1, alpha=2)
