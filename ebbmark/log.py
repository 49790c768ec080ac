"""The log as an object: one writer, any number of snapshots.

Rows wait in a buffer of the driver until there are enough for a file; reads see them all the same. Payloads are any JSON
value, or with a schema typed columns that queries can use (`frame`). One call for one row starts one Spark job at least:
for many rows use extend, append_frame, at_each and the operators on frames.
"""

from __future__ import annotations

import bisect
import itertools
import json
import operator
import time
from collections.abc import Iterable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, Config, configured
from .errors import LogBusyError, LogError  # noqa: F401
from .functions.scalar import LEAST, MOST, TICKS
from .operators import adaptive, physical, retention, scans
from .operators.visibility import visible
from .sources.store import Manifest, Store

_UNSET = object()
#: Rows of a chunk of an iterable, which is one call each.
CHUNK = 1024


def timestamp(value) -> int:
    """A 64-bit integer: booleans and what is no integer are TypeErrors, others out of range OverflowErrors."""
    if isinstance(value, bool):
        raise TypeError("a timestamp must be an integer, not a bool")
    ts = operator.index(value)
    if not LEAST <= ts <= MOST:
        raise OverflowError(f"timestamp {ts} doesn't fit 64 bits")
    return ts


def bounds_of(key: slice) -> tuple[int | None, int | None]:
    if key.step is not None and (isinstance(key.step, bool) or not isinstance(key.step, int) or key.step != 1):
        raise ValueError("a slice of a log has no step but 1")
    return None if key.start is None else timestamp(key.start), None if key.stop is None else timestamp(key.stop)


def union(deletes: Iterable[tuple[int, int, int | None]]) -> list[tuple[int, int | None]]:
    """The ranges that deletes cover together, apart and in order; an end of None is none."""
    out: list[tuple[int, int | None]] = []
    for _, a, b in sorted(deletes, key=lambda x: x[1]):
        if out and (out[-1][1] is None or a <= out[-1][1]):
            last, end = out[-1]
            out[-1] = (last, None if end is None or b is None else max(end, b))
        else:
            out.append((a, b))
    return out


def meets(ranges: list[tuple[int, int | None]], first: int, last: int) -> bool:
    """Whether one of the ranges of a union holds a timestamp from first to last."""
    k = bisect.bisect_right(ranges, last, key=lambda x: x[0])
    return k > 0 and (ranges[k - 1][1] is None or ranges[k - 1][1] > first)


def clipped(deletes: Iterable[tuple[int, int, int | None]], spans: Iterable[tuple[int, int]]) -> list[tuple[int, int, int | None]]:
    """Deletes that hold a timestamp of a span (its first and last), cut to the spans that they meet."""
    whole = union((0, a, None if b == MOST else b + 1) for a, b in spans)
    out = []
    for seq, a, b in deletes:
        lo = bisect.bisect_right(whole, a, key=lambda x: x[0])
        lo -= lo > 0 and (whole[lo - 1][1] is None or whole[lo - 1][1] > a)
        hi = len(whole) if b is None else bisect.bisect_left(whole, b, key=lambda x: x[0])
        if lo < hi:
            end = whole[hi - 1][1]
            out.append((seq, max(a, whole[lo][0]), end if b is None else b if end is None else min(b, end)))
    return out


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, *, min_ts: int | None = None, mostly_ordered_default: bool = True, **options):
        """schema: the payload's columns as DDL; without one a payload is a JSON value."""
        self.spark, self.path, self.closed = spark, path, True
        self._payload = schema
        self._open(min_ts, mostly_ordered_default, options)

    @classmethod
    def preset(cls, name: str, spark: SparkSession, path: str, **options) -> Log:
        """With the options of a preset: streaming, bulk_ingest or low_latency."""
        return cls(spark, path, **(PRESETS[name] | options))

    def _open(self, min_ts, mostly_ordered_default, options) -> None:
        if not isinstance(mostly_ordered_default, bool):
            raise TypeError("mostly_ordered_default must be a bool")
        self.config: Config = configured(options)
        self._min_ts = None if min_ts is None else timestamp(min_ts)
        self._mostly_ordered = mostly_ordered_default
        self._schema = f"seq BIGINT, ts BIGINT, rid BIGINT, {self._payload or 'payload STRING'}"
        self._store = Store(self.spark, self.path, self._schema)
        self._m: Manifest = self._store.load()
        self._seq, self._rid = self._m.seq, self._m.next_rid
        self._buffer: list[tuple] = []
        self._deletes: list[tuple[int, int, int | None]] = list(self._m.deletes)
        self._adaptive = adaptive.State(*self._m.adaptive)
        self._wanted, self._working, self.closed = False, self.config.maintenance == "background", False
        if self._min_ts is not None:
            self.delete_before(self._min_ts)

    # Lifecycle

    def close(self) -> None:
        """Drops what wasn't flushed. Closing again does nothing."""
        self._buffer, self._working, self.closed = [], False, True

    def reopen(self, *, min_ts=_UNSET, mostly_ordered_default=_UNSET, **options) -> None:
        if not self.closed:
            raise LogError("only a closed log can be opened again")
        self._open(self._min_ts if min_ts is _UNSET else min_ts, self._mostly_ordered if mostly_ordered_default is _UNSET else mostly_ordered_default, options)

    configure = reopen

    def __enter__(self) -> Log:
        self._check()
        if self.config.maintenance == "background":
            self.start_maintenance()
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def _check(self) -> None:
        if self.closed:
            raise LogError("the log is closed")

    time_unit = property(lambda self: self.config.time_unit)
    maintenance_mode = property(lambda self: self.config.maintenance)
    busy_policy = property(lambda self: self.config.busy_policy)
    retired_queue_len = property(lambda self: 0)
    alloc_failures = property(lambda self: 0)

    # Writes

    def now(self) -> int:
        return time.time_ns() // (10**9 // TICKS[self.config.time_unit])

    def _guarded(self, value) -> int:
        ts = timestamp(value)
        if self._min_ts is not None and ts < self._min_ts:
            raise ValueError(f"timestamp {ts} lies before min_ts, {self._min_ts}")
        return ts

    def _take(self, pairs: list[tuple[int, object]]) -> None:
        """One call: one sequence number for all rows. Nothing is taken if one of them is bad."""
        self._check()
        if not pairs:
            return
        rows = [(self._seq + 1, ts, self._rid + k, *self._columns(obj)) for k, (ts, obj) in enumerate(pairs)]
        self._seq, self._rid = self._seq + 1, self._rid + len(rows)
        self._buffer += rows
        if len(self._buffer) >= self.config.buffer_rows:
            self.flush()
            if self._working:
                self.maint_step()

    def _columns(self, obj) -> tuple:
        if self._payload is None:
            return (json.dumps(obj, sort_keys=True),)
        return tuple(obj.values()) if isinstance(obj, dict) else tuple(obj) if isinstance(obj, (tuple, list)) else (obj,)

    def append(self, first, second=_UNSET, *, ts=None) -> None:
        """append(obj) at the present time, append(obj, ts=t), or append(t, obj)."""
        if second is not _UNSET:
            if ts is not None:
                raise TypeError("the timestamp is given twice")
            first, ts = second, first
        self._take([(self._guarded(self.now() if ts is None else ts), first)])

    def __setitem__(self, ts, obj) -> None:
        """Adds a row; rows of that timestamp stay."""
        self.append(ts, obj)

    def extend(self, items, objects=None, *, mostly_ordered=None, insert_on_error: bool = True) -> None:
        """Rows from (ts, obj) pairs, or from timestamps and objects. insert_on_error: bad timestamps are passed over, in chunks of one call each; else all must be right, and are one call."""
        self._check()
        if objects is not None:
            if all(hasattr(x, "__len__") for x in (items, objects)) and len(items) != len(objects):
                raise ValueError("there are not as many timestamps as objects")
            if not insert_on_error and not all(hasattr(x, "__len__") for x in (items, objects)):
                raise TypeError("without insert_on_error sequences are needed")
            items = zip(items, objects, strict=True) if insert_on_error else list(zip(items, objects, strict=True))
        if not insert_on_error:
            if not hasattr(items, "__len__"):
                raise TypeError("without insert_on_error a sequence is needed")
            return self._take([(self._guarded(ts), obj) for ts, obj in map(self._pair, items)])
        good = self._good(items)
        while chunk := list(itertools.islice(good, CHUNK)):
            self._take(chunk)

    @staticmethod
    def _pair(item) -> tuple:
        try:
            ts, obj = item
        except (TypeError, ValueError) as error:
            raise ValueError("(timestamp, object) pairs are needed") from error
        return ts, obj

    def _good(self, items: Iterable) -> Iterator[tuple[int, object]]:
        for item in items:
            ts, obj = self._pair(item)
            try:
                yield self._guarded(ts), obj
            except (TypeError, OverflowError):
                continue

    def append_frame(self, rows: DataFrame) -> None:
        """All rows of a frame (ts and the payload's columns) in one call, without passing through the driver. Rows below min_ts fail the job."""
        self._check()
        self.flush()
        if self._min_ts is not None:
            rows = rows.filter(F.when(F.col("ts") >= self._min_ts, True).otherwise(F.raise_error(F.lit("a timestamp lies before min_ts"))))
        seq, start = self._seq + 1, self._rid
        numbered = rows.sortWithinPartitions("ts").withColumns({"seq": F.lit(seq).cast("long"), "rid": F.monotonically_increasing_id() + start})
        columns = self.spark.createDataFrame([], self._schema).columns
        name = self._store.write(numbered.select(*columns), f"delta-{seq:012}")
        n, a, b, top = self.spark.read.parquet(f"{self.path}/{name}").agg(F.count("*"), F.min("ts"), F.max("ts"), F.max("rid")).head()
        if n:
            self._seq, self._rid = seq, top + 1
            self._adaptive = adaptive.observe(self._adaptive, self.config.adaptive, n, a, b)
            self._commit(**self._added(name, n, a, b))

    def _added(self, name: str, rows: int, first: int, last: int) -> dict:
        return {"deltas": (*self._m.deltas, name), "sizes": (*self._m.sizes, (rows, first, last, self._store.size(name)))}

    # Deletes

    def _cut(self, t1: int, t2: int | None) -> None:
        self._check()
        if t2 is not None and t1 > t2:
            raise ValueError("a range must not end before it starts")
        if t1 != t2:
            self._seq += 1
            self._deletes.append((self._seq, t1, t2))

    def delete_range(self, t1, t2) -> None:
        self._cut(timestamp(t1), timestamp(t2))

    def delete_before(self, ts) -> None:
        self._cut(LEAST, timestamp(ts))

    cutoff = delete_before

    def delete(self, t1, t2=None) -> None:
        """A range, or without t2 the one timestamp; the largest can't be deleted so, as a range has no end behind it."""
        t1 = timestamp(t1)
        if t2 is None and t1 == MOST:
            raise ValueError("no half-open range holds the largest timestamp")
        self._cut(t1, t1 + 1 if t2 is None else timestamp(t2))

    def __delitem__(self, key) -> None:
        if isinstance(key, slice):
            t1, t2 = bounds_of(key)
            self._cut(LEAST if t1 is None else t1, MOST if t2 is None else t2)
        else:
            self.delete(key)

    def keep_latest(self, span: int) -> None:
        """Deletes what is older than the latest visible timestamp - span."""
        if (cut := retention.age_cutoff(self.frame(), span)) is not None:
            self.delete_before(cut)

    # Reads

    def snapshot(self) -> Snapshot:
        self._check()
        return Snapshot(self)

    def frame(self, t1: int | None = None, t2: int | None = None) -> DataFrame:
        """Visible rows as a frame: seq, ts, rid and the payload's columns."""
        return self.snapshot().frame(t1, t2)

    def range(self, t1, t2) -> Rows:
        return self.snapshot().range(t1, t2)

    def since(self, t1) -> Rows:
        return self.snapshot().since(t1)

    def until(self, t2) -> Rows:
        return self.snapshot().until(t2)

    def all(self) -> Rows:
        return self.snapshot().all()

    def equal(self, ts) -> Rows:
        return self.snapshot().equal(ts)

    point = equal

    def at(self, ts) -> list:
        return [obj for _, obj in self.equal(ts)]

    def at_each(self, stamps: Iterable[int]) -> DataFrame:
        """Visible rows at any of the timestamps: one job."""
        probes = self.spark.createDataFrame([(timestamp(t),) for t in stamps], "ts long")
        return scans.at_each(self.frame(), probes)

    def __getitem__(self, key):
        if isinstance(key, slice):
            t1, t2 = bounds_of(key)
            if t1 is None:
                return self.all() if t2 is None else self.until(t2)
            return self.since(t1) if t2 is None else self.range(t1, t2)
        return self.at(key)

    def __iter__(self) -> Rows:
        return self.all()

    def __len__(self) -> int:
        return self.snapshot().count()

    def count_range(self, t1, t2) -> int:
        return self.snapshot().count(timestamp(t1), timestamp(t2))

    def _one(self, rows: DataFrame) -> int | None:
        return rows.head()[0]

    def min_ts(self) -> int | None:
        return self._one(scans.least_ts(self.frame()))

    def max_ts(self) -> int | None:
        return self._one(scans.most_ts(self.frame()))

    def next_ts(self, ts) -> int | None:
        return self._one(scans.next_ts(self.frame(), timestamp(ts)))

    def prev_ts(self, ts) -> int | None:
        return self._one(scans.prev_ts(self.frame(), timestamp(ts)))

    def scan(self, t1, t2, visit) -> None:
        """visit(ts, obj) in order until it returns False."""
        for ts, obj in self.range(t1, t2):
            if visit(ts, obj) is False:
                return

    def views(self, t1=None, t2=None, *, kind: str = "segment") -> list[Span]:
        """A span for each stored file with rows in [t1, t2): compacted files first. Deletes don't count, rows that wait in the buffer aren't seen."""
        self._check()
        if (t1 is None) != (t2 is None):
            raise ValueError("both bounds are needed, or neither")
        if kind != "segment":
            raise ValueError("there are only spans of kind segment")
        t1, t2 = (LEAST, MOST) if t1 is None else (timestamp(t1), timestamp(t2))
        if t1 > t2:
            raise ValueError("a range must not end before it starts")
        m, out = self._m, []
        tables = [self._store.folder(entry) for entry in m.windows] + [self.spark.read.parquet(f"{self.path}/{name}") for name in m.deltas]
        for table in tables:
            rows = physical.file_spans(table, t1, t2).orderBy("start_ts", "file").collect()
            out += [Span(self, r["file"], r["start_ts"], r["last_ts"], r["rows"], t1, t2) for r in rows]
        return out

    page_spans = views

    # Maintenance

    def _commit(self, **changes) -> None:
        state = self._adaptive
        fields = {**self._m.__dict__, **changes, "version": self._m.version + 1, "seq": self._seq, "next_rid": self._rid, "adaptive": (state.density, state.flushes, state.updated, state.failures)}
        if "deletes" not in changes:
            fields["deletes"] = tuple(self._deletes)
        new = Manifest(**fields)
        self._store.commit(new)
        self._m = new

    def flush(self) -> None:
        """Writes what waits in the buffer, which is emptied once that is committed: if another writer was first, nothing is lost here or there. Rows that deletes hide already are written too; compaction drops and returns them."""
        self._check()
        if not self._buffer:
            if tuple(self._deletes) != self._m.deletes:
                self._commit()
            return
        rows = self.spark.createDataFrame(self._buffer, self._schema)
        name = self._store.write(rows.sortWithinPartitions("ts", "seq"), f"delta-{self._seq:012}")
        stamps, before = [r[1] for r in self._buffer], self._adaptive
        self._adaptive = adaptive.observe(before, self.config.adaptive, len(stamps), min(stamps), max(stamps))
        try:
            self._commit(**self._added(name, len(stamps), min(stamps), max(stamps)))
        except FileExistsError:
            self._adaptive = before
            raise
        self._buffer = []

    def compact(self) -> None:
        """Asks for a compaction; maint_step does it."""
        self._check()
        self._wanted = True

    def window(self) -> int:
        """Of the grid: fixed by the first compaction, before that as configured or as the flushes' density asks."""
        return self._m.window or adaptive.next_window(self._adaptive, self.config.adaptive, self.config.window)

    def delete_debt(self) -> float:
        rows = self.spark.createDataFrame(self._deletes, "seq long, t1 long, t2 long")
        return physical.delete_debt(rows, self.window(), self.config.window_origin).head()[0]

    def needs_compaction(self) -> bool:
        limit = self.config.delete_debt_threshold
        return self._wanted or len(self._m.deltas) >= self.config.max_delta_segments or bool(limit and self._deletes and self.delete_debt() >= limit)

    def maint_step(self) -> bool:
        """One piece of work, if any is due: whether there was."""
        self._check()
        if self._buffer:
            self.flush()
            return True
        if not self.needs_compaction() or not (self._m.deltas or (self._m.windows and self._deletes)):
            self._wanted = False
            return False
        self.compact_now()
        self._wanted = False
        return True

    def start_maintenance(self) -> None:
        """From now on a full buffer is followed by a maintenance step."""
        self._check()
        self._working = True

    def stop_maintenance(self) -> None:
        self._check()
        self._working = False

    def _oldest(self, window: int) -> int:
        """How many folders of appended rows the next compaction takes: the oldest, up to the caps on their number, their bytes, and the windows from their first to their last; one at least."""
        c, sizes = self.config, self._m.sizes
        taken, first, last, size = 0, MOST, LEAST, 0
        for _, a, b, n in sizes[: c.compaction_max_inputs or None]:
            first, last, size = min(first, a), max(last, b), size + n
            windows = (last - c.window_origin) // window - (first - c.window_origin) // window + 1
            if taken and ((c.compaction_target_bytes and size > c.compaction_target_bytes) or (c.compaction_max_windows and windows > c.compaction_max_windows)):
                break
            taken += 1
        return taken

    def compact_now(self) -> DataFrame:
        """Moves appended rows into windows, and returns the rows that deletes removed. Rewritten are those windows alone that get rows or in which deletes lie, the latter up to the cap on windows; the others' files stay. Of a delete remains what other files may hold rows for. A failure leaves the log as it was, and is counted until a compaction succeeds."""
        self.flush()
        before = self._adaptive
        try:
            return self._rewritten()
        except Exception:
            self._adaptive = replace(before, failures=before.failures + 1)
            raise

    def _rewritten(self) -> DataFrame:
        m, c = self._m, self.config
        window, n = self.window(), self._oldest(self.window())
        taken, deletes = m.deltas[:n], self.spark.createDataFrame(self._deletes, "seq long, t1 long, t2 long")
        touched = {r[0] for r in physical.with_window(self._store.read(Manifest(deltas=taken)), window, c.window_origin).select("window_id").distinct().collect()} if taken else set()
        cuts = union(self._deletes)
        for w, _, a, b in sorted(x for _, _, windows in m.windows for x in windows):
            if meets(cuts, a, b) and (not c.compaction_max_windows or len(touched) < c.compaction_max_windows):
                touched.add(w)
        old, left = [], []
        for name, whole, windows in m.windows:
            inside = tuple(x for x in windows if x[0] in touched)
            outside = tuple(x for x in windows if x[0] not in touched)
            if inside:
                old.append((name, whole and not outside, inside))
            if outside:
                left.append((name, whole and not inside, outside))
        others = [(a, b) for _, a, b, _ in m.sizes[n:]] + [(a, b) for _, _, windows in left for _, _, a, b in windows]
        rows = self._store.read(Manifest(deltas=taken, windows=tuple(old)))
        if taken or old:
            kept = physical.compacted(rows, deletes, window, c.window_origin).repartitionByRange("window_id", "ts").sortWithinPartitions("window_id", "ts", "seq")
            name = self._store.write(kept, f"windows-{m.version + 1:012}", by="window_id")
            new = self._store.folder((name, True, ())).groupBy("window_id").agg(F.count("*"), F.min("ts"), F.max("ts")).collect()
            if new:
                left.append((name, True, tuple(sorted(map(tuple, new)))))
        remain = clipped(self._deletes, others)
        self._adaptive = replace(self._adaptive, failures=0)
        self._commit(deltas=m.deltas[n:], sizes=m.sizes[n:], windows=tuple(left), window=window if left else m.window, deletes=tuple(remain))
        self._deletes = remain
        return physical.dropped(rows, deletes)

    def vacuum(self, *snapshots: Snapshot) -> list[str]:
        """Removes files that neither the log nor the given snapshots need."""
        return self._store.vacuum([self._m, *(s.manifest for s in snapshots)])

    def stats(self) -> dict[str, dict]:
        """Figures in five groups."""
        snap = self.snapshot()
        rows, deletes = snap.inserts(), snap.delete_table()
        f = physical.layout(rows, deletes).head()
        m = self._m
        return {
            "storage": {"segments_l0": len(m.deltas), "segments_l1": len(m.windows), "records_estimate": f["visible_rows"], "raw_records": f["rows"], "min_ts": f["raw_min_ts"], "max_ts": f["raw_max_ts"], "tombstones": f["deletes"], "manifest": m.version},
            "memtable": {"active_records": len(self._buffer), "ooo_records": sum(a[1] > b[1] for a, b in itertools.pairwise(self._buffer)), "sealed_runs": 0},
            "operational": {"op_seq": self._seq, "flushes_total": self._adaptive.flushes, "maintenance": self._working},
            "compaction_selection": {"wanted": self._wanted, "delta_limit": self.config.max_delta_segments, "max_inputs": self.config.compaction_max_inputs},
            "adaptive": {"window": self.window(), "density": self._adaptive.density or 0.0, "flushes": self._adaptive.flushes, "failures": self._adaptive.failures},
        }

    def validate(self) -> None:
        """LogError if a compacted row lies outside of its window, or row ids repeat."""
        table = self._store.read_windows(self._m)
        if table is not None and not physical.check_windows(table, self._m.window, self.config.window_origin).isEmpty():
            raise LogError("a row lies outside of its window")
        rows = self.snapshot().inserts()
        if not rows.groupBy("rid").count().filter("count > 1").isEmpty():
            raise LogError("row ids repeat")


class Snapshot:
    """The log as it was at one moment, whatever is written or compacted later (until vacuum)."""

    def __init__(self, log: Log):
        self.log, self.manifest, self.seq = log, log._m, log._seq
        self._buffer, self._deletes = tuple(log._buffer), tuple(log._deletes)

    def inserts(self, t1: int | None = None, t2: int | None = None) -> DataFrame:
        log, m = self.log, self.manifest
        rows = log._store.read(Manifest(deltas=m.deltas)) if m.deltas or not m.windows else None
        table = log._store.read_windows(m)
        if table is not None:
            origin = log.config.window_origin
            if m.window and t1 is not None and t1 > LEAST:
                table = table.filter(F.col("window_id") >= max(LEAST, (t1 - origin) // m.window))
            if m.window and t2 is not None:
                table = table.filter(F.col("window_id") <= min(MOST, (t2 - origin) // m.window))
            table = table.drop("window_id")
            rows = table if rows is None else rows.unionByName(table)
        if self._buffer:
            rows = rows.unionAll(log.spark.createDataFrame(list(self._buffer), log._schema))
        return rows

    def count(self, t1: int | None = None, t2: int | None = None) -> int:
        """Visible rows. Folders and windows that lie in the range whole, and in which no delete lies, are counted from the manifest; the others are read."""
        m, cuts = self.manifest, union(self._deletes)
        if t1 is not None and t2 is not None and t1 >= t2:
            return 0

        def known(a: int, b: int) -> bool:
            return (t1 is None or t1 <= a) and (t2 is None or b < t2) and not meets(cuts, a, b)

        def outside(a: int, b: int) -> bool:
            return (t1 is not None and b < t1) or (t2 is not None and a >= t2)

        total, deltas, windows = 0, [], []
        for name, (n, a, b, _) in zip(m.deltas, m.sizes, strict=True):
            total += n if known(a, b) else 0
            if not known(a, b) and not outside(a, b):
                deltas.append(name)
        for name, whole, entries in m.windows:
            total += sum(n for _, n, a, b in entries if known(a, b))
            rest = tuple(x for x in entries if not known(*x[2:]) and not outside(*x[2:]))
            if rest:
                windows.append((name, whole and len(rest) == len(entries), rest))
        rows = self.log._store.read(Manifest(deltas=tuple(deltas), windows=tuple(windows))) if deltas or windows else None
        if self._buffer:
            waiting = self.log.spark.createDataFrame(list(self._buffer), self.log._schema)
            rows = waiting if rows is None else rows.unionAll(waiting)
        return total if rows is None else total + visible(rows, self.delete_table(), t1, t2, self.seq).count()

    def delete_table(self) -> DataFrame:
        return self.log.spark.createDataFrame(list(self._deletes), "seq long, t1 long, t2 long")

    def frame(self, t1: int | None = None, t2: int | None = None) -> DataFrame:
        rows = self.inserts(t1, t2)
        return visible(rows, self.delete_table(), t1, t2, self.seq)

    def _rows(self, t1, t2) -> Rows:
        return Rows(self, self.frame(t1, t2), t1, t2)

    def range(self, t1, t2) -> Rows:
        t1, t2 = timestamp(t1), timestamp(t2)
        if t1 > t2:
            raise ValueError("a range must not end before it starts")
        return self._rows(t1, t2)

    def since(self, t1) -> Rows:
        return self._rows(timestamp(t1), None)

    def until(self, t2) -> Rows:
        return self._rows(None, timestamp(t2))

    def all(self) -> Rows:
        return self._rows(None, None)

    def equal(self, ts) -> Rows:
        ts = timestamp(ts)
        return Rows(self, scans.at(self.frame(ts, None), ts), ts, None)


class Rows:
    """(ts, obj) in order; len() is what remains."""

    def __init__(self, snapshot: Snapshot, frame: DataFrame, t1: int | None, t2: int | None):
        self.snapshot, self.frame, self.closed = snapshot, frame, False
        self._t1, self._t2 = t1, t2
        self._left: int | None = None
        self._rows: Iterator[Row] | None = None

    def _obj(self, row: Row):
        if self.snapshot.log._payload is None:
            return json.loads(row["payload"])
        values = tuple(row)[3:]
        return values[0] if len(values) == 1 else values

    def __iter__(self) -> Rows:
        return self

    def __next__(self) -> tuple[int, object]:
        if self.closed:
            raise StopIteration
        if self._rows is None:
            self._rows = scans.ordered(self.frame).toLocalIterator(prefetchPartitions=True)
        try:
            row = next(self._rows)
        except StopIteration:
            self.close()
            raise
        if self._left is not None:
            self._left -= 1
        return row["ts"], self._obj(row)

    def __len__(self) -> int:
        if self.closed:
            return 0
        if self._left is None:
            if self._rows is not None:
                raise LogError("ask for the length before the first row")
            self._left = self.frame.count()
        return self._left

    def next_batch(self, n: int) -> list[tuple[int, object]]:
        """Up to n rows; fewer only at the end."""
        if n < 0:
            raise ValueError("a batch can't have fewer than no rows")
        return list(itertools.islice(self, n))

    def view(self) -> list[Span]:
        return self.snapshot.log.views(LEAST if self._t1 is None else self._t1, MOST if self._t2 is None else self._t2)

    def close(self) -> None:
        self.closed, self._rows = True, None

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *error) -> None:
        self.close()


class Span:
    """Rows of one file in a range, deletes not counted: how many, first and last timestamp, and on demand their columns."""

    def __init__(self, log: Log, file: str, start_ts: int, last_ts: int, rows: int, t1: int, t2: int):
        self.log, self.file, self.start_ts, self.last_ts, self.end_ts, self._n = log, file, start_ts, last_ts, last_ts, rows
        self._t1, self._t2 = t1, t2

    def __len__(self) -> int:
        return self._n

    def frame(self) -> DataFrame:
        return self.log.spark.read.parquet(self.file).filter((F.col("ts") >= self._t1) & (F.col("ts") < self._t2))

    @property
    def timestamps(self):
        """A 64-bit integer column of Arrow, in order; its buffer is read-only."""
        return self.frame().select("ts").orderBy("ts").toArrow().column("ts")

    def copy_timestamps(self) -> list[int]:
        return self.timestamps.to_pylist()

    def objects(self) -> list:
        """Payloads in order of timestamp."""
        rows = self.frame().orderBy("ts", "seq", "rid").drop("window_id").collect()
        return [json.loads(r["payload"]) if self.log._payload is None else r[3] if len(r) == 4 else tuple(r)[3:] for r in rows]
