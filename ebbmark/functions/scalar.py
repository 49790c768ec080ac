"""Scalar expressions over 64-bit timestamps. None of them can overflow unnoticed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The ends of the timestamp range, both legal data, and ticks of a second in each unit.
LEAST, MOST = -(2**63), 2**63 - 1
TICKS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def micros(name: str) -> Column:
    """A timestamp column as 64-bit microseconds since 1970. One without zone is read as UTC, whatever the session's zone is."""
    session = SparkSession.getActiveSession()
    if session is None or session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.expr(f"(unix_date(CAST({name} AS DATE)) * 86400L + hour({name}) * 3600L + minute({name}) * 60L) * 1000000L + CAST(extract(SECOND FROM {name}) * 1000000 AS BIGINT)")


def ntz(ts: int) -> str:
    """Microseconds as a literal of a timestamp without zone, for filters that reach the reader of such a column."""
    return f"TIMESTAMP_NTZ '{datetime(1970, 1, 1) + timedelta(microseconds=ts)}'"


def floor_div(name: str, b: int) -> Column:
    """Whole part of column / b, towards minus infinity, for b > 0, without leaving 64-bit integers. name: a column or SQL expression."""
    return F.expr(f"CASE WHEN ({name}) % {b}L <> 0L AND ({name}) < 0L THEN ({name}) div {b}L - 1L ELSE ({name}) div {b}L END")


def checked(operation: str, a: Column | str, b: Column | str) -> Column:
    """add, subtract or multiply; null where 64 bits don't suffice."""
    return {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[operation](a, b)


def window_id(name: str, size: int, origin: int = 0) -> Column:
    """The window of a timestamp: floor((ts - origin) / size); an error where ts - origin doesn't fit."""
    if size <= 0:
        raise ValueError("a window's size must be positive")
    if not origin:
        return floor_div(name, size)
    shifted = f"try_subtract({name}, {origin}L)"
    return F.expr(f"CASE WHEN {shifted} IS NULL THEN raise_error('timestamp minus window origin overflows') ELSE CASE WHEN {shifted} % {size}L <> 0L AND {shifted} < 0L THEN {shifted} div {size}L - 1L ELSE {shifted} div {size}L END END").cast("long")


def window_start(window: str, size: int, origin: int = 0) -> Column:
    """The first timestamp of a window; where it lies below the range, the least one."""
    wide = f"CAST({window} AS DECIMAL(38,0)) * {size} + {origin}"
    return F.expr(f"CAST(greatest(least({wide}, CAST({MOST} AS DECIMAL(38,0))), CAST(-9223372036854775808 AS DECIMAL(38,0))) AS BIGINT)")


def window_end(window: str, size: int, origin: int = 0) -> Column:
    """The timestamp behind a window's last; null where the window reaches over the end of the range, so that it has no end."""
    wide = f"(CAST({window} AS DECIMAL(38,0)) + 1) * {size} + {origin}"
    return F.expr(f"CASE WHEN {wide} <= CAST({MOST} AS DECIMAL(38,0)) THEN CAST({wide} AS BIGINT) END")


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether half-open ranges share a timestamp; a null end is open."""
    return (b2.isNull() | (a1 < b2)) & (a2.isNull() | (b1 < a2)) & (a2.isNull() | (a1 < a2)) & (b2.isNull() | (b1 < b2))


def covers(t1: Column, t2: Column, ts: Column) -> Column:
    """Whether [t1, t2) holds ts; a null end is open."""
    return (ts >= t1) & (t2.isNull() | (ts < t2))


def payload_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names; equal for equal payloads."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
