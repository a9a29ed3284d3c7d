"""Read functions of the service layer: routing, limits, pages, look-ups."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import pct, usable

from . import views


class NotFound(LookupError):
    """No sensor or machine of that reference."""


class InvalidTimeRange(ValueError):
    """A window that is empty, backwards or too long."""


def choose_resolution(start: datetime, end: datetime, asked: str = "auto") -> str:
    """raw up to 6 hours, hourly up to 30 days (both inclusive), else daily."""
    if asked != "auto":
        if asked not in ("raw", "hourly", "daily"):
            raise ValueError(f"unknown resolution {asked}")
        return asked
    span = end - start
    return "raw" if span <= timedelta(hours=C.RAW_MAX_HOURS) else "hourly" if span <= timedelta(days=C.HOURLY_MAX_DAYS) else "daily"


def resolve_window(start: datetime | None, end: datetime | None, archive_end: datetime, default_days: int = C.READINGS_DEFAULT_DAYS) -> tuple[datetime, datetime]:
    """A half-open window; defaults hang on the end of the archive, never on the clock."""
    end = end or archive_end
    start = start or end - timedelta(days=default_days)
    if start >= end:
        raise InvalidTimeRange("start must be before end")
    if end - start > timedelta(days=C.MAX_WINDOW_DAYS):
        raise InvalidTimeRange(f"window longer than {C.MAX_WINDOW_DAYS} days")
    return start, end


def optional(df: DataFrame, **wanted: Any) -> DataFrame:
    """Equality filters; those that are None are left out.  ``start``/``end`` bound ``reading_ts`` half-open."""
    for k, v in wanted.items():
        if v is None:
            continue
        if k == "start":
            df = df.where(F.col("reading_ts") >= F.lit(v).cast("timestamp_ntz"))
        elif k == "end":
            df = df.where(F.col("reading_ts") < F.lit(v).cast("timestamp_ntz"))
        else:
            df = df.where(F.col(k) == v)
    return df


@dataclass
class Series:
    """At most ``limit`` points in time order, and whether there are more."""

    rows: DataFrame
    limit: int
    _one_more: DataFrame

    @property
    def truncated(self) -> bool:
        return self._one_more.count() > self.limit


def _first(points: DataFrame, limit: int) -> Series:
    inorder = points.orderBy("timestamp")
    return Series(inorder.limit(limit), limit, points.limit(limit + 1))


def raw_series(readings: DataFrame, quality: DataFrame, sensor_id: int, start, end, limit: int = C.MAX_POINTS) -> Series:
    r = optional(readings, sensor_id=sensor_id, start=start, end=end).join(quality.select("quality_code_id", "code"), "quality_code_id")
    return _first(r.select(F.col("reading_ts").alias("timestamp"), "value", F.col("code").alias("quality"), usable(F.col("quality_code_id")).alias("quality_usable")), limit)


def bucket_series(rollup: DataFrame, bucket: str, sensor_id: int, start, end, per_bucket: float, limit: int = C.MAX_POINTS) -> Series:
    t = F.col(bucket).cast("timestamp_ntz")
    d = rollup.where((F.col("sensor_id") == sensor_id) & (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
    return _first(d.select(t.alias("timestamp"), F.col("avg_value").alias("value"), "min_value", "max_value", "sample_count", F.round(pct(F.col("sample_count"), F.lit(per_bucket)), 1).alias("coverage_pct")), limit)


def several(read: Callable[[int], DataFrame], references: str, ids: dict[str, int], most: int = C.MAX_SENSORS) -> DataFrame:
    """Series of the first ``most`` sensors of a comma-separated list."""
    out = None
    for ref in [r.strip() for r in references.split(",") if r.strip()][:most]:
        d = read(ids[ref]).withColumn("sensor_code", F.lit(ref))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise NotFound("no sensor named")
    return out


def severity_rank(severity="severity"):
    return F.when(F.col(severity) == "CRITICAL", 0).when(F.col(severity) == "WARNING", 1).otherwise(2)


#: An instant may hold an anomaly of each state of each sensor.
_TIES = ("sensor_id", "method", "operating_state")


def ranked_anomalies(anomalies: DataFrame, limit: int = 200) -> DataFrame:
    """Worst first, then highest score, then newest."""
    return anomalies.orderBy(severity_rank(), F.desc("score"), F.desc("reading_ts"), *_TIES).limit(limit)


@dataclass
class Page:
    """One page, and the one-row frame ``total`` of how many rows the filters leave."""

    rows: DataFrame
    total: DataFrame


def anomaly_page(anomalies: DataFrame, limit: int, offset: int, **wanted: Any) -> Page:
    """A page in the order severity, newest first, with full tie-breaks."""
    d = optional(anomalies, **wanted)
    return Page(d.orderBy(severity_rank(), F.desc("reading_ts"), *_TIES).offset(offset).limit(limit), d.agg(F.count(F.lit(1)).alias("total")))


ANOMALY_ORDER = (("severity_order", False), ("reading_ts", True), ("sensor_id", False), ("method", False), ("operating_state", False))


def _keys(order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def stored_in_order(rows: DataFrame, order, path: str) -> DataFrame:
    """``rows`` written in ``order``, pairs of (column, descending): ranges of the order are
    files, sorted inside, so that a page touches the row groups it is in and no others."""
    rows.repartitionByRange(*_keys(order)).sortWithinPartitions(*_keys(order)).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _beyond(column: str, down: bool, value: Any) -> Column:
    """Rows whose key comes after ``value``: null is last in descending order, first in ascending."""
    c = F.col(column)
    if value is None:
        return F.lit(False) if down else c.isNotNull()
    return (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)


def _from(column: str, down: bool, value: Any) -> Column:
    """Rows whose key is ``value`` or comes after it."""
    c = F.col(column)
    if value is None:
        return c.isNull() if down else F.lit(True)
    return (c <= F.lit(value)) | c.isNull() if down else c >= F.lit(value)


def keyset_page(stored: DataFrame, order, limit: int, after: dict[str, Any] | None = None) -> DataFrame:
    """The next ``limit`` rows after the key ``after`` (``cursor_of`` the page before; None: the
    first page).  No row before the page is sorted or counted: the first key's bound reaches
    the scan, and of the rest each task keeps ``limit`` rows.  ``order`` has to be unique."""
    d = stored
    if after is not None:
        first, down = order[0]
        level, found = F.lit(True), F.lit(False)
        for c, falls in order:
            found = found | (level & _beyond(c, falls, after[c]))
            level = level & F.col(c).eqNullSafe(F.lit(after[c]))
        # the first key's bound by itself as well, as a scan takes simple bounds only
        d = d.where(_from(first, down, after[first])).where(found)
    return d.orderBy(*_keys(order)).limit(limit)


def cursor_of(page: list, order) -> dict[str, Any] | None:
    """The key of a page's last row, None for an empty page."""
    return {c: page[-1][c] for c, _ in order} if page else None


def ordered_anomalies(anomalies: DataFrame, path: str) -> DataFrame:
    """Anomalies stored in the order of ``anomaly_page``, for ``keyset_page`` with ANOMALY_ORDER."""
    return stored_in_order(anomalies.withColumn("severity_order", severity_rank()), ANOMALY_ORDER, path)


def active_anomalies(anomalies: DataFrame, archive_end: DataFrame, limit: int = 50, hours: int = C.ACTIVE_HOURS) -> DataFrame:
    d = anomalies.crossJoin(archive_end.select("last_ts")).where(F.col("reading_ts") >= F.col("last_ts") - F.make_dt_interval(F.lit(0), F.lit(hours))).drop("last_ts")
    return d.orderBy(severity_rank(), F.desc("score"), "reading_ts", *_TIES).limit(limit)


def resolve_sensor(sensors: DataFrame, reference: str) -> tuple[int, str]:
    """(id, code) by number or by code in any case."""
    ref = reference.strip()
    match = F.col("sensor_id") == int(ref) if ref.isdigit() else F.upper("sensor_code") == ref.upper()
    row = sensors.where(match).select("sensor_id", "sensor_code").first()
    if row is None:
        raise NotFound(f"sensor {reference}")
    return row[0], row[1]


def equipment_list(equipment: DataFrame, sensors: DataFrame) -> DataFrame:
    n = sensors.where("is_active").groupBy("equipment_id").agg(F.count(F.lit(1)).alias("sensor_count"))
    return equipment.join(n, "equipment_id", "left").withColumn("sensor_count", F.coalesce("sensor_count", F.lit(0)))


def summary(most: int = 1000, **parts: DataFrame) -> dict[str, list[dict]]:
    """Small result frames as lists of dictionaries, for one answer to a start page;
    raises if a part has over ``most`` rows."""
    out = {}
    for k, d in parts.items():
        rows = d.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{k}: more than {most} rows")
        out[k] = [r.asDict() for r in rows]
    return out


def overview(equipment: DataFrame, sensors: DataFrame, readings: DataFrame, quality: DataFrame, anomalies: DataFrame, failures: DataFrame, archive_quality: DataFrame, pressure_id: int, limit: int = 50) -> dict[str, list[dict]]:
    """All that a start page shows in one answer: bounds and counts of the archive, health
    per machine, latest readings, active anomalies, failures, quality."""
    bounds = views.bounds(readings)
    return summary(
        archive=bounds,
        counts=equipment.agg(F.count(F.lit(1)).alias("equipment_count")).crossJoin(sensors.where("is_active").agg(F.count(F.lit(1)).alias("sensor_count"))),
        equipment=views.equipment_health(equipment, sensors, readings, anomalies, failures),
        latest_readings=views.latest_readings(readings, sensors, quality, equipment),
        active_anomalies=active_anomalies(anomalies, bounds, limit),
        recent_failures=views.failure_context(failures, readings, pressure_id).orderBy(F.desc("start_ts")),
        data_quality=archive_quality,
    )


class TimedCache:
    """One value kept for some seconds."""

    def __init__(self, seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._at, self._value = seconds, clock, None, None

    def get(self, make: Callable[[], Any]) -> Any:
        now = self.clock()
        if self._at is None or now - self._at >= self.seconds:
            self._value, self._at = make(), now
        return self._value


def health_checks(tables: dict[str, DataFrame], ledger: DataFrame, required: list[str], now: datetime, stuck_hours: float = 24, max_age_hours: float | None = None) -> list[tuple[str, str]]:
    """(check, state) of required tables, stuck runs, stored baselines and, with
    ``max_age_hours``, the age of the newest reading."""
    out = [(f"table {t}", "OK" if t in tables else "MISSING") for t in required]
    old = ledger.where(F.col("status") == "RUNNING").where(F.col("started_utc") < F.lit(now - timedelta(hours=stuck_hours)).cast("timestamp_ntz")).count()
    out.append(("stuck runs", "OK" if not old else f"{old} STUCK"))
    out.append(("baselines", "OK" if "baseline" in tables and not tables["baseline"].isEmpty() else "NONE"))
    if max_age_hours is not None:
        newest = tables["readings"].agg(F.max("reading_ts")).first()[0] if "readings" in tables else None
        hours = None if newest is None else (now - newest).total_seconds() / 3600
        out.append(("newest reading", "NONE" if hours is None else "OK" if hours <= max_age_hours else f"{hours:.1f} HOURS OLD"))
    return out
