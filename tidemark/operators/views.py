"""Named views over the archive: health, extremes, abnormal buckets, quality, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import minutes_between, pct, seconds_between, status_reason, usable

from .analysis import inside_windows, lead_up_windows
from .rollup import latest


def bounds(readings: DataFrame) -> DataFrame:
    """One row: first and last instant and count of the archive.  "Now" is always the last one."""
    return readings.agg(F.min("reading_ts").alias("first_ts"), F.max("reading_ts").alias("last_ts"), F.count(F.lit(1)).alias("total"))


def latest_readings(readings: DataFrame, sensors: DataFrame, quality: DataFrame, equipment: DataFrame) -> DataFrame:
    """The current value of every active sensor that has one, and how far it lags."""
    new = latest(readings).crossJoin(bounds(readings).select("last_ts"))
    d = new.join(sensors.where("is_active"), "sensor_id").join(equipment, "equipment_id").join(quality, "quality_code_id")
    return d.select("equipment_id", "equipment_code", "sensor_id", "sensor_code", "sensor_class", "unit", "display_order", F.col("reading_ts").alias("last_reading_ts"), F.col("value").alias("last_value"), F.col("code").alias("quality_code"), F.col("is_usable").alias("quality_is_usable"), seconds_between(F.col("reading_ts"), F.col("last_ts")).alias("seconds_behind_archive"))


def with_coverage(rollup: DataFrame, sensors: DataFrame, per_bucket: float) -> DataFrame:
    """A rollup with sensor names, coverage and share of usable readings."""
    return rollup.join(sensors.select("sensor_id", "sensor_code", "unit"), "sensor_id").withColumns({"coverage_pct": pct(F.col("sample_count"), F.lit(per_bucket)), "good_pct": pct(F.col("good_count"), F.col("sample_count"))})


def extremes(daily: DataFrame, sensors: DataFrame) -> DataFrame:
    """Lifetime extremes from daily ones, and the first day of each."""
    lo = F.min(F.struct("min_value", "bucket_date"))
    hi = F.max(F.struct("max_value", F.datediff(F.lit("1970-01-01").cast("date"), "bucket_date").alias("d")))
    d = daily.groupBy("sensor_id").agg(lo.alias("lo"), hi.alias("hi"), F.min("bucket_date").alias("first_date"), F.max("bucket_date").alias("last_date"), F.sum("sample_count").alias("total_samples"))
    d = d.join(sensors.where("is_active").select("sensor_id", "sensor_code"), "sensor_id")
    return d.select("sensor_id", "sensor_code", F.col("lo.min_value").alias("min_value"), F.col("hi.max_value").alias("max_value"), (F.col("hi.max_value") - F.col("lo.min_value")).alias("value_range"), "first_date", "last_date", "total_samples", F.col("lo.bucket_date").alias("min_value_date"), F.date_sub(F.lit("1970-01-01").cast("date"), F.col("hi.d")).alias("max_value_date"))


def rolling(hourly: DataFrame) -> DataFrame:
    """Mean and deviation over the last 24 rows (not hours), change from the row before."""
    by = Window.partitionBy("sensor_id").orderBy("bucket_start")
    w = by.rowsBetween(-23, 0)
    return hourly.select("sensor_id", "bucket_start", "avg_value", "sample_count", F.avg("avg_value").over(w).alias("rolling_24h_mean"), F.stddev_samp("avg_value").over(w).alias("rolling_24h_stddev"), (F.col("avg_value") - F.lag("avg_value").over(by)).alias("rate_of_change_per_hour"), F.count(F.lit(1)).over(w).alias("window_bucket_count"))


def abnormal(hourly_state: DataFrame, base: DataFrame) -> DataFrame:
    """Hourly state buckets outside their baseline's fences, with a plain z-score.

    Several baselines for a sensor and state give several rows.
    """
    b = base.where("p75 - p25 > 0").select("sensor_id", "operating_state", "baseline_name", F.col("iqr_lower_fence").alias("expected_low"), F.col("iqr_upper_fence").alias("expected_high"), "mean_value", F.col("stddev_value").alias("sd"))
    d = hourly_state.join(b, ["sensor_id", "operating_state"]).where("avg_value < expected_low or avg_value > expected_high")
    z = F.when(F.col("sd") > 0, F.abs(F.col("avg_value") - F.col("mean_value")) / F.col("sd"))
    over = F.when(F.col("avg_value") < F.col("expected_low"), F.col("expected_low") - F.col("avg_value")).otherwise(F.col("avg_value") - F.col("expected_high"))
    return d.select("sensor_id", "bucket_start", "operating_state", "avg_value", "sample_count", "baseline_name", "expected_low", "expected_high", over.alias("exceedance_amount"), z.alias("z_score"), F.when(z >= 5, "CRITICAL").when(z >= 3, "WARNING").otherwise("NORMAL").alias("severity"))


def equipment_health(equipment: DataFrame, sensors: DataFrame, readings: DataFrame, anomalies: DataFrame, failures: DataFrame, hours: int = C.ACTIVE_HOURS) -> DataFrame:
    """One row per machine: worst recent severity and the counts behind it."""
    s = sensors.where("is_active")
    of = s.select("sensor_id", "equipment_id")
    counts = s.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("sensor_count"))
    # one row per sensor before the join, so that readings are not joined at all
    per_sensor = readings.groupBy("sensor_id").agg(F.max("reading_ts").alias("t"), F.count(F.lit(1)).alias("n"))
    archive = per_sensor.join(of, "sensor_id").groupBy("equipment_id").agg(F.max("t").alias("last_reading_ts"), F.sum("n").alias("total_readings"))
    recent = anomalies.select("sensor_id", "reading_ts", "severity").join(of, "sensor_id").join(archive.select("equipment_id", "last_reading_ts"), "equipment_id")
    recent = recent.where(F.col("reading_ts") >= F.col("last_reading_ts") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    recent = recent.groupBy("equipment_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "WARNING").alias("w"))
    fails = failures.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("f"))
    d = equipment.join(counts, "equipment_id", "left").join(archive, "equipment_id", "left").join(recent, "equipment_id", "left").join(fails, "equipment_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    status = F.when(F.col("last_reading_ts").isNull(), "NO DATA").when(n("c") > 0, "CRITICAL").when(n("w") > 0, "WARNING").otherwise("NORMAL")
    return d.select("equipment_id", "equipment_code", "equipment_name", n("sensor_count").alias("sensor_count"), "last_reading_ts", n("total_readings").alias("total_readings"), n("c").alias("critical_anomalies"), n("w").alias("warning_anomalies"), n("f").alias("recorded_failures"), status.alias("health_status"), status_reason(status, n("c"), n("w"), hours).alias("status_reason"))


def quality_summary(ledger: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue counts per run: totals from summary rows, events from detail rows, never added."""
    keys = ["run_id", "source_file", "status", "rows_read", "issue_type", "severity"]
    d = ledger.join(issues, "run_id", "left").groupBy(*keys)
    return d.agg(F.sum(F.when(F.col("is_summary"), F.col("affected_rows")).otherwise(0)).alias("affected_rows"), F.sum(F.when(~F.col("is_summary"), 1).otherwise(0)).alias("detail_rows"))


def issue_summary(ledger: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue totals of the newest run that succeeded in full, types with none left out."""
    run = ledger.where("status = 'SUCCEEDED'").agg(F.max("run_id").alias("run_id"))
    d = issues.where("is_summary").join(run, "run_id", "left_semi").groupBy("issue_type", "severity").agg(F.sum("affected_rows").alias("affected_rows"))
    return d.where("affected_rows > 0")


def timestamp_gaps(issues: DataFrame, ledger: DataFrame) -> DataFrame:
    """Gap details of the newest run that succeeded in full."""
    run = ledger.where("status = 'SUCCEEDED'").agg(F.max("run_id").alias("run_id"))
    d = issues.where("issue_type = 'GAP' and not is_summary and window_start is not null").join(run, "run_id", "left_semi")
    return d.select("run_id", F.col("window_start").alias("gap_start"), F.col("window_end").alias("gap_end"), F.col("observed_value").alias("gap_seconds"), (F.col("observed_value") / 3600.0).alias("gap_hours"), F.col("affected_rows").alias("estimated_missing_scans"))


def failure_context(failures: DataFrame, readings: DataFrame, sensor_id: int, hours: int = 24) -> DataFrame:
    """Failures with the held share of the day before; none is a reason not to analyse."""
    w = lead_up_windows(failures, (hours,))
    r = readings.where(F.col("sensor_id") == sensor_id)
    d = inside_windows(r, w, "reading_ts").groupBy("failure_event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality_code_id") == C.STALE).alias("s"))
    d = failures.join(d, "failure_event_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0))})
    stale = pct(F.col("s"), F.col("n"))
    use = F.when(F.col("n") == 0, "NO DATA").when(stale > 25, "UNUSABLE").otherwise("USABLE")
    return d.select("failure_event_id", "source_reference", "start_ts", "end_ts", "failure_type", "severity", minutes_between(F.col("start_ts"), F.col("end_ts")).alias("duration_minutes"), F.col("n").alias("lead_up_24h_scans"), F.col("s").alias("lead_up_24h_stale_scans"), stale.alias("lead_up_24h_stale_pct"), use.alias("lead_up_usability"))


def quality_pivot(readings: DataFrame, quality: DataFrame, by: list[str]) -> DataFrame:
    """Readings per quality code as columns (0 where none), and the held share."""
    names = {"GOOD": "good", "UNCERTAIN_STALE": "held_value", "UNCERTAIN_RANGE": "out_of_baseline", "BAD_RANGE": "impossible", "BAD_DIGITAL": "non_binary", "BAD_MISSING": "missing"}
    d = readings.join(quality.select("quality_code_id", "code"), "quality_code_id").groupBy(*by).pivot("code", list(names)).count()
    d = d.select(*by, *[F.coalesce(F.col(k), F.lit(0)).alias(v) for k, v in names.items()])
    return d.withColumn("held_pct", pct(F.col("held_value"), sum((F.col(v) for v in names.values()), F.lit(0))))


def quality_distribution(readings: DataFrame, quality: DataFrame) -> DataFrame:
    d = readings.groupBy("quality_code_id").agg(F.count(F.lit(1)).alias("readings")).join(quality.select("quality_code_id", "code"), "quality_code_id")
    return d.select("code", "readings", pct(F.col("readings"), F.sum("readings").over(Window.partitionBy())).alias("pct_of_total"))


def sensor_quality(readings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return readings.groupBy("sensor_id").agg(n.alias("readings"), pct(F.count_if(F.col("quality_code_id") == C.GOOD), n).alias("good_pct"), pct(F.count_if(F.col("quality_code_id") == C.STALE), n).alias("stale_pct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def archive_quality(readings: DataFrame, rejects: DataFrame, gaps: DataFrame, scan_count: DataFrame, scan_seconds: float = C.SCAN_SECONDS) -> DataFrame:
    """One row: totals, shares, quarantined lines, gaps, and scans against what the span
    should hold.  ``scan_count`` has one row and column ``scans``."""
    n = F.count(F.lit(1))
    good, held = F.count_if(F.col("quality_code_id") == C.GOOD), F.count_if(F.col("quality_code_id") == C.STALE)
    t = readings.agg(n.alias("total_readings"), good.alias("good_readings"), held.alias("held_readings"), F.coalesce(pct(good, n), F.lit(0.0)).alias("good_pct"), F.coalesce(pct(held, n), F.lit(0.0)).alias("held_pct"), F.min("reading_ts").alias("a"), F.max("reading_ts").alias("z"))
    t = t.crossJoin(rejects.agg(n.alias("quarantined_rows"))).crossJoin(gaps.agg(n.alias("gap_count"))).crossJoin(scan_count)
    span = (F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6
    return t.withColumn("coverage_pct", F.coalesce(100.0 * F.col("scans") / (span / scan_seconds + 1), F.lit(0.0))).drop("a", "z", "scans")


def top_sensors(anomalies: DataFrame, sensors: DataFrame, archive: DataFrame, days: int, top: int = 5) -> DataFrame:
    """The sensors with the most anomalies in the last ``days`` of the archive (``bounds``)."""
    recent = anomalies.crossJoin(archive.select("last_ts")).where(F.col("reading_ts") >= F.col("last_ts") - F.make_dt_interval(F.lit(days)))
    n = recent.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("anomalies"))
    return n.join(sensors.select("sensor_id", "sensor_code"), "sensor_id").select("sensor_code", "anomalies").orderBy(F.desc("anomalies"), "sensor_code").limit(top)


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason_code").agg(F.count(F.lit(1)).alias("rows"))


def equal_counts(readings: DataFrame) -> DataFrame:
    """One row: how many different reading counts sensors have; a scan archive without
    missing cells has one."""
    n = readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("sensors"), F.countDistinct("n").alias("distinct_counts")).withColumn("verdict", F.when(F.col("distinct_counts") == 1, "OK").otherwise("WARNING"))
