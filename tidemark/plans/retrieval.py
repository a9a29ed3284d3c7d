"""Queries on the event archive: retrieval, rollups, views, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import block_of, day_of, operating_state, pct, seconds_between, trusted, usable
from tidemark.operators import analysis, incremental, ordered, quantiles, rollup, serve, views
from tidemark.sources import adapters as A
from tidemark.sources.archive import built

from . import base as B
from .base import FROM, TO, between, sql, tidy
from .registry import ORACLES, query

R = B.READINGS
_HOURLY = f""",
h AS (SELECT sensor_id, date_trunc('hour', reading_ts)::TIMESTAMP AS bucket_start, count(*) AS sample_count, count(*) FILTER (WHERE q >= 64) AS good_count, min(value) AS min_value, max(value) AS max_value,
 avg(value) AS avg_value, stddev_samp(value) AS stddev_value, arg_min(value, reading_ts) AS first_value, arg_max(value, reading_ts) AS last_value FROM r GROUP BY 1, 2),
wt AS (SELECT *, least(coalesce(date_diff('second', reading_ts, lead(reading_ts) OVER (PARTITION BY sensor_id ORDER BY reading_ts)), {B.USUAL}), {B.MOST}) AS w FROM r),
tw AS (SELECT sensor_id, date_trunc('hour', reading_ts)::TIMESTAMP AS bucket_start, sum(value * w) / nullif(sum(w), 0) AS time_weighted_avg FROM wt GROUP BY 1, 2)"""
_DAILY = """,
dd AS (SELECT sensor_id, reading_ts::DATE AS bucket_date, count(*) AS sample_count, count(*) FILTER (WHERE q >= 64) AS good_count, min(value) AS min_value, max(value) AS max_value,
 avg(value) AS avg_value, stddev_samp(value) AS stddev_value, arg_min(value, reading_ts) AS first_value, arg_max(value, reading_ts) AS last_value FROM r GROUP BY 1, 2)"""
_STATS = "min_value max_value avg_value stddev_value first_value last_value"
_DATE = "strftime(bucket_date, '%Y-%m-%d') AS bucket_date"


@query(sql(R, f"SELECT reading_ts, sensor_code, value, code AS quality, is_usable FROM r JOIN quality ON q = quality_code_id WHERE sensor_code = 'click' AND reading_ts >= '{FROM}' AND reading_ts < '{TO}'", "value"))
def q01_time_window(spark, sf):
    r = between(A.readings(spark, sf, "click")).join(A.sensors(spark), "sensor_id").join(A.quality_codes(spark), "quality_code_id")
    return tidy(r.select("reading_ts", "sensor_code", "value", F.col("code").alias("quality"), "is_usable"))


@query(sql(R + _HOURLY, f"SELECT bucket_start, sample_count, 100.0 * sample_count / {B.PER_HOUR} AS coverage_pct, good_count AS usable_count, min_value, avg_value, max_value, stddev_value FROM h WHERE sensor_id = 3 AND bucket_start >= '{FROM}' AND bucket_start < '{TO}'", "coverage_pct min_value avg_value max_value stddev_value"))
def q02_hourly_coverage(spark, sf):
    r = between(A.readings(spark, sf, "purchase"))
    return tidy(rollup.hourly_coverage(r, B.PER_HOUR).drop("sensor_id"))


@query(sql(R + _DAILY, "SELECT strftime(bucket_date, '%Y-%m-%d') AS bucket_date, avg_value, p AS prev_avg_value, avg_value - p AS delta, 100.0 * (avg_value - p) / nullif(abs(p), 0) AS pct_change, sample_count, t AS trailing_mean_7d FROM (SELECT *, lag(avg_value) OVER (ORDER BY bucket_date) AS p, avg(avg_value) OVER (ORDER BY bucket_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t FROM dd WHERE sensor_id = 3)", "avg_value prev_avg_value delta pct_change trailing_mean_7d"))
def q03_daily_trend_lag(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("sensor_id").orderBy("bucket_date")
    d = rollup.rollup(A.readings(spark, sf, "purchase"), "day")
    d = d.withColumn("prev_avg_value", F.lag("avg_value").over(w)).withColumn("trailing_mean_7d", F.avg("avg_value").over(w.rowsBetween(-6, 0)))
    delta = F.col("avg_value") - F.col("prev_avg_value")
    return tidy(d.select("bucket_date", "avg_value", "prev_avg_value", delta.alias("delta"), (100.0 * F.try_divide(delta, F.abs("prev_avg_value"))).alias("pct_change"), "sample_count", "trailing_mean_7d"))


@query(sql(R, "SELECT s.sensor_code, reading_ts AS last_reading_ts, value AS last_value, q AS quality_code_id FROM sensor s, LATERAL (SELECT reading_ts, value, q FROM r WHERE r.sensor_id = s.sensor_id ORDER BY reading_ts DESC LIMIT 1)", "last_value"))
def q06_latest_apply(spark, sf):
    d = rollup.latest(A.readings(spark, sf)).join(A.sensors(spark), "sensor_id")
    return tidy(d.select("sensor_code", F.col("reading_ts").alias("last_reading_ts"), F.col("value").alias("last_value"), "quality_code_id"))


@query(sql(R, "SELECT sensor_code, reading_ts AS last_reading_ts, value AS last_value, q AS quality_code_id FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY reading_ts DESC) AS k FROM r) WHERE k = 1", "last_value"))
def q06_latest_row_number(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("sensor_id").orderBy(F.desc("reading_ts"))
    d = A.readings(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").join(A.sensors(spark), "sensor_id")
    return tidy(d.select("sensor_code", F.col("reading_ts").alias("last_reading_ts"), F.col("value").alias("last_value"), "quality_code_id"))


@query(sql(R, "SELECT sensor_id, strftime(reading_ts::DATE, '%Y-%m-%d') AS bucket_date, count(*) AS sample_count, min(value) AS min_value, avg(value) AS avg_value, max(value) AS max_value, quantile_cont(value, 0.5) AS median_value, quantile_cont(value, 0.95) AS p95_value FROM r WHERE q >= 64 GROUP BY ALL", "min_value avg_value max_value median_value p95_value"))
def q07_daily_median(spark, sf):
    return tidy(rollup.daily_distribution(A.readings(spark, sf).where(usable(F.col("quality_code_id")))))


@query(ORACLES["q07_daily_median"])
def q07_daily_median_selected(spark, sf):
    """The same by selection, which holds no day of a sensor in one task."""
    return tidy(rollup.daily_distribution(A.readings(spark, sf).where(usable(F.col("quality_code_id"))), selected=True))


def _partials(spark, sf):
    return built(spark, sf, "partials", lambda: incremental.partials(A.readings(spark, sf), B.USUAL, B.MOST))


_QUARTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(sql(R, f"SELECT sensor_id, strftime(date_trunc('month', reading_ts)::DATE, '%Y-%m-%d') AS month, count(*) AS n, prob, true AS within FROM r, (SELECT unnest({[f'{p}' for p in _QUARTILES]})::DOUBLE AS prob) GROUP BY ALL", "prob"))
def sketch_quantiles(spark, sf):
    """Quantiles of months out of the hours' stored sketches: whether each one's true rank is
    within 1 % of the rows of the one asked."""
    month = F.date_trunc("month", "bucket_start").cast("date")
    found = quantiles.merged_quantiles(_partials(spark, sf).withColumn("month", month), ["sensor_id", "month"], _QUARTILES)
    rows = A.readings(spark, sf).withColumn("month", F.date_trunc("month", "reading_ts").cast("date"))
    d = quantiles.rank_errors(rows, ["sensor_id", "month"], "value", found, _QUARTILES)
    return tidy(d.select("sensor_id", "month", "n", "prob", (F.col("error") <= 0.01).alias("within")))


_GAPS = f"""SELECT sensor_id, prev AS gap_start, reading_ts AS gap_end, gap_seconds FROM (SELECT *, date_diff('second', prev, reading_ts) AS gap_seconds FROM (
 SELECT *, lag(reading_ts) OVER (PARTITION BY sensor_id ORDER BY reading_ts) AS prev FROM r)) WHERE gap_seconds > {B.GAP}"""


def _gaps(spark, sf):
    d = A.readings(spark, sf).withColumn("_block", block_of(F.col("reading_ts")))
    d = ordered.lagged(d, ["sensor_id"], "_block", ["reading_ts"], {"gap_start": "reading_ts"})
    return d.select("sensor_id", "gap_start", F.col("reading_ts").alias("gap_end"), seconds_between(F.col("gap_start"), F.col("reading_ts")).alias("gap_seconds")).where(F.col("gap_seconds") > B.GAP)


@query(sql(R, _GAPS))
def q08_gaps(spark, sf):
    return tidy(_gaps(spark, sf))


@query(sql(R, _GAPS + " ORDER BY gap_seconds DESC, sensor_id, gap_end LIMIT 10"))
def top_gaps(spark, sf):
    return tidy(_gaps(spark, sf).orderBy(F.desc("gap_seconds"), "sensor_id", "gap_end").limit(10))


@query(sql(R, f"SELECT sensor_code, strftime(d, '%Y-%m-%d') AS bucket_date, good, held_value, out_of_baseline, impossible, non_binary, missing, 100.0 * held_value / nullif(good + held_value + out_of_baseline + impossible + non_binary + missing, 0) AS held_pct FROM (SELECT sensor_code, reading_ts::DATE AS d, count(*) FILTER (WHERE q = 192) AS good, count(*) FILTER (WHERE q = 65) AS held_value, count(*) FILTER (WHERE q = 64) AS out_of_baseline, count(*) FILTER (WHERE q = 8) AS impossible, count(*) FILTER (WHERE q = 16) AS non_binary, count(*) FILTER (WHERE q = 0) AS missing FROM r WHERE reading_ts >= '{FROM}' AND reading_ts < '{TO}' GROUP BY ALL)", "held_pct"))
def q09_quality_pivot(spark, sf):
    r = between(A.readings(spark, sf)).join(A.sensors(spark).select("sensor_id", "sensor_code"), "sensor_id").withColumn("bucket_date", day_of(F.col("reading_ts")))
    return tidy(views.quality_pivot(r, A.quality_codes(spark), ["sensor_code", "bucket_date"]))


@query(sql(R, f"""SELECT source_reference, start_ts, hours, total_scans, held_scans, 100.0 * usable_scans / total_scans AS usable_pct,
 CASE WHEN 100.0 * usable_scans / total_scans >= 50 THEN m END AS lead_up_mean, usable_max, bm AS baseline_mean, CASE WHEN 100.0 * usable_scans / total_scans >= 50 THEN (m - bm) / nullif(bs, 0) END AS z_vs_baseline,
 CASE WHEN 100.0 * usable_scans / total_scans < 50 THEN 'INSUFFICIENT DATA' ELSE 'COMPARABLE' END AS verdict
 FROM (SELECT source_reference, start_ts, hours::BIGINT AS hours, count(*) AS total_scans, count(*) FILTER (WHERE q = 65) AS held_scans, count(*) FILTER (WHERE q >= 64 AND q <> 65) AS usable_scans,
  avg(value) FILTER (WHERE q >= 64 AND q <> 65) AS m, max(value) FILTER (WHERE q >= 64 AND q <> 65) AS usable_max
  FROM failure CROSS JOIN (VALUES (24), (12), (6), (1)) v(hours) JOIN r ON sensor_id = 1 AND reading_ts >= start_ts - to_hours(hours) AND reading_ts < start_ts GROUP BY failure_event_id, source_reference, start_ts, hours),
 (SELECT avg(value) AS bm, stddev_samp(value) AS bs FROM r WHERE sensor_id = 1 AND q >= 64 AND q <> 65 AND reading_ts >= '{B.BASE_FROM}' AND reading_ts < '{B.BASE_TO}')""", "usable_pct lead_up_mean usable_max baseline_mean z_vs_baseline"))
def q10_failure_correlation(spark, sf):
    r = A.readings(spark, sf, "click")
    base = between(r, "reading_ts", B.BASE_FROM, B.BASE_TO).where(trusted(F.col("quality_code_id"))).agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("stddev_value"))
    return tidy(analysis.failure_correlation(r, A.failures(spark), base))


_DUTY = "SELECT strftime(d, '%Y-%m-%d') AS bucket_date, n AS usable_scans, a AS off_scans, b AS offloaded_scans, c AS loaded_scans, e AS starting_scans, 100.0 * c / n AS loaded_pct, (b + c + e) * {scan} / 3600.0 AS running_hours"
_DUTY_FROM = "FROM (SELECT d, count(*) AS n, count(*) FILTER (WHERE s = 'OFF') AS a, count(*) FILTER (WHERE s = 'OFFLOADED') AS b, count(*) FILTER (WHERE s = 'LOADED') AS c, count(*) FILTER (WHERE s = 'STARTING') AS e FROM ({rows}) GROUP BY d)"
_BAND = "CASE WHEN value < 15 THEN 'OFF' WHEN value < 35 THEN 'OFFLOADED' WHEN value < 70 THEN 'LOADED' ELSE 'STARTING' END"


@query(sql(R, _DUTY.format(scan=f"{B.USUAL}.0") + " " + _DUTY_FROM.format(rows=f"SELECT reading_ts::DATE AS d, {_BAND} AS s FROM r WHERE sensor_id = 5 AND q >= 64 AND q <> 65 AND reading_ts >= '{FROM}' AND reading_ts < '{TO}'"), "loaded_pct running_hours"))
def q11_duty_cycle(spark, sf):
    r = between(A.readings(spark, sf, A.CURRENT)).where(trusted(F.col("quality_code_id")))
    d = analysis.duty_cycle(r.select("reading_ts", operating_state(F.col("value"), A.BANDS).alias("operating_state")), B.USUAL)
    return tidy(d.drop("running_pct", "running_pct_7d"))


@query(sql(R + _HOURLY, "FROM h", _STATS))
def rollup_hourly(spark, sf):
    return tidy(rollup.rollup(A.readings(spark, sf)))


@query(sql(R + _DAILY, "SELECT * REPLACE (strftime(bucket_date, '%Y-%m-%d') AS bucket_date) FROM dd", _STATS))
def rollup_daily(spark, sf):
    return tidy(rollup.rollup(A.readings(spark, sf), "day"))


@query(ORACLES["rollup_daily"])
def rollup_daily_merged(spark, sf):
    """Days merged from the stored partials of their hours, without the readings."""
    return tidy(incremental.as_rollup(incremental.daily(_partials(spark, sf)), "sensor_id", "bucket_date").drop("time_weighted_avg"))


@query(sql(R, f"SELECT sensor_id, strftime(m, '%Y-%m-%d') AS month, count(*) AS sample_count, count(*) FILTER (WHERE q >= 64) AS good_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, stddev_samp(value) AS stddev_value, arg_min(value, reading_ts) AS first_value, arg_max(value, reading_ts) AS last_value, sum(value * w) / nullif(sum(w), 0) AS time_weighted_avg FROM (SELECT *, date_trunc('month', reading_ts)::DATE AS m, least(coalesce(date_diff('second', reading_ts, lead(reading_ts) OVER (PARTITION BY sensor_id ORDER BY reading_ts)), {B.USUAL}), {B.MOST}) AS w FROM r) GROUP BY ALL", _STATS + " time_weighted_avg"))
def rollup_monthly_merged(spark, sf):
    """Months, with their time-weighted means, from the same partials."""
    parts = incremental.merged(_partials(spark, sf), ["sensor_id"], F.date_trunc("month", "bucket_start").cast("date"), "month")
    return tidy(incremental.as_rollup(parts, "sensor_id", "month"))


@query(sql(R + _HOURLY, "FROM h JOIN tw USING (sensor_id, bucket_start)", _STATS + " time_weighted_avg"))
def time_weighted_hourly(spark, sf):
    return tidy(rollup.rollup(A.readings(spark, sf), "hour", True, default_seconds=B.USUAL, most_seconds=B.MOST))


@query(sql(R + _HOURLY, "SELECT sensor_id, bucket_start, sample_count, avg_value, time_weighted_avg, time_weighted_avg - avg_value AS difference, 100.0 * (time_weighted_avg - avg_value) / nullif(abs(avg_value), 0) AS difference_pct FROM h JOIN tw USING (sensor_id, bucket_start)", "avg_value time_weighted_avg difference difference_pct"))
def aggregate_comparison(spark, sf):
    return tidy(rollup.aggregate_comparison(rollup.rollup(A.readings(spark, sf), "hour", True, default_seconds=B.USUAL, most_seconds=B.MOST)))


@query(sql(R, "SELECT 1::BIGINT AS equipment_id, 'UNIT-1' AS equipment_code, s.sensor_id, s.sensor_code, sensor_class, unit, display_order, t AS last_reading_ts, v AS last_value, code AS quality_code, is_usable AS quality_is_usable, date_diff('second', t, (SELECT max(reading_ts) FROM r)) AS seconds_behind_archive FROM sensor s JOIN (SELECT sensor_id, max(reading_ts) AS t, arg_max(value, reading_ts) AS v, arg_max(q, reading_ts) AS q FROM r GROUP BY 1) USING (sensor_id) JOIN quality ON q = quality_code_id", "last_value"))
def view_latest(spark, sf):
    return tidy(views.latest_readings(A.readings(spark, sf), A.sensors(spark), A.quality_codes(spark), A.equipment(spark)))


@query(sql(R + _HOURLY, f"SELECT h.*, sensor_code, unit, 100.0 * sample_count / {B.PER_HOUR} AS coverage_pct, 100.0 * good_count / sample_count AS good_pct FROM h JOIN sensor USING (sensor_id)", _STATS + " coverage_pct good_pct"))
def view_hourly(spark, sf):
    return tidy(views.with_coverage(rollup.rollup(A.readings(spark, sf)), A.sensors(spark), B.PER_HOUR))


@query(sql(R + _DAILY, f"SELECT dd.* REPLACE (strftime(bucket_date, '%Y-%m-%d') AS bucket_date), sensor_code, unit, 100.0 * sample_count / {B.PER_DAY} AS coverage_pct, 100.0 * good_count / sample_count AS good_pct FROM dd JOIN sensor USING (sensor_id)", _STATS + " coverage_pct good_pct"))
def view_daily(spark, sf):
    return tidy(views.with_coverage(rollup.rollup(A.readings(spark, sf), "day"), A.sensors(spark), B.PER_DAY))


@query(sql(R + _DAILY, "SELECT s.sensor_id, sensor_code, lo AS min_value, hi AS max_value, hi - lo AS value_range, strftime(f, '%Y-%m-%d') AS first_date, strftime(l, '%Y-%m-%d') AS last_date, n AS total_samples, strftime((SELECT min(bucket_date) FROM dd WHERE dd.sensor_id = s.sensor_id AND min_value = lo), '%Y-%m-%d') AS min_value_date, strftime((SELECT min(bucket_date) FROM dd WHERE dd.sensor_id = s.sensor_id AND max_value = hi), '%Y-%m-%d') AS max_value_date FROM sensor s JOIN (SELECT sensor_id, min(min_value) AS lo, max(max_value) AS hi, min(bucket_date) AS f, max(bucket_date) AS l, sum(sample_count)::BIGINT AS n FROM dd GROUP BY 1) USING (sensor_id)", "min_value max_value value_range"))
def view_min_max(spark, sf):
    return tidy(views.extremes(rollup.rollup(A.readings(spark, sf), "day"), A.sensors(spark)))


_ROLL = "OVER (PARTITION BY sensor_id ORDER BY bucket_start ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_PREV = "OVER (PARTITION BY sensor_id ORDER BY bucket_start)"


@query(sql(R + _HOURLY, f"SELECT sensor_id, bucket_start, avg_value, sample_count, avg(avg_value) {_ROLL} AS rolling_24h_mean, stddev_samp(avg_value) {_ROLL} AS rolling_24h_stddev, avg_value - lag(avg_value) {_PREV} AS rate_of_change_per_hour, count(*) {_ROLL} AS window_bucket_count FROM h", "avg_value rolling_24h_mean rolling_24h_stddev rate_of_change_per_hour"))
def view_rolling(spark, sf):
    return tidy(views.rolling(rollup.rollup(A.readings(spark, sf))))


@query(sql(R + _HOURLY, f"SELECT sensor_id, bucket_start, avg_value, sample_count, avg(avg_value) {_ROLL} AS rolling_mean, stddev_samp(avg_value) {_ROLL} AS rolling_std, avg_value - lag(avg_value) {_PREV} AS change, date_diff('hour', lag(bucket_start) {_PREV}, bucket_start) AS gap_hours, (avg_value - lag(avg_value) {_PREV}) / date_diff('hour', lag(bucket_start) {_PREV}, bucket_start) AS rate_per_hour, count(*) {_ROLL} AS window_buckets FROM h", "avg_value rolling_mean rolling_std change rate_per_hour"))
def trend_hours(spark, sf):
    return tidy(analysis.rolling_hours(rollup.rollup(A.readings(spark, sf))))


_TREND = f"""SELECT sensor_id, bucket_start, avg_value, min_value, max_value, sample_count, CASE WHEN c >= 6 THEN avg(avg_value) {_ROLL} END AS rolling_mean, CASE WHEN c >= 6 THEN stddev_samp(avg_value) {_ROLL} END AS rolling_std,
 CASE WHEN c >= 6 THEN min(avg_value) {_ROLL} END AS rolling_min, CASE WHEN c >= 6 THEN max(avg_value) {_ROLL} END AS rolling_max, (avg_value - lag(avg_value) {_PREV}) / el AS rate_of_change_per_hour
 FROM (SELECT *, count(*) {_ROLL} AS c, date_diff('second', lag(bucket_start) {_PREV}, bucket_start) / 3600.0 AS el FROM h)"""
_TREND2 = f"SELECT *, (rolling_mean - lag(rolling_mean) {_PREV}) / (date_diff('second', lag(bucket_start) {_PREV}, bucket_start) / 3600.0) AS trend_slope_per_hour FROM ({_TREND})"


@query(sql(R + _HOURLY, _TREND2, "avg_value min_value max_value rolling_mean rolling_std rolling_min rolling_max rate_of_change_per_hour trend_slope_per_hour"))
def trend_frame(spark, sf):
    return tidy(analysis.trend_frame(rollup.rollup(A.readings(spark, sf))))


@query(sql(R + _HOURLY, f"SELECT sensor_id, count(*) AS buckets, min(avg_value) AS min, max(avg_value) AS max, avg(avg_value) AS mean, quantile_cont(avg_value, 0.5) AS median, stddev_samp(avg_value) AS std, arg_max(avg_value, bucket_start) AS latest, arg_max(rolling_mean, bucket_start) AS latest_rolling_mean, avg(trend_slope_per_hour) AS mean_slope_per_hour, max(abs(rate_of_change_per_hour)) AS max_abs_rate_of_change FROM ({_TREND2}) GROUP BY 1", "min max mean median std latest latest_rolling_mean mean_slope_per_hour max_abs_rate_of_change"))
def trend_summary(spark, sf):
    return tidy(analysis.trend_summary(analysis.trend_frame(rollup.rollup(A.readings(spark, sf)))))


_FC = f"""SELECT failure_event_id, source_reference, start_ts, end_ts, failure_type, severity, date_diff('minute', start_ts, end_ts) AS duration_minutes, n AS lead_up_24h_scans, s AS lead_up_24h_stale_scans, 100.0 * s / nullif(n, 0) AS lead_up_24h_stale_pct,
 CASE WHEN n = 0 THEN 'NO DATA' WHEN 100.0 * s / n > 25 THEN 'UNUSABLE' ELSE 'USABLE' END AS lead_up_usability
 FROM failure, LATERAL (SELECT count(*) AS n, count(*) FILTER (WHERE q = 65) AS s FROM r WHERE sensor_id = {B.PRESSURE_ID} AND reading_ts >= start_ts - to_hours(24) AND reading_ts < start_ts)"""


@query(sql(R, _FC, "lead_up_24h_stale_pct"))
def view_failure_context(spark, sf):
    return tidy(views.failure_context(A.failures(spark), A.readings(spark, sf), B.PRESSURE_ID))


@query(sql(R, f"SELECT * FROM ({_FC}) WHERE severity = 'HIGH'", "lead_up_24h_stale_pct"))
def failure_list(spark, sf):
    d = views.failure_context(A.failures(spark), A.readings(spark, sf), B.PRESSURE_ID)
    return tidy(serve.optional(d, severity="HIGH", failure_type=None).orderBy("start_ts"))


@query(sql(R, "SELECT code, n AS readings, 100.0 * n / sum(n) OVER () AS pct_of_total FROM (SELECT q, count(*) AS n FROM r GROUP BY 1) JOIN quality ON q = quality_code_id", "pct_of_total"))
def quality_distribution(spark, sf):
    return tidy(views.quality_distribution(A.readings(spark, sf), A.quality_codes(spark)))


@query(sql(R, "SELECT sensor_id, count(*) AS readings, 100.0 * count(*) FILTER (WHERE q = 192) / count(*) AS good_pct, 100.0 * count(*) FILTER (WHERE q = 65) / count(*) AS stale_pct, min(value) AS min_value, max(value) AS max_value FROM r GROUP BY 1", "good_pct stale_pct min_value max_value"))
def sensor_quality(spark, sf):
    return tidy(views.sensor_quality(A.readings(spark, sf)))


@query(sql(R, "SELECT reading_ts AS timestamp, value, code AS quality, is_usable AS quality_usable FROM r JOIN quality ON q = quality_code_id WHERE sensor_id = 1 AND reading_ts >= '2024-01-05 00:00:00' AND reading_ts < '2024-01-05 06:00:00'", "value"))
def series_auto_raw(spark, sf):
    return tidy(_auto(spark, sf, "2024-01-05 00:00:00", "2024-01-05 06:00:00"))


@query(sql(R + _HOURLY, f"SELECT bucket_start AS timestamp, avg_value AS value, min_value, max_value, sample_count, round(100.0 * sample_count / {B.PER_HOUR}, 1)::DOUBLE AS coverage_pct FROM h WHERE sensor_id = 1 AND bucket_start >= '2024-01-01' AND bucket_start < '2024-01-31'", "value min_value max_value coverage_pct"))
def series_auto_hourly(spark, sf):
    return tidy(_auto(spark, sf, "2024-01-01 00:00:00", "2024-01-31 00:00:00"))


@query(sql(R + _DAILY, f"SELECT bucket_date::TIMESTAMP AS timestamp, avg_value AS value, min_value, max_value, sample_count, round(100.0 * sample_count / {B.PER_DAY}, 1)::DOUBLE AS coverage_pct FROM dd WHERE sensor_id = 1 AND bucket_date >= '2024-01-01' AND bucket_date < '2024-02-15'", "value min_value max_value coverage_pct"))
def series_auto_daily(spark, sf):
    return tidy(_auto(spark, sf, "2024-01-01 00:00:00", "2024-02-15 00:00:00"))


def _auto(spark, sf, start: str, end: str, sensor_id: int = 1):
    from datetime import datetime

    a, z = datetime.fromisoformat(start), datetime.fromisoformat(end)
    r = A.readings(spark, sf).where(F.col("sensor_id") == sensor_id)
    how = serve.choose_resolution(a, z)
    if how == "raw":
        return serve.raw_series(r, A.quality_codes(spark), sensor_id, a, z).rows
    bucket, name, per = ("hour", "bucket_start", B.PER_HOUR) if how == "hourly" else ("day", "bucket_date", B.PER_DAY)
    return serve.bucket_series(rollup.rollup(between(r, "reading_ts", start, end), bucket), name, sensor_id, a, z, per).rows


@query(sql(R, "SELECT reading_ts AS timestamp, value, code AS quality, is_usable AS quality_usable, (SELECT count(*) FROM r WHERE sensor_id = 5) > 150 AS truncated FROM r JOIN quality ON q = quality_code_id WHERE sensor_id = 5 ORDER BY reading_ts LIMIT 150", "value"))
def series_limited(spark, sf):
    """The first points of a series that holds more than the service returns at once."""
    s = serve.raw_series(A.readings(spark, sf, A.CURRENT), A.quality_codes(spark), B.CURRENT_ID, None, None, 150)
    return tidy(s.rows.withColumn("truncated", F.lit(s.truncated)))


@query(sql(R + _HOURLY, f"SELECT sensor_code, bucket_start AS timestamp, avg_value AS value, min_value, max_value, sample_count, round(100.0 * sample_count / {B.PER_HOUR}, 1)::DOUBLE AS coverage_pct FROM h JOIN sensor USING (sensor_id) WHERE sensor_id IN (1, 5) AND bucket_start >= '2024-01-03' AND bucket_start < '2024-01-06'", "value min_value max_value coverage_pct"))
def series_multi(spark, sf):
    return tidy(serve.several(lambda i: _auto(spark, sf, "2024-01-03 00:00:00", "2024-01-06 00:00:00", i), "click, view", {s[1]: s[0] for s in A.SENSORS}))


@query(sql(R, "SELECT sensor_id, sensor_code, sensor_class, unit, display_order, n AS readings FROM sensor JOIN (SELECT sensor_id, count(*) AS n FROM r GROUP BY 1) USING (sensor_id) WHERE upper(sensor_code) = upper('Purchase')"))
def entity_lookup(spark, sf):
    sensors = A.sensors(spark)
    i, _ = serve.resolve_sensor(sensors, "Purchase")
    n = A.readings(spark, sf).where(F.col("sensor_id") == i).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("readings"))
    return tidy(sensors.join(n, "sensor_id").select("sensor_id", "sensor_code", "sensor_class", "unit", "display_order", "readings"))


@query(sql(R, "SELECT s.sensor_id, count(*) AS readings, count(DISTINCT reading_ts) AS instants, count(*) - count(DISTINCT reading_ts) AS repeated_keys, (SELECT count(*) FROM events WHERE event_type NOT IN (SELECT sensor_code FROM sensor)) AS orphans FROM r JOIN sensor s USING (sensor_id) GROUP BY 1"))
def integrity_counts(spark, sf):
    orphans = A.events(spark, sf).join(A.sensors(spark), F.col("event_type") == F.col("sensor_code"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    by_key = A.readings(spark, sf).groupBy("sensor_id", "reading_ts").agg(F.count(F.lit(1)).alias("n"))
    d = by_key.groupBy("sensor_id").agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("instants"))
    return tidy(d.withColumn("repeated_keys", F.col("readings") - F.col("instants")).crossJoin(orphans))


@query(sql(R, "SELECT count(*) AS sensors, count(DISTINCT n) AS distinct_counts, CASE WHEN count(DISTINCT n) = 1 THEN 'OK' ELSE 'WARNING' END AS verdict FROM (SELECT count(*) AS n FROM r GROUP BY sensor_id)"))
def integrity_equal_counts(spark, sf):
    return tidy(views.equal_counts(A.readings(spark, sf)))


@query("SELECT 'lineitem without order' AS check_name, count(*) AS orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'order without customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'customer without order', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def integrity_orphans(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders", "customer")}
    n = lambda name, a, b, on: a.join(b, on, "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check_name"), "orphans")
    return (
        n("lineitem without order", t["lineitem"], t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .unionByName(n("order without customer", t["orders"], t["customer"], F.col("o_custkey") == F.col("c_custkey")))
        .unionByName(n("customer without order", t["customer"], t["orders"], F.col("o_custkey") == F.col("c_custkey")))
    )


@query("SELECT o_orderkey, o_custkey, c_name, n_name, r_name, o_orderstatus, round(o_totalprice, 6) + 0.0::DOUBLE AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01'")
def star_join(spark, sf):
    o, c, n, r = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "nation", "region"))
    d = between(o, "o_orderdate", "1996-01-01 00:00:00", "1996-07-01 00:00:00").join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return tidy(d.select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name", "o_orderstatus", "o_totalprice"))


@query("SELECT o_orderstatus, count(*) AS stored, (SELECT count(*) FROM orders x WHERE x.o_orderstatus = o.o_orderstatus AND x.o_orderkey % 3 = 0) AS inserted FROM orders o GROUP BY 1")
def idempotent_insert(spark, sf):
    """A load of all orders over an archive that holds two thirds of them: what is new is added once."""
    from tidemark.sources.archive import new_rows

    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    stored = o.where("o_orderkey % 3 <> 0")
    fresh = new_rows(o.unionByName(o), stored, ["o_orderkey"]).withColumn("new", F.lit(1))
    d = stored.withColumn("new", F.lit(0)).unionByName(fresh)
    return tidy(d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("stored"), F.sum("new").alias("inserted")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0")
def merge_dims(spark, sf):
    """Upsert by natural key: even keys arrive changed or new, the others stay."""
    from tidemark.sources.archive import merged

    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    return merged(c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.upper("c_mktsegment")), ["c_custkey"])


_VALUE_AT = f"""SELECT sensor_id, asked AS "at", CASE WHEN pt = asked OR sensor_class = 'Digital' OR nt IS NULL THEN pv ELSE pv + (nv - pv) * (date_diff('millisecond', pt, asked) / date_diff('millisecond', pt, nt)::DOUBLE) END AS value,
 CASE WHEN pt = asked THEN 'EXACT' WHEN sensor_class = 'Digital' THEN 'STEP' WHEN nt IS NULL THEN 'HELD_END_OF_ARCHIVE' ELSE 'INTERPOLATED' END AS method, pt AS prev_ts, nt AS next_ts, date_diff('second', pt, nt) AS bracket_seconds
 FROM (SELECT q.sensor_id, q.asked, p.reading_ts AS pt, p.value AS pv, x.reading_ts AS nt, x.value AS nv FROM req q ASOF JOIN kept p ON p.sensor_id = q.sensor_id AND p.reading_ts <= q.asked ASOF LEFT JOIN kept x ON x.sensor_id = q.sensor_id AND x.reading_ts > q.asked) JOIN sensor USING (sensor_id)
 WHERE nt IS NULL OR date_diff('second', pt, nt) <= {4 * B.MOST} OR sensor_class = 'Digital'"""


@query(sql(R + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY reading_ts) AS k FROM r), kept AS (FROM k WHERE k % 3 = 1), req AS (SELECT sensor_id, reading_ts AS asked FROM k)", _VALUE_AT, "value"))
def value_at(spark, sf):
    """Every reading asked of an archive that stored each third one."""
    from tidemark.operators.compress import value_at as ask

    r = A.readings(spark, sf).withColumn("_block", block_of(F.col("reading_ts")))
    k = ordered.running(r, ["sensor_id"], "_block", ["reading_ts"], "k", F.lit(1).cast("long"))
    d = ask(k.where("k % 3 = 1"), k.select("sensor_id", F.col("reading_ts").alias("at")), A.sensors(spark), 4 * B.MOST)
    return tidy(d)


@query(sql(R, "SELECT count(*) AS total_readings, count(*) FILTER (WHERE q = 192) AS good_readings, min(reading_ts) AS first_ts, max(reading_ts) AS last_ts FROM r"))
def archive_bounds(spark, sf):
    r = A.readings(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("total_readings"), F.count_if(F.col("quality_code_id") == C.GOOD).alias("good_readings"), F.min("reading_ts").alias("first_ts"), F.max("reading_ts").alias("last_ts"))


@query("SELECT 'events' AS table_name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, sf):
    from tidemark.operators.profile import table_counts as counts

    return counts({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("events", "orders", "lineitem")})


@query(sql(R, "SELECT sensor_id, strftime(d, '%Y-%m-%d') AS bucket_date, b AS flagged, 100.0 * b / n AS flagged_pct FROM (SELECT sensor_id, reading_ts::DATE AS d, count(*) AS n, count(*) FILTER (WHERE q < 64) AS b FROM r GROUP BY ALL) WHERE b > 0", "flagged_pct"))
def bad_readings_daily(spark, sf):
    n = F.count_if(~usable(F.col("quality_code_id")))
    d = A.readings(spark, sf).groupBy("sensor_id", day_of(F.col("reading_ts")).alias("bucket_date")).agg(n.alias("flagged"), pct(n, F.count(F.lit(1))).alias("flagged_pct"))
    return tidy(d.where("flagged > 0"))
