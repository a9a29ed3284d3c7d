"""Queries on the scan archive: validation, states, baselines, detectors, failures,
forecasts, compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import analysis, compress, profile, rollup, serve, validate, views
from tidemark.sources import adapters as A
from tidemark.sources import archive

from . import base as B
from .base import clean_scans, narrow, ordered, sql, states, tidy
from .registry import ORACLES, query

S, HS, BASE = B.SCANS, B.HOURLY_STATE, B.BASELINE
_PAYLOAD = "concat_ws(',', source_index::VARCHAR, stamp, " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in A.WIDE) + ")"


# --- validation -------------------------------------------------------------------


@query(sql(S, "SELECT source_line_no, scan_ts, is_stale, same AS unchanged FROM clean"))
def validate_scans(spark, sf):
    return tidy(clean_scans(spark, sf).select("source_line_no", "scan_ts", "is_stale", "unchanged"))


@query(sql(S, "SELECT sensor_id, q AS quality_code_id, count(*) AS readings FROM nb GROUP BY ALL"))
def validate_quality(spark, sf):
    return tidy(narrow(spark, sf).groupBy("sensor_id", "quality_code_id").agg(F.count(F.lit(1)).alias("readings")))


@query(sql(S, "SELECT source_line_no, reject AS reason_code, CASE WHEN reject = 'UNPARSEABLE_TIMESTAMP' THEN 'Timestamp could not be parsed.' ELSE 'Delta from previous reading was ' || delta || ' s.' END AS reason_detail, stamp AS payload_stamp FROM ordered WHERE reject IS NOT NULL"))
def validate_rejects(spark, sf):
    d = validate.rejected(ordered(spark, sf), B.RAW_COLUMNS)
    return tidy(d.select("source_line_no", "reason_code", "reason_detail", F.split("payload", ",")[1].alias("payload_stamp")))


@query(sql(S, "SELECT reject AS reason_code, count(*) AS rows FROM ordered WHERE reject IS NOT NULL GROUP BY 1"))
def rejects_by_reason(spark, sf):
    return tidy(views.rejects_by_reason(validate.rejected(ordered(spark, sf), B.RAW_COLUMNS)))


_PREVIOUS = S.replace("max(scan_ts) OVER (ORDER BY source_line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "lag(scan_ts) OVER (ORDER BY source_line_no)")


@query(sql(_PREVIOUS, "SELECT source_line_no, reject AS reason_code, delta FROM ordered WHERE reject IS NOT NULL"))
def validate_rejects_by_line(spark, sf):
    d = ordered(spark, sf, by_previous_line=True).where("reject is not null")
    return tidy(d.select("source_line_no", F.col("reject").alias("reason_code"), "delta"))


_COUNTS = " UNION ALL ".join(
    f"SELECT 'MISSING_VALUE' AS issue_type, {i}::BIGINT AS sensor_id FROM clean WHERE {c} IS NULL UNION ALL SELECT 'OUT_OF_RANGE', {i} FROM clean WHERE {c} < {B.LOW_LIMIT} OR {c} > {B.HIGH_LIMIT}" + (f" UNION ALL SELECT 'NON_BINARY_DIGITAL', {i} FROM clean WHERE {c} NOT IN (0, 1)" if d else "")
    for i, c, _, _, d in B.SIGNALS
)


@query(
    sql(
        S,
        f"""SELECT issue_type, sensor_id, count(*) AS affected_rows, CASE WHEN issue_type IN ('UNPARSEABLE_TIMESTAMP', 'DUPLICATE_TIMESTAMP', 'NON_MONOTONIC_TS', 'OUT_OF_RANGE', 'NON_BINARY_DIGITAL') THEN 'CRITICAL' WHEN issue_type = 'GAP' THEN 'INFO' ELSE 'WARNING' END AS severity FROM (
 SELECT CASE reject WHEN 'NON_MONOTONIC_TIMESTAMP' THEN 'NON_MONOTONIC_TS' ELSE reject END AS issue_type, NULL::BIGINT AS sensor_id FROM ordered WHERE reject IS NOT NULL
 UNION ALL SELECT 'GAP', NULL FROM ordered WHERE reject IS NULL AND delta > {B.GAP_SQL} UNION ALL SELECT 'FLATLINE', NULL FROM clean WHERE is_stale
 UNION ALL SELECT 'XSENSOR_DIVERGENCE', NULL FROM clean WHERE abs(click - error) > {B.APART} UNION ALL {_COUNTS}) GROUP BY 1, 2""",
    )
)
def validate_issues(spark, sf):
    return tidy(validate.issue_totals(ordered(spark, sf), clean_scans(spark, sf), B.SIGNALS, "click", "error", B.APART, B.gap_seconds(spark, sf)))


@query(sql(S, f"SELECT count(*) AS affected_rows, min(scan_ts) AS window_start, max(scan_ts) AS window_end, max(abs(click - error)) AS observed_value FROM clean WHERE abs(click - error) > {B.APART} HAVING count(*) > 0", "observed_value"))
def validate_divergence(spark, sf):
    return tidy(validate.divergence(clean_scans(spark, sf), "click", "error", B.APART))


@query(sql(S, "SELECT sensor_id, reading_ts, value, q AS quality_code_id FROM nb", "value"))
def melt_wide(spark, sf):
    return tidy(narrow(spark, sf))


@query(
    sql(
        S,
        """SELECT read, rejected, missing, inserted, skipped, (read - rejected) * 5 - missing AS expected, (read - rejected) * 5 - missing - inserted - skipped AS shortfall, CASE WHEN (read - rejected) * 5 - missing = inserted + skipped THEN 'INFO' ELSE 'CRITICAL' END AS severity
 FROM (SELECT (SELECT count(*) FROM raw) AS read, (SELECT count(*) FROM ordered WHERE reject IS NOT NULL) AS rejected, (SELECT sum((click IS NULL)::INT + (error IS NULL)::INT + (purchase IS NULL)::INT + (view IS NULL)::INT + (signup IS NULL)::INT)::BIGINT FROM clean) AS missing, (SELECT count(*) FROM nb) AS inserted, 0::BIGINT AS skipped)""",
    )
)
def reconciliation(spark, sf):
    o = ordered(spark, sf)
    clean = clean_scans(spark, sf)
    n = F.count(F.lit(1))
    missing = F.coalesce(sum((F.sum(F.col(c).isNull().cast("long")) for c in A.WIDE), F.lit(0)), F.lit(0))
    d = o.agg(n.alias("read"), F.count_if(F.col("reject").isNotNull()).alias("rejected")).crossJoin(clean.agg(missing.alias("missing")))
    d = d.crossJoin(narrow(spark, sf).agg(n.alias("inserted"))).withColumn("skipped", F.lit(0).cast("long"))
    return tidy(d.select("*", *validate.reconciliation(F.col("read"), F.col("rejected"), F.col("missing"), F.col("inserted"), F.col("skipped"), 5)))


@query(sql(S, f"SELECT prev_ts AS gap_start, scan_ts AS gap_end, delta AS gap_seconds, greatest(delta // {B.SCAN_SQL} - 1, 0) AS missing_scans FROM ordered WHERE reject IS NULL AND delta > {B.GAP_SQL}"))
def scan_gaps(spark, sf):
    return tidy(validate.gaps(ordered(spark, sf), B.gap_seconds(spark, sf), B.scan_seconds(spark, sf)))


_RUN = f"date_diff('day', DATE '{A.START[:10]}', scan_ts::DATE)"
_ISSUES_SQL = (
    S
    + f""",
ledger AS (SELECT run_id, 'scans-' || run_id || '.csv' AS source_file, CASE run_id % 5 WHEN 0 THEN 'PARTIAL' WHEN 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, count(*) AS rows_read FROM (SELECT {_RUN} AS run_id FROM ordered WHERE reject IS NULL) GROUP BY 1),
g AS (SELECT {_RUN} AS run_id, prev_ts, scan_ts, delta, greatest(delta // {B.SCAN_SQL} - 1, 0) AS missing FROM ordered WHERE reject IS NULL AND delta > {B.GAP_SQL}),
issues AS (SELECT run_id, 'GAP' AS issue_type, 'INFO' AS severity, prev_ts AS window_start, scan_ts AS window_end, delta::DOUBLE AS observed_value, missing AS affected_rows, false AS is_summary FROM g
 UNION ALL SELECT run_id, 'GAP', 'INFO', NULL, NULL, NULL, count(*), true FROM g GROUP BY run_id)"""
)


def _run_of(time):
    return F.datediff(F.to_date(time), F.to_date(F.lit(A.START[:10]))).cast("long").alias("run_id")


def _ledger(spark, sf):
    """A run for each day of the archive, as if its scans had come in daily files."""
    days = ordered(spark, sf).where("reject is null").groupBy(_run_of("scan_ts")).agg(F.count(F.lit(1)).alias("rows_read"))
    status = F.when(F.col("run_id") % 5 == 0, "PARTIAL").when(F.col("run_id") % 5 == 4, "FAILED").otherwise("SUCCEEDED")
    return days.select("run_id", F.concat(F.lit("scans-"), F.col("run_id").cast("string"), F.lit(".csv")).alias("source_file"), status.alias("status"), "rows_read")


def _issues(spark, sf):
    g = validate.gaps(ordered(spark, sf), B.gap_seconds(spark, sf), B.scan_seconds(spark, sf)).withColumn("run_id", _run_of("gap_end"))
    tag = [F.lit("GAP").alias("issue_type"), F.lit("INFO").alias("severity")]
    one = g.select("run_id", *tag, F.col("gap_start").alias("window_start"), F.col("gap_end").alias("window_end"), F.col("gap_seconds").cast("double").alias("observed_value"), F.col("missing_scans").alias("affected_rows"), F.lit(False).alias("is_summary"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("window_start", "timestamp_ntz"), ("window_end", "timestamp_ntz"), ("observed_value", "double"))]
    total = g.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", *tag, *none, F.col("n").alias("affected_rows"), F.lit(True).alias("is_summary"))
    return one.unionByName(total)


@query(sql(_ISSUES_SQL, "SELECT run_id, source_file, status, rows_read, issue_type, severity, coalesce(sum(affected_rows) FILTER (WHERE is_summary), 0)::BIGINT AS affected_rows, count(*) FILTER (WHERE NOT is_summary) AS detail_rows FROM ledger LEFT JOIN issues USING (run_id) GROUP BY ALL"))
def view_dq_summary(spark, sf):
    return tidy(views.quality_summary(_ledger(spark, sf), _issues(spark, sf)))


@query(sql(_ISSUES_SQL, "SELECT issue_type, severity, sum(affected_rows)::BIGINT AS affected_rows FROM issues WHERE is_summary AND run_id = (SELECT max(run_id) FROM ledger WHERE status = 'SUCCEEDED') GROUP BY 1, 2 HAVING sum(affected_rows) > 0"))
def issue_summary(spark, sf):
    return tidy(views.issue_summary(_ledger(spark, sf), _issues(spark, sf)))


@query(sql(_ISSUES_SQL, "SELECT run_id, window_start AS gap_start, window_end AS gap_end, observed_value AS gap_seconds, observed_value / 3600.0 AS gap_hours, affected_rows AS estimated_missing_scans FROM issues WHERE NOT is_summary AND run_id = (SELECT max(run_id) FROM ledger WHERE status = 'SUCCEEDED')", "gap_seconds gap_hours"))
def view_timestamp_gap(spark, sf):
    return tidy(views.timestamp_gaps(_issues(spark, sf), _ledger(spark, sf)))


# --- states, rollups, baselines ---------------------------------------------------


@query(sql(S, "FROM st", "motor_current"))
def scan_state(spark, sf):
    return tidy(states(spark, sf))


@query(sql(S, "SELECT operating_state, count(*) AS scans, sum(is_stale::INT)::BIGINT AS stale_scans FROM st GROUP BY 1"))
def state_distribution(spark, sf):
    return tidy(analysis.state_distribution(states(spark, sf)))


@query(sql(S, f"SELECT click_ts AS reading_ts, a AS left_value, b AS right_value, abs(a - b) AS abs_divergence, CASE WHEN abs(a - b) > {B.APART} THEN 'DIVERGENT' ELSE 'OK' END AS status FROM (SELECT x.reading_ts AS click_ts, x.value AS a, y.value AS b FROM nb x JOIN nb y ON x.sensor_id = 1 AND y.sensor_id = 2 AND x.reading_ts = y.reading_ts)", "left_value right_value abs_divergence"))
def q05_cross_sensor(spark, sf):
    """One pass that pivots both tags by instant, where a self-join would read twice."""
    at = narrow(spark, sf).where("sensor_id in (1, 2)").groupBy("reading_ts")
    d = at.agg(F.max(F.when(F.col("sensor_id") == 1, F.col("value"))).alias("left_value"), F.max(F.when(F.col("sensor_id") == 2, F.col("value"))).alias("right_value")).where("left_value is not null and right_value is not null")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return tidy(d.select("*", gap.alias("abs_divergence"), F.when(gap > B.APART, "DIVERGENT").otherwise("OK").alias("status")).orderBy(F.desc("abs_divergence"), "reading_ts"))


@query(sql(S + HS, "FROM hs", "min_value max_value avg_value stddev_value"))
def rollup_hourly_state(spark, sf):
    return tidy(B.hourly_state(spark, sf))


@query(sql(S + BASE, f"SELECT sensor_id, operating_state, '{B.BASE_NAME}' AS baseline_name, sample_count, mean_value, stddev_value, p01, p25, p50, p75, p99, lo AS iqr_lower_fence, hi AS iqr_upper_fence, iqr = 0 OR stddev_value = 0 AS is_degenerate FROM base", "mean_value stddev_value p01 p25 p50 p75 p99 iqr_lower_fence iqr_upper_fence"))
def baseline_stats(spark, sf):
    return tidy(B.baseline(spark, sf))


@query(ORACLES["baseline_stats"])
def baseline_stats_selected(spark, sf):
    """The same with percentiles by selection."""
    return tidy(analysis.baselines(B.stated(spark, sf), None, B.BASE_FROM, B.BASE_TO, B.BASE_NAME, B.MIN_SAMPLES, selected=True))


@query(sql(S, "SELECT CASE WHEN grouping(operating_state) = 1 THEN '(all states)' ELSE operating_state END AS state, count(*) AS n, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, min(value) AS min_value, max(value) AS max_value FROM nb JOIN st USING (reading_ts) WHERE sensor_id = 1 AND q >= 64 AND q <> 65 AND NOT is_stale GROUP BY GROUPING SETS ((operating_state), ())", "p25 p75 min_value max_value"))
def baseline_vs_global(spark, sf):
    return tidy(analysis.state_against_global(narrow(spark, sf), states(spark, sf), 1))


@query(
    sql(
        S + HS + BASE,
        f"""SELECT hs.sensor_id, bucket_start, hs.operating_state, avg_value, hs.sample_count, '{B.BASE_NAME}' AS baseline_name, lo AS expected_low, hi AS expected_high, CASE WHEN avg_value < lo THEN lo - avg_value ELSE avg_value - hi END AS exceedance_amount,
 CASE WHEN base.stddev_value > 0 THEN abs(avg_value - mean_value) / base.stddev_value END AS z_score, CASE WHEN base.stddev_value > 0 AND abs(avg_value - mean_value) / base.stddev_value >= 5 THEN 'CRITICAL' WHEN base.stddev_value > 0 AND abs(avg_value - mean_value) / base.stddev_value >= 3 THEN 'WARNING' ELSE 'NORMAL' END AS severity
 FROM hs JOIN base USING (sensor_id, operating_state) WHERE iqr > 0 AND (avg_value < lo OR avg_value > hi)""",
        "avg_value expected_low expected_high exceedance_amount z_score",
    )
)
def view_abnormal(spark, sf):
    return tidy(views.abnormal(B.hourly_state(spark, sf), B.baseline(spark, sf)))


_PART = "PARTITION BY sensor_id, operating_state ORDER BY bucket_start"
_PERSIST = """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sensor_id, operating_state, grp) AS run FROM (
 SELECT *, rn - sum(f::INT) OVER (PARTITION BY sensor_id, operating_state ORDER BY bucket_start ROWS UNBOUNDED PRECEDING) AS grp FROM ({flags})) WHERE f) WHERE run >= {n}"""
_MAD = f"""SELECT *, 0.6745 * (avg_value - med) / mad AS z, coalesce(mad > 0 AND abs(0.6745 * (avg_value - med) / mad) >= 3.5, false) AS f FROM (
 SELECT *, CASE WHEN c >= {B.HISTORY} THEN med0 END AS med, CASE WHEN c >= {B.HISTORY} THEN nullif(mad0, 0) END AS mad FROM (
 SELECT *, row_number() OVER ({_PART}) AS rn, count(*) OVER w AS c, quantile_cont(avg_value, 0.5) OVER w AS med0, mad(avg_value) OVER w AS mad0 FROM hs WINDOW w AS ({_PART} ROWS BETWEEN {B.WINDOW} PRECEDING AND 1 PRECEDING)))"""
_DET = "value expected_low expected_high score"
_MAD_SQL = f"SELECT sensor_id, bucket_start AS reading_ts, avg_value AS value, med - 3.5 * mad / 0.6745 AS expected_low, med + 3.5 * mad / 0.6745 AS expected_high, 'ADAPTIVE_MAD' AS method, abs(z) AS score, CASE WHEN abs(z) >= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, operating_state FROM ({_PERSIST.format(flags=_MAD, n=B.PERSIST)})"
_IQR = f"SELECT hs.*, lo, hi, iqr, row_number() OVER ({_PART}) AS rn, avg_value < lo OR avg_value > hi AS f FROM hs JOIN base USING (sensor_id, operating_state) WHERE iqr > 0"
_IQR_SQL = f"SELECT sensor_id, bucket_start AS reading_ts, avg_value AS value, lo AS expected_low, hi AS expected_high, 'BASELINE_IQR' AS method, (CASE WHEN avg_value < lo THEN lo - avg_value ELSE avg_value - hi END) / iqr AS score, CASE WHEN (CASE WHEN avg_value < lo THEN lo - avg_value ELSE avg_value - hi END) / iqr >= 1.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, operating_state FROM ({_PERSIST.format(flags=_IQR, n=1)})"
_LOW = f"sensor_id = {B.PRESSURE_ID} AND value < {B.SETPOINT} AND q >= 64 AND q <> 65"
_EP = f"""SELECT min(reading_ts) AS episode_start, max(reading_ts) AS episode_end, count(*) AS scans, min(value) AS lowest FROM (SELECT *, sum((low AND NOT (coalesce(was, false) AND date_diff('second', bf, reading_ts) <= {B.GAP_SQL}))::INT) OVER (ORDER BY reading_ts ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(low) OVER (ORDER BY reading_ts) AS was, lag(reading_ts) OVER (ORDER BY reading_ts) AS bf FROM (SELECT *, {_LOW} AS low FROM nb WHERE sensor_id = {B.PRESSURE_ID}))) WHERE low GROUP BY g HAVING count(*) >= {C.SETPOINT_MIN_SCANS}"""
_SET_SQL = f"SELECT {B.PRESSURE_ID}::BIGINT AS sensor_id, episode_start AS reading_ts, lowest AS value, {B.SETPOINT}::DOUBLE AS expected_low, NULL::DOUBLE AS expected_high, 'SETPOINT' AS method, {B.SETPOINT} - lowest AS score, CASE WHEN lowest < {B.SETPOINT_CRITICAL} THEN 'CRITICAL' ELSE 'WARNING' END AS severity, NULL::VARCHAR AS operating_state FROM ({_EP})"
_ANOMALIES = S + HS + BASE + f", anomaly AS ({_MAD_SQL} UNION ALL {_IQR_SQL} UNION ALL {_SET_SQL})"


@query(sql(S + HS, _MAD_SQL, _DET))
def detect_mad(spark, sf):
    return tidy(B.detected(spark, sf, "ADAPTIVE_MAD"))


_SCAN_STATE = """,
hs AS (SELECT nb.sensor_id, operating_state, nb.reading_ts AS bucket_start, value AS avg_value FROM nb JOIN st USING (reading_ts) WHERE sensor_id IN (1, 2, 3, 5) AND q >= 64 AND q <> 65 AND NOT is_stale)"""


@query(sql(S + _SCAN_STATE, _MAD_SQL.replace("ADAPTIVE_MAD", "SCAN_MAD"), _DET))
def detect_scan_mad(spark, sf):
    """The same on every reading: windows of an order statistic over sorted batches."""
    return tidy(analysis.detect_scan_mad(narrow(spark, sf), states(spark, sf), [1, 2, 3, 5], B.WINDOW, B.HISTORY, B.PERSIST))


@query(sql(S + HS + BASE, _IQR_SQL, _DET))
def detect_iqr(spark, sf):
    return tidy(B.detected(spark, sf, "BASELINE_IQR"))


@query(sql(S, _SET_SQL, _DET))
def detect_setpoint(spark, sf):
    return tidy(B.detected(spark, sf, "SETPOINT"))


@query(sql(S, _EP, "lowest"))
def setpoint_episodes(spark, sf):
    return tidy(B.episodes(spark, sf))


@query(sql(S, f"SELECT min(reading_ts) AS episode_start, max(reading_ts) AS episode_end, count(*) AS scans, min(value) AS lowest FROM (SELECT *, date_diff('minute', TIMESTAMP '1970-01-01', reading_ts) - row_number() OVER (ORDER BY reading_ts) AS g FROM nb WHERE {_LOW}) GROUP BY g HAVING count(*) >= 1", "lowest"))
def detect_setpoint_refgroup(spark, sf):
    return tidy(B.episodes(spark, sf, minute_groups=True, min_scans=1))


@query(sql(_ANOMALIES, "SELECT method, total, total / 30.0 AS per_day, CASE WHEN total / 30.0 <= 150 THEN 'WITHIN TARGET' WHEN total / 30.0 <= 300 THEN 'MANAGEABLE' ELSE 'ALARM FLOOD' END AS verdict FROM (SELECT method, count(*) AS total FROM anomaly GROUP BY 1)", "per_day"))
def alarm_rate(spark, sf):
    return tidy(analysis.alarm_rate(B.anomalies(spark, sf), 30.0))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"


@query(sql(_ANOMALIES, f"SELECT * FROM anomaly WHERE severity IN ('CRITICAL', 'WARNING') ORDER BY {_RANK}, score DESC, reading_ts DESC, sensor_id, method, operating_state NULLS FIRST LIMIT 200", _DET))
def q04_anomaly_ranked(spark, sf):
    wanted = spark.createDataFrame([("CRITICAL",), ("WARNING",)], "severity string")
    return tidy(serve.ranked_anomalies(B.anomalies(spark, sf).join(wanted, "severity", "left_semi").select(*analysis.ANOMALY)))


@query(sql(_ANOMALIES, f"SELECT * FROM anomaly WHERE severity = 'WARNING' AND reading_ts >= '2024-01-04' ORDER BY reading_ts DESC, sensor_id, method, operating_state NULLS FIRST LIMIT 20 OFFSET 5", _DET))
def anomalies_page(spark, sf):
    return tidy(serve.anomaly_page(B.anomalies(spark, sf), 20, 5, severity="WARNING", method=None, start="2024-01-04 00:00:00").rows)


@query(ORACLES["anomalies_page"])
def anomalies_keyset_page(spark, sf):
    """The same page by its place in a stored order: after the last key of a page of five."""
    wanted = serve.optional(B.anomalies(spark, sf), severity="WARNING", start="2024-01-04 00:00:00")
    stored = archive.built(spark, sf, "anomaly_order", lambda: wanted.withColumn("severity_order", serve.severity_rank()).repartitionByRange(*serve._keys(serve.ANOMALY_ORDER)).sortWithinPartitions(*serve._keys(serve.ANOMALY_ORDER)))
    five = serve.keyset_page(stored, serve.ANOMALY_ORDER, 5).collect()
    return tidy(serve.keyset_page(stored, serve.ANOMALY_ORDER, 20, serve.cursor_of(five, serve.ANOMALY_ORDER)).drop("severity_order"))


@query(sql(_ANOMALIES, f"SELECT * FROM anomaly WHERE reading_ts >= (SELECT max(reading_ts) FROM nb) - to_hours(240) ORDER BY {_RANK}, score DESC, reading_ts, sensor_id, method, operating_state NULLS FIRST LIMIT 50", _DET))
def anomalies_active(spark, sf):
    return tidy(serve.active_anomalies(B.anomalies(spark, sf), views.bounds(narrow(spark, sf)), hours=240))


@query(sql(_ANOMALIES, "SELECT count(*) AS total FROM anomaly WHERE severity = 'WARNING' AND reading_ts >= '2024-01-04'"))
def anomalies_total(spark, sf):
    """How many rows the pages of ``anomalies_page`` hold together."""
    return serve.anomaly_page(B.anomalies(spark, sf), 20, 5, severity="WARNING", start="2024-01-04 00:00:00").total


@query(sql(_ANOMALIES, "SELECT sensor_code, count(*) AS anomalies FROM anomaly JOIN sensor USING (sensor_id) WHERE reading_ts >= (SELECT max(reading_ts) FROM nb) - to_days(20) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def anomaly_top_sensors(spark, sf):
    return tidy(views.top_sensors(B.anomalies(spark, sf), A.sensors(spark), views.bounds(narrow(spark, sf)), 20))


@query(sql(_ANOMALIES, "SELECT method, severity, sensor_id, count(*) AS anomalies FROM anomaly WHERE reading_ts >= (SELECT max(reading_ts) FROM nb) - to_days(20) GROUP BY ALL"))
def anomaly_counts(spark, sf):
    end = views.bounds(narrow(spark, sf)).select("last_ts")
    d = B.anomalies(spark, sf).crossJoin(end).where(F.col("reading_ts") >= F.col("last_ts") - F.make_dt_interval(F.lit(20)))
    return tidy(d.groupBy("method", "severity", "sensor_id").agg(F.count(F.lit(1)).alias("anomalies")))


@query(
    sql(
        _ANOMALIES,
        """SELECT 1::BIGINT AS equipment_id, 'UNIT-1' AS equipment_code, 'Compressor unit' AS equipment_name, 5::BIGINT AS sensor_count, t AS last_reading_ts, n AS total_readings, c AS critical_anomalies, w AS warning_anomalies, 4::BIGINT AS recorded_failures,
 CASE WHEN t IS NULL THEN 'NO DATA' WHEN c > 0 THEN 'CRITICAL' WHEN w > 0 THEN 'WARNING' ELSE 'NORMAL' END AS health_status,
 CASE WHEN t IS NULL THEN 'No readings have been ingested for this equipment.' WHEN c > 0 THEN c || ' critical anomal' || CASE WHEN c = 1 THEN 'y' ELSE 'ies' END || ' in the last 24 hours of the archive.' WHEN w > 0 THEN w || ' warning-level anomal' || CASE WHEN w = 1 THEN 'y' ELSE 'ies' END || ' in the last 24 hours of the archive.' ELSE 'No anomalies in the last 24 hours of the archive.' END AS status_reason
 FROM (SELECT max(reading_ts) AS t, count(*) AS n FROM nb), (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w FROM anomaly WHERE reading_ts >= (SELECT max(reading_ts) FROM nb) - to_hours(24))""",
    )
)
def view_equipment_health(spark, sf):
    n = narrow(spark, sf)
    return tidy(views.equipment_health(A.equipment(spark), A.sensors(spark), n, B.anomalies(spark, sf), A.failures(spark)))


@query(sql(S, f"SELECT strftime(d, '%Y-%m-%d') AS bucket_date, n AS usable_scans, a AS off_scans, b AS offloaded_scans, c AS loaded_scans, e AS starting_scans, 100.0 * c / n AS loaded_pct, (b + c + e) * {B.SCAN_SQL}::DOUBLE / 3600.0 AS running_hours, p AS running_pct, CASE WHEN count(p) OVER w >= 3 THEN avg(p) OVER w END AS running_pct_7d FROM (SELECT *, 100.0 * (b + c + e) / n AS p FROM (SELECT reading_ts::DATE AS d, count(*) AS n, count(*) FILTER (WHERE operating_state = 'OFF') AS a, count(*) FILTER (WHERE operating_state = 'OFFLOADED') AS b, count(*) FILTER (WHERE operating_state = 'LOADED') AS c, count(*) FILTER (WHERE operating_state = 'STARTING') AS e FROM st WHERE NOT is_stale GROUP BY 1)) WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", "loaded_pct running_hours running_pct running_pct_7d"))
def duty_cycle_daily(spark, sf):
    return tidy(analysis.duty_cycle(states(spark, sf).where("not is_stale"), B.scan_seconds(spark, sf)))


# --- failures and forecasts -------------------------------------------------------

_WIN = "failure CROSS JOIN (VALUES (24), (12), (6), (1)) v(hours) JOIN nb ON nb.reading_ts >= start_ts - to_hours(hours) AND nb.reading_ts < start_ts JOIN st ON st.reading_ts = nb.reading_ts"


@query(
    sql(
        S + BASE,
        f"""SELECT sensor_id, operating_state, source_reference, hours, total_scans, usable_scans, x.mean_value, base.mean_value AS baseline_mean, base.stddev_value AS baseline_sd, usable_scans * 1.0 / total_scans >= 0.5 AND x.mean_value IS NOT NULL AS is_usable,
 CASE WHEN usable_scans * 1.0 / total_scans >= 0.5 AND base.stddev_value > 0 THEN (x.mean_value - base.mean_value) / base.stddev_value END AS z_vs_baseline
 FROM (SELECT nb.sensor_id, operating_state, source_reference, hours::BIGINT AS hours, count(*) AS total_scans, count(*) FILTER (WHERE q >= 64 AND q <> 65) AS usable_scans, avg(value) FILTER (WHERE q >= 64 AND q <> 65) AS mean_value FROM {_WIN} GROUP BY ALL) x LEFT JOIN base USING (sensor_id, operating_state)""",
        "mean_value baseline_mean baseline_sd z_vs_baseline",
    )
)
def failure_windows(spark, sf):
    n = narrow(spark, sf)
    return tidy(analysis.window_analysis(n, states(spark, sf), A.failures(spark), B.baseline(spark, sf)))


@query(
    sql(
        S + BASE,
        f"""SELECT source_reference AS event, hours AS hours_before, operating_state AS state, scans, held, 100.0 * (scans - held) / scans AS usable_pct, m AS mean, nullif(mean_value, 0) AS baseline_mean, CASE WHEN stddev_value > 0 THEN (m - mean_value) / stddev_value END AS z
 FROM (SELECT operating_state, source_reference, hours::BIGINT AS hours, count(*) AS scans, count(*) FILTER (WHERE q = 65) AS held, avg(value) FILTER (WHERE q <> 65) AS m FROM {_WIN} WHERE nb.sensor_id = 1 GROUP BY ALL) LEFT JOIN (FROM base WHERE sensor_id = 1) USING (operating_state)""",
        "usable_pct mean baseline_mean z",
    )
)
def state_comparison(spark, sf):
    n = narrow(spark, sf)
    return tidy(analysis.state_comparison(n, states(spark, sf), A.failures(spark), B.baseline(spark, sf), 1))


@query(
    sql(
        _ANOMALIES,
        """SELECT method, i AS anomalies_in_windows, total - i AS anomalies_elsewhere, wh AS window_hours, oh AS other_hours, i / wh AS rate_in_windows_per_hour, (total - i) / oh AS rate_elsewhere_per_hour, (i / wh) / nullif((total - i) / oh, 0) AS enrichment
 FROM (SELECT method, count(*) AS total, sum((SELECT count(*) FROM failure WHERE a.reading_ts >= start_ts - to_hours(24) AND a.reading_ts < end_ts))::BIGINT AS i FROM anomaly a GROUP BY 1),
 (SELECT wh, greatest(ah - wh, 1.0) AS oh FROM (SELECT sum(date_diff('second', start_ts - to_hours(24), end_ts)) / 3600.0 AS wh FROM failure), (SELECT date_diff('hour', min(reading_ts), max(reading_ts)) AS ah FROM nb))""",
        "window_hours other_hours rate_in_windows_per_hour rate_elsewhere_per_hour enrichment",
    )
)
def lead_time_enrichment(spark, sf):
    return tidy(analysis.lead_time(B.anomalies(spark, sf), A.failures(spark), views.bounds(narrow(spark, sf))))


_DAYS = "SELECT sensor_id, bucket_start::DATE AS bucket_date, sum(avg_value * sample_count) / sum(sample_count) AS value, sum(sample_count)::BIGINT AS samples FROM hs WHERE operating_state = 'OFFLOADED' GROUP BY 1, 2 HAVING sum(sample_count) >= 2"


def _daily(spark, sf):
    return analysis.daily_series(B.hourly_state(spark, sf), "OFFLOADED", 2)


@query(sql(S + HS, f"SELECT sensor_id, strftime(bucket_date, '%Y-%m-%d') AS bucket_date, value, samples FROM ({_DAYS})", "value"))
def daily_series(spark, sf):
    return tidy(_daily(spark, sf))


@query(
    sql(
        S + HS,
        f"""SELECT *, CASE WHEN method <> 'naive_persistence' THEN 100.0 * (nm - mae) / nullif(nm, 0) END AS improvement_pct FROM (SELECT *, max(CASE WHEN method = 'naive_persistence' THEN mae END) OVER (PARTITION BY sensor_id) AS nm FROM (
 SELECT sensor_id, method, avg(abs(value - p)) AS mae, sqrt(avg((value - p) ** 2)) AS rmse, CASE WHEN min(abs(value)) > 1e-6 THEN avg(100.0 * abs(value - p) / abs(value)) END AS mape, count(*) AS n FROM (
  SELECT sensor_id, value, 'naive_persistence' AS method, nv AS p FROM x UNION ALL SELECT sensor_id, value, 'moving_average_5d', ma FROM x) GROUP BY 1, 2))""".replace(
            "FROM x", f"FROM (SELECT * FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY sensor_id) AS z, lag(value) OVER w AS nv, avg(value) OVER (PARTITION BY sensor_id ORDER BY bucket_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma FROM ({_DAYS}) WINDOW w AS (PARTITION BY sensor_id ORDER BY bucket_date)) WHERE z >= 15 AND k > z - 7)"
        ),
        "mae rmse mape improvement_pct",
    ).replace("FROM (SELECT *, CASE", "FROM (SELECT * EXCLUDE (nm), CASE")
)
def forecast_naive_ma(spark, sf):
    return tidy(analysis.forecast_scores(_daily(spark, sf), 7, 5, 3))


@query(
    f"WITH s AS (FROM ({ORACLES['forecast_naive_ma']})) SELECT sensor_id, n.mae AS benchmark_mae, m.method AS best_method, m.mae AS best_mae, CASE WHEN m.mae < n.mae THEN 'BEATS PERSISTENCE' ELSE 'NOTHING BEATS PERSISTENCE' END AS verdict FROM s n JOIN s m USING (sensor_id) WHERE n.method = 'naive_persistence' AND m.method <> n.method"
)
def forecast_verdict(spark, sf):
    return tidy(analysis.forecast_verdict(analysis.forecast_scores(_daily(spark, sf), 7, 5, 3)))


def _smoothing(rounds: int = 4) -> str:
    """Additive-trend smoothing in SQL: the same grid, refined as often, one reduction over
    a series for each pair of parameters."""
    edge = lambda c, i: f"greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN {i} = 10 THEN {c} + w ELSE {i} * ((({c} + w) - ({c} - w)) / 10) + ({c} - w) END))"
    ahead = "(m.l + m.s)"
    level = f"(a * z.x + (1 - a) * {ahead})"
    step = f"lambda m, z: {{'l': {level}, 's': b * ({level} - m.l) + (1 - b) * m.s, 'e': m.e + (z.x - {ahead}) * (z.x - {ahead}), 'x': z.x}}"
    states = "list_concat([{'l': ys[1], 's': ys[2] - ys[1], 'e': 0::DOUBLE, 'x': ys[1]}], [{'l': 0::DOUBLE, 's': 0::DOUBLE, 'e': 0::DOUBLE, 'x': v} FOR v IN ys[2:]])"
    ctes = f""",
y AS (SELECT sensor_id, list(value ORDER BY bucket_date) AS y FROM ({_DAYS}) GROUP BY 1 HAVING count(*) >= 15),
g0 AS (SELECT sensor_id, y[k + 1] AS actual, k, y[1:k] AS ys, 0.5::DOUBLE AS ca, 0.5::DOUBLE AS cb, 0.5::DOUBLE AS w, NULL::DOUBLE AS p FROM (SELECT *, unnest(range(len(y) - 7, len(y))) AS k FROM y))"""
    for r in range(rounds):
        ctes += f""",
t{r} AS (SELECT *, list_reduce({states}, {step}) AS m FROM (SELECT *, {edge("ca", "ia")} AS a, {edge("cb", "ib")} AS b FROM g{r}, range(11) i(ia), range(11) j(ib))),
g{r + 1} AS (SELECT sensor_id, actual, k, ys, best.a AS ca, best.b AS cb, w / 4 AS w, best.p AS p FROM (SELECT sensor_id, actual, k, ys, w, min({{'e': m.e, 'at': 11 * ib + ia, 'a': a, 'b': b, 'p': m.l + m.s}}) AS best FROM t{r} GROUP BY ALL))"""
    return ctes + f", f AS (SELECT sensor_id, actual AS value, p FROM g{rounds})"


@query(
    sql(
        S + HS + _smoothing(),
        "SELECT sensor_id, 'holt_winters_additive' AS method, avg(abs(value - p)) AS mae, sqrt(avg((value - p) ** 2)) AS rmse, CASE WHEN min(abs(value)) > 1e-6 THEN avg(100.0 * abs(value - p) / abs(value)) END AS mape, count(*) AS n FROM f GROUP BY 1",
        "mae rmse mape",
    )
)
def forecast_holt_winters(spark, sf):
    return tidy(analysis.holt_winters_scores(_daily(spark, sf), 7, 5, 3))


# --- quality, profile -------------------------------------------------------------


@query(
    sql(
        S,
        f"""SELECT total_readings, good_readings, held_readings, 100.0 * good_readings / total_readings AS good_pct, 100.0 * held_readings / total_readings AS held_pct, (SELECT count(*) FROM ordered WHERE reject IS NOT NULL) AS quarantined_rows, (SELECT count(*) FROM ordered WHERE reject IS NULL AND delta > {B.GAP_SQL}) AS gap_count,
 100.0 * (SELECT count(*) FROM st) / ((epoch_us(z) - epoch_us(a)) / 1e6 / {B.SCAN_SQL} + 1) AS coverage_pct FROM (SELECT count(*) AS total_readings, count(*) FILTER (WHERE q = 192) AS good_readings, count(*) FILTER (WHERE q = 65) AS held_readings, min(reading_ts) AS a, max(reading_ts) AS z FROM nb)""",
        "good_pct held_pct coverage_pct",
    )
)
def archive_quality(spark, sf):
    o = ordered(spark, sf)
    n = narrow(spark, sf)
    return tidy(views.archive_quality(n, o.where("reject is not null"), validate.gaps(o, B.gap_seconds(spark, sf), B.scan_seconds(spark, sf)), states(spark, sf).agg(F.count(F.lit(1)).alias("scans")), B.scan_seconds(spark, sf)))


@query(
    sql(
        S,
        "SELECT signal, rows, nulls, distinct_values, mode_value, min_value, max_value, mean_value, stddev_value, p25, p50, p75 FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS signal, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, (SELECT {c} FROM scans WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_value, min({c}) AS min_value, max({c}) AS max_value, avg({c}) AS mean_value, stddev_samp({c}) AS stddev_value, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM scans"
            for c in A.WIDE
        )
        + ")",
        "mode_value min_value max_value mean_value stddev_value p25 p50 p75",
    )
)
def profile_columns(spark, sf):
    return tidy(profile.columns(B.scans(spark, sf), list(A.WIDE)))


@query(sql(S, "SELECT date_diff('second', p, scan_ts) AS seconds, count(*) AS steps FROM (SELECT scan_ts, lag(scan_ts) OVER (ORDER BY scan_ts) AS p FROM scans) WHERE p IS NOT NULL GROUP BY 1"))
def profile_intervals(spark, sf):
    return tidy(profile.intervals(B.scans(spark, sf)))


@query(sql(S, "SELECT strftime(scan_ts::DATE, '%Y-%m-%d') AS bucket_date, count(*) AS scans, 100.0 * count(*) / (86400.0 / (SELECT scan FROM sp))::DOUBLE AS coverage_pct, 100.0 * count(*) / (86400.0 / (SELECT scan FROM sp))::DOUBLE < 50 AS is_low FROM scans GROUP BY ALL", "coverage_pct"))
def profile_coverage(spark, sf):
    return tidy(profile.coverage(B.scans(spark, sf), 86400.0 / B.scan_seconds(spark, sf)))


@query(sql(S, "SELECT strftime(scan_ts, '%Y-%m') AS month, count(*) AS scans, (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM raw GROUP BY stamp)) AS repeated_stamps FROM scans GROUP BY 1"))
def profile_months(spark, sf):
    return tidy(profile.monthly(B.scans(spark, sf)).crossJoin(profile.duplicates(B.raw_scans(spark, sf), ["timestamp"]).withColumnRenamed("duplicate_rows", "repeated_stamps")))


@query(sql(S, f"SELECT failure_event_id, source_reference, date_diff('second', start_ts, end_ts) // {B.SCAN_SQL} + 1 AS expected_scans, count(scan_ts) AS scans, avg(click) AS mean_click, avg(view) AS mean_view FROM failure LEFT JOIN scans ON scan_ts >= start_ts AND scan_ts <= end_ts GROUP BY failure_event_id, source_reference, start_ts, end_ts", "mean_click mean_view"))
def profile_failures(spark, sf):
    return tidy(profile.failure_profile(B.scans(spark, sf), A.failures(spark), ["click", "view"], B.scan_seconds(spark, sf)))


_SAME_ALL = " AND ".join(f"coalesce({c} = lag({c}) OVER w, false)" for c in A.ANALOGUE)


@query(sql(S, f"SELECT min(scan_ts) AS block_start, max(scan_ts) AS block_end, count(*) AS frozen_scans FROM (SELECT *, sum((NOT eq)::INT) OVER (ORDER BY scan_ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT scan_ts, {_SAME_ALL} AS eq FROM scans WINDOW w AS (ORDER BY scan_ts))) WHERE eq GROUP BY g ORDER BY frozen_scans DESC, block_start LIMIT 10"))
def frozen_blocks(spark, sf):
    return tidy(profile.frozen_blocks(B.scans(spark, sf), list(A.ANALOGUE)))


@query(
    sql(
        S,
        """SELECT signal, run, value, run_start FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY run DESC, run_start) AS k FROM (SELECT signal, count(*) AS run, min(scan_ts) AS run_start, max(v) AS value FROM (
 SELECT *, sum((v IS DISTINCT FROM p)::INT) OVER (PARTITION BY signal ORDER BY scan_ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY signal ORDER BY scan_ts) AS p FROM (UNPIVOT scans ON click, error, purchase, view, signup INTO NAME signal VALUE v))) GROUP BY signal, g)) WHERE k = 1""",
        "value",
    )
)
def longest_constant_run(spark, sf):
    return tidy(profile.longest_constant(B.scans(spark, sf), list(A.WIDE)))


_RUNS = """ev AS (SELECT o_custkey AS run_id, 'file-' || o_custkey % 7 AS source_file, 'sha-' || o_custkey % 7 AS source_sha256, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'PARTIAL' ELSE 'FAILED' END AS status, make_timestamp(o_orderkey * 1000000) AS event_utc, floor(o_totalprice)::BIGINT AS rows_read FROM orders),
runs AS (SELECT run_id, arg_max(source_file, event_utc) AS source_file, arg_max(source_sha256, event_utc) AS source_sha256, arg_max(status, event_utc) AS status, max(event_utc) AS completed_utc, arg_max(rows_read, event_utc) AS rows_read, min(event_utc) AS started_utc FROM ev GROUP BY 1)"""


def _runs(spark, sf):
    """The ledger of a log of status events: orders, each of the run its customer stands for."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAILED")
    named = lambda prefix: F.concat(F.lit(prefix), (F.col("o_custkey") % 7).cast("string"))
    none = F.lit(0).cast("long")
    log = o.select(
        F.col("o_custkey").alias("run_id"), named("file-").alias("source_file"), named("sha-").alias("source_sha256"), status.alias("status"), F.timestamp_seconds("o_orderkey").cast("timestamp_ntz").alias("event_utc"),
        F.floor("o_totalprice").cast("long").alias("rows_read"), none.alias("rows_inserted"), none.alias("rows_skipped"), none.alias("rows_rejected"),
    )
    return archive.ledger(log).drop("rows_inserted", "rows_skipped", "rows_rejected")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def run_history(spark, sf):
    return _runs(spark, sf)


@query(f"WITH {_RUNS} SELECT source_sha256, max(run_id) AS run_id, count(*) AS runs FROM runs WHERE status = 'SUCCEEDED' GROUP BY 1")
def last_ingestion(spark, sf):
    """The newest load of every file that succeeded in full."""
    return archive.completed_runs(_runs(spark, sf)).select("source_sha256", "run_id", "runs")


@query(f"WITH {_RUNS} SELECT * FROM runs WHERE source_sha256 = 'sha-3' AND status = 'SUCCEEDED' ORDER BY run_id DESC LIMIT 1")
def completed_run(spark, sf):
    return archive.completed_run(_runs(spark, sf), "sha-3").drop("runs")


@query(f"WITH {_RUNS} SELECT * FROM runs ORDER BY status <> 'SUCCEEDED', run_id DESC LIMIT 1")
def last_full_run(spark, sf):
    return archive.last_run(_runs(spark, sf))


# --- compression ------------------------------------------------------------------


PERCENT, SWEEP = 5.0, (1.0, 5.0, 10.0, 25.0)


def _archive(spark, sf):
    r = narrow(spark, sf).where("sensor_id in (1, 2, 3, 5)")
    return r, compress.deviations(r, PERCENT)


def _kept(spark, sf):
    """What compression leaves of the archive; built once, as several queries read it."""
    return archive.built(spark, sf, "kept", lambda: compress.compress(*_archive(spark, sf), 6 * B.GAP))


def _swept(spark, sf):
    """Statistics of every sensor and setting, of kept readings that are stored once."""
    stored = lambda d: archive.built(spark, sf, "swept", lambda: d)
    return compress.sweep_by_sensor(_archive(spark, sf)[0], SWEEP, 6 * B.GAP, stored=stored)


def _door(percents) -> str:
    """The swinging door in SQL: one reduction over the readings of a piece, then chords split where they err."""
    top, low = (f"CASE WHEN z.x > m.ax THEN {f}(m.{k}, (z.v {op} e - m.av) / (z.x - m.ax)) ELSE m.{k} END" for f, k, op in (("least", "top", "+"), ("greatest", "low", "-")))
    pick = lambda shut, on: f"CASE WHEN {low} > {top} THEN {shut} ELSE {on} END"
    step = f"lambda m, z: {{'x': z.x, 'v': z.v, 'i': z.i, 'ax': {pick('m.x', 'm.ax')}, 'av': {pick('m.v', 'm.av')}, 'top': {pick('(z.v + e - m.v) / (z.x - m.x)', top)}, 'low': {pick('(z.v - e - m.v) / (z.x - m.x)', low)}, 'marks': {pick('list_append(m.marks, m.i)', 'm.marks')}}}"
    first = "{'x': x, 'v': v, 'i': i, 'ax': x, 'av': v, 'top': 'inf'::DOUBLE, 'low': '-inf'::DOUBLE, 'marks': []::BIGINT[]}"
    off = "abs(vs[k] - (vs[1] + (vs[-1] - vs[1]) / (xs[-1] - xs[1]) * (xs[k] - xs[1])))"
    return (
        S
        + f""",
ar AS (SELECT *, epoch_us(reading_ts) // 1000 AS ms, lag(epoch_us(reading_ts) // 1000) OVER k AS pms, lag(q) OVER k AS pq, row_number() OVER k AS rn FROM nb WHERE sensor_id IN (1, 2, 3, 5) WINDOW k AS (PARTITION BY sensor_id ORDER BY reading_ts)),
ab AS (SELECT *, sum((pms IS NULL OR (ms - pms) / 1000.0 > {6 * B.GAP} OR pq <> q)::INT) OVER (PARTITION BY sensor_id ORDER BY reading_ts ROWS UNBOUNDED PRECEDING) AS segment, (rn - 1) // {compress.CUT_ROWS} AS piece FROM ar),
dev AS (SELECT sensor_id, pct, CASE WHEN hi > lo THEN (hi - lo) * (pct / 100.0::DOUBLE) ELSE 0 END AS deviation FROM (SELECT sensor_id, min(value) AS lo, max(value) AS hi FROM ab GROUP BY 1), (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in percents)}]) AS pct)),
p0 AS (SELECT sensor_id, pct, segment, piece, reading_ts, value AS v, q, deviation AS e, ms / 1000.0::DOUBLE AS t, row_number() OVER k - 1 AS i FROM ab JOIN dev USING (sensor_id) WINDOW k AS (PARTITION BY sensor_id, pct, segment, piece ORDER BY reading_ts)),
p AS MATERIALIZED (SELECT *, sensor_id || '/' || pct || '/' || segment || '/' || piece AS g, max(i) OVER (PARTITION BY sensor_id, pct, segment, piece) AS z, t - min(t) OVER (PARTITION BY sensor_id, pct, segment, piece) AS x FROM p0),
walk AS MATERIALIZED (SELECT g, e, xs, vs, list_concat([0::BIGINT], list_reduce(path, {step}).marks, [len(xs)::BIGINT - 1]) AS m FROM (SELECT g, any_value(e) AS e, list(x ORDER BY i) AS xs, list(v ORDER BY i) AS vs, list({first} ORDER BY i) AS path FROM p WHERE z >= 2 AND e > 0 GROUP BY g)),
chords(g, e, a, xs, vs) AS (
  SELECT g, e, m[k], xs[m[k] + 1:m[k + 1] + 1], vs[m[k] + 1:m[k + 1] + 1] FROM (SELECT *, unnest(range(1, len(m))) AS k FROM walk)
  UNION ALL SELECT g, e, unnest([a, a - w.k - 1]), unnest([xs[:-w.k], xs[-w.k:]]), unnest([vs[:-w.k], vs[-w.k:]]) FROM (
   SELECT *, list_max([{{'o': {off}, 'k': -k}} FOR k IN range(2, len(xs))]) AS w FROM chords WHERE len(xs) > 2 AND xs[-1] > xs[1]) WHERE w.o > e),
kept AS (SELECT p.* FROM p WHERE i = 0 OR i = z OR z < 2 OR e <= 0 UNION ALL SELECT p.* FROM p JOIN (SELECT DISTINCT g, a FROM chords WHERE a > 0) c ON c.g = p.g AND c.a = p.i WHERE p.z >= 2 AND p.e > 0),
line AS (SELECT a.sensor_id, a.pct, a.v, a.e, b.reading_ts AS pt, b.v AS pv, c.reading_ts AS nt, c.v AS nv, a.reading_ts AS at_ts FROM p a ASOF JOIN kept b ON b.sensor_id = a.sensor_id AND b.pct = a.pct AND b.reading_ts <= a.reading_ts ASOF LEFT JOIN kept c ON c.sensor_id = a.sensor_id AND c.pct = a.pct AND c.reading_ts > a.reading_ts),
err AS (SELECT *, abs(v - CASE WHEN pt = at_ts OR nt IS NULL THEN pv ELSE coalesce(pv + (nv - pv) * ((epoch_us(at_ts) // 1000 - epoch_us(pt) // 1000) / nullif(epoch_us(nt) // 1000 - epoch_us(pt) // 1000, 0)::DOUBLE), pv) END) AS off FROM line),
stat AS (SELECT sensor_id, pct, count(*) AS original_count, max(off) AS max_error, avg(off) AS mean_error, sqrt(avg(off * off)) AS rmse, any_value(e) AS deviation FROM err GROUP BY 1, 2),
stats AS (SELECT *, original_count::DOUBLE / kept_count AS compression_ratio, 100.0::DOUBLE * kept_count / original_count AS retained_pct, max_error / nullif(deviation, 0) AS budget_used, max_error <= deviation + greatest(deviation * 1e-6, 1e-9) AS within_bound FROM stat JOIN (SELECT sensor_id, pct, count(*) AS kept_count FROM kept GROUP BY 1, 2) USING (sensor_id, pct))"""
    )


def _recursive(percents, body: str, doubles: str) -> str:
    return sql(_door(percents), body, doubles).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive((PERCENT,), "SELECT sensor_id, reading_ts, v AS value, q AS quality_code_id, e AS deviation FROM kept", "value deviation"))
def compress_sdt(spark, sf):
    return tidy(_kept(spark, sf))


@query(_recursive((PERCENT,), "SELECT * EXCLUDE (pct) FROM stats", "max_error mean_error rmse deviation compression_ratio retained_pct budget_used"))
def compression_summary(spark, sf):
    r, dev = _archive(spark, sf)
    return tidy(compress.compression_stats(r, _kept(spark, sf), dev))


@query(_recursive(SWEEP, "SELECT pct, sum(original_count)::BIGINT AS original_count, sum(kept_count)::BIGINT AS kept_count, max(budget_used) AS worst_budget_used, count(*) FILTER (WHERE NOT within_bound) AS violations, sum(original_count)::DOUBLE / sum(kept_count) AS compression_ratio FROM stats GROUP BY 1", "pct worst_budget_used compression_ratio"))
def compress_sweep(spark, sf):
    return tidy(compress.sweep_totals(_swept(spark, sf)))


@query(_recursive(SWEEP, "SELECT * FROM stats", "pct max_error mean_error rmse deviation compression_ratio retained_pct budget_used"))
def compress_sweep_sensors(spark, sf):
    """Kept and original counts, errors and budgets of every sensor under every setting."""
    return tidy(_swept(spark, sf))


_ASKED = """SELECT q.sensor_id, q.reading_ts AS "at", CASE WHEN p.reading_ts = q.reading_ts OR x.reading_ts IS NULL THEN p.v ELSE p.v + (x.v - p.v) * ((epoch_us(q.reading_ts) // 1000 - epoch_us(p.reading_ts) // 1000) / (epoch_us(x.reading_ts) // 1000 - epoch_us(p.reading_ts) // 1000)::DOUBLE) END AS value,
 CASE WHEN p.reading_ts = q.reading_ts THEN 'EXACT' WHEN x.reading_ts IS NULL THEN 'HELD_END_OF_ARCHIVE' ELSE 'INTERPOLATED' END AS method, p.reading_ts AS prev_ts, x.reading_ts AS next_ts, date_diff('second', p.reading_ts, x.reading_ts) AS bracket_seconds
 FROM p q ASOF JOIN kept p ON p.sensor_id = q.sensor_id AND p.reading_ts <= q.reading_ts ASOF LEFT JOIN kept x ON x.sensor_id = q.sensor_id AND x.reading_ts > q.reading_ts WHERE x.reading_ts IS NULL OR date_diff('second', p.reading_ts, x.reading_ts) <= {limit}"""


@query(_recursive((PERCENT,), _ASKED.format(limit=6 * B.GAP), "value"))
def value_at_compressed(spark, sf):
    """Every analogue reading asked of the archive that compression left of them."""
    r, _ = _archive(spark, sf)
    return tidy(compress.value_at(_kept(spark, sf), r.select("sensor_id", F.col("reading_ts").alias("at")), A.sensors(spark), 6 * B.GAP))


# --- further profile and analysis -------------------------------------------------


@query(sql(S, "SELECT band, count(*) AS scans, min(view) AS min_value, max(view) AS max_value FROM (SELECT view, ((view >= 15)::INT + (view >= 35)::INT + (view >= 70)::INT)::BIGINT AS band FROM scans WHERE view IS NOT NULL) GROUP BY 1", "min_value max_value"))
def profile_bands(spark, sf):
    return tidy(profile.band_counts(B.scans(spark, sf), "view", A.BANDS))


@query(sql(S, "SELECT signal, value, count(*) AS scans FROM (SELECT 'click' AS signal, click AS value FROM scans UNION ALL SELECT 'signup', signup FROM scans) GROUP BY 1, 2", "value"))
def profile_values(spark, sf):
    return tidy(profile.value_counts(B.scans(spark, sf), ["click", "signup"]))


@query(sql(S, "SELECT count(*) AS scans, count(*) FILTER (WHERE (click < 40)::INT = signup) AS agreeing, 100.0 * count(*) FILTER (WHERE (click < 40)::INT = signup) / nullif(count(*), 0) AS agreement_pct FROM scans WHERE click IS NOT NULL AND signup IS NOT NULL", "agreement_pct"))
def profile_setpoint(spark, sf):
    return tidy(profile.setpoint_agreement(B.scans(spark, sf), "click", "signup", B.SETPOINT))


@query(sql(S, "SELECT source_reference, hours::BIGINT AS hours, count(scan_ts) AS scans, count(*) FILTER (WHERE is_stale) AS held, 100.0 * count(*) FILTER (WHERE is_stale) / nullif(count(scan_ts), 0) AS held_pct FROM failure CROSS JOIN (VALUES (24), (12), (6), (1)) v(hours) LEFT JOIN clean ON scan_ts >= start_ts - to_hours(hours) AND scan_ts < start_ts GROUP BY ALL", "held_pct"))
def frozen_contamination(spark, sf):
    return tidy(profile.contamination(clean_scans(spark, sf), analysis.lead_up_windows(A.failures(spark))))


@query(sql(S + BASE, "SELECT sensor_id, count(*) AS readings, count(*) FILTER (WHERE value < lo OR value > hi) AS flagged, 100.0 * count(*) FILTER (WHERE value < lo OR value > hi) / count(*) AS flagged_pct FROM nb JOIN st USING (reading_ts) JOIN base USING (sensor_id, operating_state) WHERE q >= 64 AND q <> 65 AND NOT is_stale GROUP BY 1", "flagged_pct"))
def naive_flag_rate(spark, sf):
    return tidy(analysis.naive_flag_rate(narrow(spark, sf), states(spark, sf), B.baseline(spark, sf)))


@query(sql(S + HS, "SELECT sensor_id, operating_state, strftime(bucket_start, '%Y-%m') AS month, sum(avg_value * sample_count) / sum(sample_count) AS mean_value, sum(sample_count)::BIGINT AS samples FROM hs GROUP BY ALL", "mean_value"))
def monthly_state_means(spark, sf):
    return tidy(analysis.monthly_state_means(B.hourly_state(spark, sf)))
