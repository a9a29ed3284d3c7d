"""What the registered queries share: archives, settings, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import analysis, rollup, validate
from tidemark.sources import adapters as A
from tidemark.sources.archive import built

# Settings for sparse events; the operators' defaults are those of a ten-second archive.
PER_HOUR, PER_DAY, GAP, USUAL, MOST = 4.0, 96.0, 3600, 900, 3600
LOW_LIMIT, HIGH_LIMIT = 0.0, 300.0
#: Scans come as densely as events; a gap is a step of so many average steps.
GAP_SCANS = 5
SCAN_SQL, GAP_SQL = "(SELECT scan FROM sp)", f"(SELECT {GAP_SCANS} * scan FROM sp)"
APART = 60.0
WINDOW, HISTORY, PERSIST, MIN_SAMPLES = 48, 12, 2, 20
BASE_FROM, BASE_TO, BASE_NAME = "2024-01-01 00:00:00", "2024-01-21 00:00:00", "REFERENCE"
SETPOINT, SETPOINT_CRITICAL = 40.0, 5.0
FROM, TO = "2024-01-05 00:00:00", "2024-01-15 00:00:00"
SIGNALS = [(s[0], s[1], LOW_LIMIT, HIGH_LIMIT, s[3] == "Digital") for s in sorted(A.SENSORS)]
RAW_COLUMNS = ["source_index", "timestamp", *A.WIDE]
CURRENT_ID, SWITCH_ID, PRESSURE_ID = 5, 4, 1
NUDGE = 1e-10  # before rounding, so that exact ties fall the same way in both engines


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers to long, dates to text: one form for both engines."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("double", "float"):
            x = F.round(x.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        elif t == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        out.append(x.alias(c))
    return df.select(*out)


def between(df: DataFrame, time: str = "reading_ts", start: str = FROM, end: str = TO) -> DataFrame:
    return df.where((F.col(time) >= F.to_timestamp_ntz(F.lit(start))) & (F.col(time) < F.to_timestamp_ntz(F.lit(end))))


_seconds: dict[tuple[str, str], int] = {}


def scan_seconds(spark: SparkSession, sf_dir: str) -> int:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _seconds:
        _seconds[key] = A.scan_seconds(spark, sf_dir)
    return _seconds[key]


def gap_seconds(spark: SparkSession, sf_dir: str) -> int:
    return GAP_SCANS * scan_seconds(spark, sf_dir)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "scans", lambda: A.scans(spark, sf_dir))


def raw_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.raw_scans(scans(spark, sf_dir))


def ordered(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    d = lambda: validate.checked_order(raw_scans(spark, sf_dir), form=A.STAMP, **options)
    return d() if options else built(spark, sf_dir, "ordered", d)


def clean_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "clean", lambda: validate.frozen(ordered(spark, sf_dir), A.ANALOGUE))


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated scans as (sensor_id, reading_ts, value, quality_code_id)."""
    return built(spark, sf_dir, "narrow", lambda: validate.melted(clean_scans(spark, sf_dir), SIGNALS))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "states", lambda: analysis.scan_states(narrow(spark, sf_dir), CURRENT_ID, SWITCH_ID, A.BANDS))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``narrow`` with the states of its scans, where there is one; read from the scans, not stored."""
    return analysis.stated(clean_scans(spark, sf_dir), SIGNALS, CURRENT_ID, A.BANDS)


def hourly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "hourly_state", lambda: rollup.state_rollup(stated(spark, sf_dir), None, [1, 2, 3, 5]))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "baseline", lambda: analysis.baselines(stated(spark, sf_dir), None, BASE_FROM, BASE_TO, BASE_NAME, MIN_SAMPLES))


def episodes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return analysis.setpoint_episodes(narrow(spark, sf_dir), PRESSURE_ID, SETPOINT, gap_seconds=gap_seconds(spark, sf_dir), **options)


def detected(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    if method == "ADAPTIVE_MAD":
        return analysis.detect_mad(hourly_state(spark, sf_dir), WINDOW, HISTORY, PERSIST)
    if method == "BASELINE_IQR":
        return analysis.detect_iqr(hourly_state(spark, sf_dir), baseline(spark, sf_dir), 1)
    return analysis.detect_setpoint(episodes(spark, sf_dir), PRESSURE_ID, SETPOINT, SETPOINT_CRITICAL)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three detectors' findings."""
    three = lambda: reduce(DataFrame.unionByName, [detected(spark, sf_dir, m) for m in ("ADAPTIVE_MAD", "BASELINE_IQR", "SETPOINT")])
    return built(spark, sf_dir, "anomalies", three)


def _values(rows, types) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(f"{q(v)}::{t}" for v, t in zip(r, types)) + ")" for r in rows) + ")"


DIMS = f"""
sensor(sensor_id, sensor_code, sensor_name, sensor_class, unit, physical_min, physical_max, display_order) AS
 {_values(A.SENSORS, ("BIGINT", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE", "BIGINT"))},
quality(quality_code_id, code, family, is_usable) AS {_values(C.QUALITY, ("BIGINT", "VARCHAR", "VARCHAR", "BOOLEAN"))},
failure(failure_event_id, source_reference, start_ts, end_ts, failure_type, severity) AS
 {_values(A.FAILURES, ("BIGINT", "VARCHAR", "TIMESTAMP", "TIMESTAMP", "VARCHAR", "VARCHAR"))}"""

READINGS = (
    DIMS
    + """,
r AS (SELECT sensor_id, sensor_code, ts AS reading_ts, value, (CASE WHEN value < 1 THEN 8 WHEN event_id % 29 = 0 THEN 65 WHEN event_id % 101 = 0 THEN 16 ELSE 192 END)::BIGINT AS q
  FROM events JOIN sensor ON event_type = sensor_code)"""
)

_CELL = ", ".join(f"last_value(CASE WHEN event_type = '{c}' THEN value END IGNORE NULLS) OVER w AS {c}" for c in A.WIDE)
_IS_HELD = f"(day(scan_ts) IN {A.HELD_DAYS} AND hour(scan_ts) BETWEEN {A.HELD_HOURS[0]} AND {A.HELD_HOURS[1]})"
_HELD = ", ".join(f"CASE WHEN held THEN first_value({c}) OVER (PARTITION BY scan_ts::DATE, held ORDER BY scan_no) ELSE {c} END AS {c}" for c in A.WIDE)
_FAULTS = "CASE WHEN scan_no % 61 = 5 AND own <> 'click' THEN 999.0 ELSE click END AS click, CASE WHEN scan_no % 89 = 17 AND own <> 'purchase' THEN NULL ELSE purchase END AS purchase, CASE WHEN scan_no % 67 = 7 AND own <> 'signup' THEN 0.5 ELSE signup END AS signup"
_LINES = " UNION ALL ".join(
    f"SELECT scan_no * 10 AS source_index, 2 * scan_no + {k} AS source_line_no, {stamp} AS stamp, {', '.join(A.WIDE)} FROM faults{where}"
    for k, stamp, where in ((2, "stamp", ""), (3, "stamp", " WHERE scan_no % 97 = 31"), (9, "stamp", " WHERE scan_no % 97 = 53"), (3, "'not-a-timestamp'", " WHERE scan_no % 97 = 13"))
)
_SAME = " AND ".join(f"coalesce({c} = lag({c}) OVER w, false)" for c in A.ANALOGUE)


def _quality(c: str, digital: bool) -> str:
    odd = f"WHEN {c} NOT IN (0, 1) THEN 16 " if digital else ""
    return f"CASE WHEN {c} IS NULL THEN 0 {odd}WHEN {c} < {LOW_LIMIT} OR {c} > {HIGH_LIMIT} THEN 8 WHEN is_stale THEN 65 ELSE 192 END"


_CELLS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS sensor_id, scan_ts AS reading_ts, {c} AS value, ({_quality(c, d)})::BIGINT AS q FROM clean" for i, c, _, _, d in SIGNALS)

#: scans (wide), raw (as a file), ordered, clean (accepted, with is_stale), nb (narrow), st (states)
SCANS = (
    DIMS
    + f""",
sp AS (SELECT greatest(1, coalesce(date_diff('second', min(ts), max(ts)) // nullif(count(*), 0), 1)) AS scan FROM events),
s0 AS (SELECT event_id AS scan_no, ts AS scan_ts, event_type AS own, {_CELL} FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
s1 AS (SELECT * REPLACE ((signup > 30)::INT::DOUBLE AS signup), {_IS_HELD} AS held FROM s0),
scans AS (SELECT scan_no, scan_ts, own, {_HELD} FROM s1),
faults AS (SELECT * REPLACE ({_FAULTS}), strftime(scan_ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM scans),
raw AS ({_LINES}),
parsed AS (SELECT *, try_strptime(stamp, '%Y-%m-%d %H:%M:%S.%f') AS scan_ts FROM raw),
o1 AS (SELECT *, max(scan_ts) OVER (ORDER BY source_line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ts FROM parsed WHERE scan_ts IS NOT NULL),
o2 AS (SELECT *, date_diff('second', prev_ts, scan_ts) AS delta FROM o1),
ordered AS (SELECT *, CASE WHEN scan_ts = prev_ts THEN 'DUPLICATE_TIMESTAMP' WHEN scan_ts < prev_ts THEN 'NON_MONOTONIC_TIMESTAMP' END AS reject FROM o2
  UNION ALL SELECT *, NULL, NULL, 'UNPARSEABLE_TIMESTAMP' FROM parsed WHERE scan_ts IS NULL),
c1 AS (SELECT *, {_SAME} AS same FROM ordered WHERE reject IS NULL WINDOW w AS (ORDER BY source_line_no)),
c2 AS (SELECT *, sum((NOT same)::INT) OVER (ORDER BY source_line_no ROWS UNBOUNDED PRECEDING) AS island FROM c1),
clean AS (SELECT *, same AND sum(same::INT) OVER (PARTITION BY island) >= 5 AS is_stale FROM c2),
nb AS (SELECT * FROM ({_CELLS}) WHERE q <> 0),
st AS (SELECT m.reading_ts, m.value AS motor_current, CASE WHEN m.value < 15 THEN 'OFF' WHEN m.value < 35 THEN 'OFFLOADED' WHEN m.value < 70 THEN 'LOADED' ELSE 'STARTING' END AS operating_state,
  CASE WHEN c.value >= 0.5 THEN true WHEN c.value IS NOT NULL THEN false END AS comp_active, m.q = 65 AS is_stale
  FROM nb m LEFT JOIN nb c ON c.sensor_id = 4 AND c.reading_ts = m.reading_ts WHERE m.sensor_id = 5)"""
)

HOURLY_STATE = """,
hs AS (SELECT nb.sensor_id, operating_state, date_trunc('hour', nb.reading_ts)::TIMESTAMP AS bucket_start, count(*) AS sample_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, stddev_samp(value) AS stddev_value
  FROM nb JOIN st USING (reading_ts) WHERE sensor_id IN (1, 2, 3, 5) AND q >= 64 AND q <> 65 AND NOT is_stale GROUP BY ALL)"""

BASELINE = f""",
b0 AS (SELECT nb.sensor_id, operating_state, count(*) AS sample_count, avg(value) AS mean_value, coalesce(stddev_samp(value), 0) AS stddev_value,
  quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99
  FROM nb JOIN st USING (reading_ts) WHERE q >= 64 AND q <> 65 AND NOT is_stale AND operating_state IN ('OFF', 'OFFLOADED', 'LOADED')
  AND reading_ts >= '{BASE_FROM}' AND reading_ts < '{BASE_TO}' GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}),
base AS (SELECT *, p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi, p75 - p25 AS iqr FROM b0)"""


def sql(ctes: str, body: str, doubles: str = "") -> str:
    """A whole statement; the named double columns are rounded as ``tidy`` does."""
    names = doubles.split()
    swap = f" REPLACE ({', '.join(f'round({c}::DOUBLE + {NUDGE}::DOUBLE, 6) + 0.0::DOUBLE AS {c}' for c in names)})" if names else ""
    return f"WITH {ctes.strip()} SELECT *{swap} FROM ({body.strip()})"
