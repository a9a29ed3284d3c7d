"""Whole jobs over an archive folder: load a scan file, compute the analytics."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import day_of
from tidemark.operators import analysis, compress, incremental, rollup, validate
from tidemark.sources import archive


@dataclass
class IngestionResult:
    run_id: int
    status: str
    rows_read: int = 0
    rows_rejected: int = 0
    inserted: int = 0
    skipped: int = 0
    shortfall: int = 0
    issues: dict = field(default_factory=dict)


ISSUES = "run_id long, issue_type string, severity string, sensor_id int, window_start timestamp_ntz, window_end timestamp_ntz, affected_rows long, observed_value double, is_summary boolean, details string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # not written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _stored(spark: SparkSession, d: DataFrame, path: str) -> DataFrame:
    d.write.parquet(path)
    return spark.read.parquet(path)


def run_ingestion(spark: SparkSession, csv_path: str, folder: str, signals: list[tuple[int, str, float, float, bool]], analogue: tuple[str, ...], pair: tuple[str, str] | None = None, limit_days: int | None = None, force: bool = False, now: datetime | None = None) -> IngestionResult:
    """Load one wide scan file into ``folder``; every line is stored or quarantined.

    ``signals``: (sensor_id, column, low, high, digital).  A file that a run has loaded
    in full is skipped unless ``force``; loading it again inserts nothing.  The ledger
    says RUNNING before anything is written, and FAILED if the load raises.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    path = lambda name: f"{folder.rstrip('/')}/{name}"
    events = _table(spark, path("ledger"), archive.LEDGER)
    run_id = (events.agg(F.max("run_id")).first()[0] or 0) + 1
    sha, size = archive.file_identity(spark, csv_path)
    note = lambda status, **n: archive.ledger_event(spark, path("ledger"), run_id, csv_path, sha, status, now, **n)
    if not force and not archive.completed_run(archive.ledger(events), sha).isEmpty():
        note("SKIPPED")
        return IngestionResult(run_id, "SKIPPED")
    note("RUNNING")
    try:
        return _load(spark, csv_path, path, signals, analogue, pair, limit_days, run_id, size, note)
    except Exception:
        note("FAILED")  # or it would be seen as running for ever
        raise


def _load(spark: SparkSession, csv_path: str, path, signals, analogue, pair, limit_days, run_id: int, size: int, note) -> IngestionResult:
    if not size:
        note("FAILED")
        return IngestionResult(run_id, "FAILED")
    work = lambda name, d: _stored(spark, d, archive.fresh_path(path("work"), name))
    raw = archive.read_scans(spark, csv_path, [s[1] for s in signals])
    scans, cut = validate.checked_order(raw), False
    if limit_days is not None:
        scans, cut = archive.first_days(scans, limit_days)
    scans = work("ordered", scans)
    clean = work("clean", validate.frozen(scans.drop("payload"), analogue))
    rejects = validate.rejected(scans, ["source_index", "timestamp", *[s[1] for s in signals]])
    left, right = pair or (analogue[0], analogue[0])
    totals = validate.issue_totals(scans, clean, signals, left, right).withColumn("run_id", F.lit(run_id)).collect()
    read, rejected = scans.count(), rejects.count()
    rejects.withColumns({"run_id": F.lit(run_id), "payload": F.substring("payload", 1, 1000)}).write.mode("append").parquet(path("rejected"))
    readings = work("readings", validate.melted(clean, signals).withColumn("reading_date", day_of(F.col("reading_ts"))))
    incremental.note_touched(readings, path("").rstrip("/"), f"run-{run_id}")
    inserted, skipped = archive.insert(readings, path("readings"), ["sensor_id", "reading_ts"], ["sensor_id", "reading_date"], "reading_date")
    missing = sum(r["affected_rows"] for r in totals if r["issue_type"] == "MISSING_VALUE")
    short = (read - rejected) * len(signals) - missing - inserted - skipped
    names = {s[0]: s[1] for s in signals}
    total = lambda r: f"Run total: {r['affected_rows']:,} occurrence(s) of {r['issue_type']} for {names.get(r['sensor_id'], 'all sensors')}."
    rows = [(run_id, r["issue_type"], r["severity"], r["sensor_id"], None, None, r["affected_rows"], None, True, total(r)) for r in totals]
    said = f"{read:,} source rows read, {rejected:,} quarantined, {read - rejected:,} accepted x {len(signals)} sensors minus {missing:,} missing values = {short + inserted + skipped:,} expected readings. Inserted {inserted:,}, already present {skipped:,}, unaccounted {short:,}."
    rows.append((run_id, "LOAD_RECONCILIATION", "INFO" if short == 0 else "CRITICAL", None, None, None, abs(short), None, True, said))
    summary = spark.createDataFrame(rows, ISSUES)
    details = validate.issue_details(scans, clean, left, right).withColumns({"run_id": F.lit(run_id).cast("long"), "sensor_id": F.lit(None).cast("int"), "is_summary": F.lit(False)})
    details = validate.capped_details(details.select(*summary.columns), "issue_type", ["window_start"])
    details.unionByName(summary).withColumns({"run_id": F.lit(run_id).cast("long"), "details": F.substring("details", 1, 1000)}).write.mode("append").parquet(path("issues"))
    status = validate.run_status(read, cut)
    note(status, read=read, inserted=inserted, skipped=skipped, rejected=rejected)
    return IngestionResult(run_id, status, read, rejected, inserted, skipped, short, {(r["issue_type"], r["sensor_id"]): r["affected_rows"] for r in totals})


def run_analytics(spark: SparkSession, folder: str, current_id: int, switch_id: int, analogue_ids: list[int], window: tuple[str, str], pressure_id: int | None = None, name: str = "REFERENCE", min_samples: int = C.BASELINE_MIN_SAMPLES) -> dict:
    """States, rollups, baselines and the three detectors, each stored as a table of
    ``folder``; returns totals and the alarm verdict per method.

    Baselines of other names stay, as do findings of methods that did not run.
    """
    path = lambda t: f"{folder.rstrip('/')}/{t}"

    def store(t: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(path(t))
        return spark.read.parquet(path(t))

    readings = spark.read.parquet(path("readings"))
    states = store("states", analysis.scan_states(readings, current_id, switch_id))
    store("hourly", rollup.rollup(readings, "hour", time_weighted=True))
    store("daily", rollup.rollup(readings, "day"))
    hourly_state = store("hourly_state", rollup.state_rollup(readings, states, analogue_ids))
    archive.replace_part(path("baseline"), "baseline_name", name, analysis.baselines(readings, states, *window, name, min_samples))
    base = analysis.stored_baselines(spark.read.parquet(path("baseline")).withColumn("baseline_name", F.col("baseline_name").cast("string")), name)
    found = {"ADAPTIVE_MAD": analysis.detect_mad(hourly_state), "BASELINE_IQR": analysis.detect_iqr(hourly_state, base)}
    if pressure_id is not None:
        found["SETPOINT"] = analysis.detect_setpoint(analysis.setpoint_episodes(readings, pressure_id), pressure_id)
    for method, d in found.items():
        archive.replace_part(path("anomaly"), "method", method, d)
    b = readings.agg(F.min("reading_ts").alias("a"), F.max("reading_ts").alias("z")).first()
    days = max((b["z"] - b["a"]).total_seconds() / 86400, 1.0) if b["a"] else 1.0
    return {"scans": states.count(), "baselines": base.count(), "alarms": {r["method"]: (r["total"], r["verdict"]) for r in analysis.alarm_rate(spark.read.parquet(path("anomaly")), days).collect()}}


def refresh_rollups(spark: SparkSession, folder: str) -> int:
    """Bring the hourly and daily rollups up to date with the loads since the last time,
    working out only the dates that they touched; how many dates that were.

    Hours are kept as partials that merge, days are merged from them.
    """
    path = lambda t: f"{folder.rstrip('/')}/{t}"
    days = incremental.refresh(spark, folder)
    if days:
        parts = spark.read.parquet(path("hourly_partials"))
        incremental.as_rollup(parts, "sensor_id", "bucket_start").write.mode("overwrite").parquet(path("hourly"))
        incremental.as_rollup(incremental.daily(parts), "sensor_id", "bucket_date").write.mode("overwrite").parquet(path("daily"))
    return len(days)


def run_compression(spark: SparkSession, folder: str, sensor_ids: list[int], percent: float = C.COMPRESSION_PCT, gap_seconds: float = C.GAP_SECONDS, cut_rows: int = compress.CUT_ROWS) -> bool:
    """Compress the readings of some sensors, store what is kept and its statistics, and
    say whether every sensor keeps its error bound."""
    readings = spark.read.parquet(f"{folder}/readings").where(F.col("sensor_id").isin(sensor_ids))
    dev = compress.deviations(readings, percent)
    compress.compress(readings, dev, gap_seconds, cut_rows).write.mode("overwrite").parquet(f"{folder}/compressed")
    stats = compress.compression_stats(readings, spark.read.parquet(f"{folder}/compressed"), dev)
    stats.withColumn("deviation_pct", F.lit(float(percent))).write.mode("overwrite").parquet(f"{folder}/compression_stats")
    return spark.read.parquet(f"{folder}/compression_stats").where("not within_bound").isEmpty()
