"""Reading scan files, and writing archives idempotently."""

from __future__ import annotations

import csv
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.validate import check_header


def _header(spark: SparkSession, path: str) -> str:
    """The first line of one of the files."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").first()
    return first["value"] if first else ""


def read_scans(spark: SparkSession, path: str, signals: list[str]) -> DataFrame:
    """Wide CSV, a file or a folder of files, whose first column has no name:
    (source_index, source_line_no, timestamp string, signals, payload), columns by name;
    ``payload`` is the line as it was written, quotes included.

    Line numbers start at 2, as the header is line 1, and follow the order of the file;
    blank lines do not count.  Files of a folder follow each other by name, each with a
    header, which has to be the same and counts as a line, so that no two lines share a
    number.  Splits are ordered by file and where they begin, lines inside a split as a
    task reads them; only the number of lines of each split is ordered as a whole.
    """
    header = _header(spark, path)
    found = next(csv.reader([header]), [])
    check_header([c for c in found if c], ["timestamp", *signals])
    at, split = Window.partitionBy("_file", "_start").orderBy("_at"), ["_file", "_start"]
    d = spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")).where("trim(payload) <> ''")
    n = d.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(n.select(*split, before.alias("_base")), split).withColumn("_nth", F.row_number().over(at))
    names = [f"c{k}" for k in range(len(found))]
    is_header = (F.col("_start") == 0) & (F.col("_nth") == 1)
    same = F.when(F.col("payload") == header, True).otherwise(F.raise_error(F.concat(F.lit("another header in "), F.col("_file"))).cast("boolean"))
    cells = F.from_csv("payload", ", ".join(f"{c} string" for c in names))
    d = d.where(F.when(is_header, ~same).otherwise(True)).select("payload", (F.col("_base") + F.col("_nth")).alias("source_line_no"), cells.alias("_c"))
    cell = lambda name: F.col("_c")[names[found.index(name)]]
    return d.select(F.col("_c")[names[0]].try_cast("long").alias("source_index"), cell("timestamp").alias("timestamp"), *[cell(c).try_cast("double").alias(c) for c in signals], "payload", "source_line_no")


def file_identity(spark: SparkSession, path: str) -> tuple[str, int]:
    """(SHA-256, bytes) of a file of any size, read as a stream: the digest of a whole file
    has to see its bytes in order, a few at a time.  A folder's is the digest of its files'
    digests by name."""
    at, files = _files(spark, path)
    if files.getFileStatus(at).isDirectory():
        inside = sorted(s.getPath().getName() for s in files.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        each = [file_identity(spark, f"{path.rstrip('/')}/{name}") for name in inside]
        return hashlib.sha256("".join(sha for sha, _ in each).encode()).hexdigest(), sum(size for _, size in each)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream), files.getFileStatus(at).getLen()
    finally:
        stream.close()


def first_days(scans: DataFrame, days: int, time: str = "scan_ts") -> tuple[DataFrame, bool]:
    """Scans of the first ``days`` days, and whether that left any out.  Scans without a
    time stay, so that they can be quarantined."""
    start = scans.agg(F.date_trunc("day", F.min(time)).cast("timestamp_ntz").alias("d")).first()[0]
    if start is None:
        return scans, False
    end = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))
    return scans.where(F.col(time).isNull() | (F.col(time) < end)), not scans.where(F.col(time) >= end).isEmpty()


def active_sensors(sensors: DataFrame) -> DataFrame:
    d = sensors.where("is_active").orderBy("display_order", "sensor_id")
    if d.isEmpty():
        raise ValueError("no active sensor")
    return d


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once: of rows with one key that with the
    least further columns, so that repeated loads agree."""
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    return once.select(*rows.columns).join(stored.select(*keys), keys, "left_anti")


def insert(rows: DataFrame, stored_path: str, keys: list[str], partition: list[str] | None = None, within: str | None = None) -> tuple[int, int]:
    """Append what is new to a Parquet table; (inserted, skipped).

    ``within`` names a partition column whose range in ``rows`` bounds what is read of the
    table: a load is compared with the partitions of its own dates only.  Pass stored
    ``rows``; they are read once for their range and once for the insert, and both
    numbers come out of the one write.
    """
    spark = rows.sparkSession
    total = rows.agg(F.count(F.lit(1)).alias("n"), *([F.min(within).alias("a"), F.max(within).alias("z")] if within else [])).first()
    try:
        stored = spark.read.parquet(stored_path)
    except Exception as e:  # the table does not exist before the first load
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = spark.createDataFrame([], rows.schema)
    if within:
        stored = stored.where(F.col(within).between(F.lit(total["a"]), F.lit(total["z"])))
    added = Observation()
    fresh = new_rows(rows, stored, keys).observe(added, F.count(F.lit(1)).alias("n"))
    w = fresh.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(stored_path)
    n = added.get["n"]
    return n, total["n"] - n


def merged(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by natural key: the source's rows, and those of the target it has not."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti").select(*source.columns))


def replace_part(table_path: str, column: str, value: str, rows: DataFrame) -> None:
    """Replace all rows of one value of ``column`` (a partition of the table) by ``rows``,
    which may be none; other values stay as they are."""
    safe = "".join(c if c.isalnum() or c in "_-." else f"%{ord(c):02X}" for c in value)
    rows.drop(column).write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/{column}={safe}")


LEDGER = "run_id long, source_file string, source_sha256 string, status string, event_utc timestamp_ntz, rows_read long, rows_inserted long, rows_skipped long, rows_rejected long"


def ledger_event(spark: SparkSession, path: str, run_id: int, file: str, sha: str, status: str, at: datetime, read: int = 0, inserted: int = 0, skipped: int = 0, rejected: int = 0) -> None:
    """Append a status of a run; RUNNING first, so that a run that dies is seen."""
    spark.createDataFrame([(run_id, file, sha, status, at, read, inserted, skipped, rejected)], LEDGER).write.mode("append").parquet(path)


def ledger(events: DataFrame) -> DataFrame:
    """The newest status of every run, and when it began."""
    new = F.max_by(F.struct("source_file", "source_sha256", "status", "event_utc", "rows_read", "rows_inserted", "rows_skipped", "rows_rejected"), F.struct("event_utc", F.col("status") != "RUNNING"))
    return events.groupBy("run_id").agg(new.alias("r"), F.min("event_utc").alias("started_utc")).select("run_id", "r.*", "started_utc").withColumnRenamed("event_utc", "completed_utc")


def completed_runs(runs: DataFrame) -> DataFrame:
    """(source_sha256, run_id, runs, ...): the newest run of every file that succeeded, and
    how many did."""
    rest = [c for c in runs.columns if c != "source_sha256"]
    d = runs.where("status = 'SUCCEEDED'").groupBy("source_sha256").agg(F.max_by(F.struct(*rest), "run_id").alias("r"), F.count(F.lit(1)).alias("runs"))
    return d.select("source_sha256", "r.*", "runs")


def completed_run(runs: DataFrame, sha: str) -> DataFrame:
    """The newest run of this very file that succeeded, if any."""
    return completed_runs(runs.where(F.col("source_sha256") == sha))


def last_run(runs: DataFrame) -> DataFrame:
    """The newest run that succeeded in full, or else the newest one."""
    return runs.orderBy((F.col("status") != "SUCCEEDED"), F.desc("run_id")).limit(1)


def fresh_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_made: dict[tuple[str, str, str], tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local
    session that names none gets a temporary one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def changed_at(spark: SparkSession, path: str) -> int:
    """When a table's file or folder was last changed, in milliseconds."""
    at, files = _files(spark, path)
    return files.getFileStatus(at).getModificationTime()


def built(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], table: str = "events.parquet") -> DataFrame:
    """A table of the archive, built once for each session and state of its source, then read.

    The tables that many queries share (validated readings, states, rollups,
    baselines, anomalies) are stored, not computed again in every query; they are built
    anew when the source's file changes.
    """
    key = (spark.sparkContext.applicationId, source, name)
    stamp = changed_at(spark, f"{source}/{table}")
    if key not in _made or _made[key][0] != stamp:
        path = fresh_path(shared_dir(spark), name)
        make().write.parquet(path)
        if key in _made:
            remove(spark, _made[key][1])
        _made[key] = stamp, path
    return spark.read.parquet(_made[key][1])


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all it holds."""
    at, files = _files(spark, path)
    files.delete(at, True)


class Workspace:
    """Tables of the shared folder that one computation writes and reads back, which cuts the
    lineage; they are removed together when it ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, fresh_path(shared_dir(spark), name), 0

    def table(self, d: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        d.write.parquet(path)
        return self.spark.read.schema(d.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.base)


def forget(spark: SparkSession) -> None:
    """Remove the built tables of this session."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        remove(spark, _made.pop(key)[1])
