"""Archives derived from the ``events`` table.

``readings`` is a narrow tag/value archive, one row per event.  ``scans`` is a wide
one: a logger that writes all signals whenever one of them reports, so there is a scan
for every event, which holds the event's own value and the last value of every other
signal; twice a month a morning's scan is held for hours, as a frozen logger would.
``raw_scans`` is that file as it would arrive: with lines that come late, twice or
unreadable, and faulty cells.  Both grow with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.ordered import filled

#: sensor_id, code, name, class, unit, physical_min, physical_max, display_order
SENSORS = (
    (1, "click", "Click pressure", "Analogue", "bar", 0.0, 300.0, 1),
    (2, "error", "Error pressure", "Analogue", "bar", 0.0, 300.0, 2),
    (3, "purchase", "Purchase temperature", "Analogue", "degC", 0.0, 300.0, 3),
    (4, "signup", "Signup switch", "Digital", "0/1", 0.0, 300.0, 5),
    (5, "view", "View current", "Analogue", "A", 0.0, 300.0, 4),
)
#: failure_event_id, reference, start, end, type, severity
FAILURES = (
    (1, "F-1", "2024-01-06 00:00:00", "2024-01-06 12:00:00", "AIR LEAK", "HIGH"),
    (2, "F-2", "2024-01-12 08:30:00", "2024-01-12 20:00:00", "AIR LEAK", "HIGH"),
    (3, "F-3", "2024-01-18 10:00:00", "2024-01-19 14:30:00", "AIR LEAK", "MEDIUM"),
    (4, "F-4", "2024-02-15 14:30:00", "2024-02-15 19:00:00", "OIL LEAK", "LOW"),
)
BANDS = (15.0, 35.0, 70.0)
START = "2024-01-01 00:00:00"


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SENSORS, "sensor_id int, sensor_code string, sensor_name string, sensor_class string, unit string, physical_min double, physical_max double, display_order int"
    ).withColumns({"equipment_id": F.lit(1), "is_active": F.lit(True)})


def equipment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "UNIT-1", "Compressor unit", "COMPRESSOR", "Hall 1")], "equipment_id int, equipment_code string, equipment_name string, equipment_type string, location string")


def quality_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.QUALITY, "quality_code_id int, code string, family string, is_usable boolean")


def failures(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame(FAILURES, "failure_event_id int, source_reference string, s string, e string, failure_type string, severity string")
    return d.select("failure_event_id", F.lit(1).alias("equipment_id"), "source_reference", F.to_timestamp_ntz("s").alias("start_ts"), F.to_timestamp_ntz("e").alias("end_ts"), "failure_type", "severity")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")


def readings(spark: SparkSession, sf_dir: str, *codes: str) -> DataFrame:
    """(sensor_id, reading_ts, value, quality_code_id, reading_date) of all sensors, or of
    those with one of ``codes``, which the scan then filters by."""
    code = F.when(F.col("value") < 1, C.BAD_RANGE).when(F.col("event_id") % 29 == 0, C.STALE).when(F.col("event_id") % 101 == 0, C.BAD_DIGITAL).otherwise(C.GOOD)
    ids = F.create_map(*[F.lit(x) for s in SENSORS for x in (s[1], s[0])])
    return (
        events(spark, sf_dir)
        .where(F.col("event_type").isin([s[1] for s in SENSORS if not codes or s[1] in codes]))
        .select(F.element_at(ids, F.col("event_type")).alias("sensor_id"), F.col("ts").alias("reading_ts"), "value", code.alias("quality_code_id"), F.to_date("ts").alias("reading_date"))
    )


WIDE = ("click", "error", "purchase", "view", "signup")
ANALOGUE, CURRENT, DIGITAL = ("click", "error", "purchase", "view"), "view", ("signup",)
SCANS_PER_BLOCK = 25_000
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
HELD_DAYS, HELD_HOURS = (10, 20), (7, 16)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_no, scan_ts, own, click, error, purchase, view, signup): one row per event.

    ``own`` is the signal that reported; cells are null before a signal's first report.
    """
    e = events(spark, sf_dir).select(F.col("event_id").alias("scan_no"), F.col("ts").alias("scan_ts"), F.col("event_type").alias("own"), *[F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in WIDE])
    d = filled(e.withColumn("_block", F.floor(F.col("scan_no") / SCANS_PER_BLOCK)), [], "_block", ["scan_no"], WIDE, spans=True).drop("_block")
    d = d.withColumn("signup", (F.col("signup") > 30).cast("double"))
    held = F.dayofmonth("scan_ts").isin(*HELD_DAYS) & F.hour("scan_ts").between(*HELD_HOURS)
    frozen = d.where(held).groupBy(F.to_date("scan_ts").alias("_day")).agg(F.min_by(F.struct(*WIDE), "scan_no").alias("_held"))
    # two rows for each month of the archive
    d = d.join(F.broadcast(frozen), F.to_date("scan_ts") == F.col("_day"), "left")
    return d.select("scan_no", "scan_ts", "own", *[F.when(held, F.col(f"_held.{c}")).otherwise(F.col(c)).alias(c) for c in WIDE])


def raw_scans(wide: DataFrame) -> DataFrame:
    """(source_index, source_line_no, timestamp string, five signals) in file order.

    Lines are added to the file, none replaces a scan: some come twice, some once more
    when later scans are written already, some with an unreadable time.  Faulty cells
    are never those that reported, so that no event is lost.
    """
    n, own = F.col("scan_no"), F.coalesce("own", F.lit(""))
    stamp = F.date_format("scan_ts", STAMP)
    line = lambda at, text: F.struct(at.alias("at"), text.alias("stamp"))
    lines = F.array_compact(
        F.array(
            line(2 * n + 2, stamp),
            F.when(n % 97 == 31, line(2 * n + 3, stamp)),
            F.when(n % 97 == 53, line(2 * n + 9, stamp)),
            F.when(n % 97 == 13, line(2 * n + 3, F.lit("not-a-timestamp"))),
        )
    )
    fault = lambda c, every, k, value: F.when((n % every == k) & (own != c), value).otherwise(F.col(c)).alias(c)
    d = wide.select(n, fault("click", 61, 5, 999.0), "error", fault("purchase", 89, 17, None), "view", fault("signup", 67, 7, 0.5), F.explode(lines).alias("line"))
    return d.select((n * 10).alias("source_index"), F.col("line.at").alias("source_line_no"), F.col("line.stamp").alias("timestamp"), *WIDE)


def scan_seconds(spark: SparkSession, sf_dir: str) -> int:
    """Whole seconds between scans on average, at least 1: how densely the logger wrote."""
    r = events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("z")).select("n", (F.unix_seconds("z") - F.unix_seconds("a")).alias("s")).first()
    return max(1, r["s"] // r["n"]) if r["n"] else 1
