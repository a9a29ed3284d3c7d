"""Loading a stream of checked scans into an archive, each key once."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import day_of
from tidemark.operators import incremental, validate
from tidemark.sources import archive

LEDGER = "batch_id long, status string, event_utc timestamp_ntz, rows_read long, rows_inserted long, rows_skipped long, rows_rejected long, gaps long"


def load_batch(batch: DataFrame, batch_id: int, folder: str, name: str, signals: list[tuple[int, str, float, float, bool]], line: str, time: str) -> None:
    """Store one micro-batch of ``validated_stream``; doing it again changes nothing.

    Readings go to the table that ``jobs.run_ingestion`` fills: those whose sensor and time
    are stored already are skipped, so a batch that died half-way adds what is missing.
    Rejected lines, gaps and the ledger's row are partitions of the batch's number, which a
    repetition overwrites.  The ledger says RUNNING before anything is stored.
    """
    spark = batch.sparkSession
    path = lambda t: f"{folder.rstrip('/')}/{t}"
    part = lambda t, rows: archive.replace_part(f"{path(t)}/stream={name}", "batch", str(batch_id), rows)

    def note(status: str, *n: int) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        part("stream_ledger", spark.createDataFrame([(batch_id, status, now, *(n or (0,) * 5))], LEDGER))

    note("RUNNING")
    work = archive.fresh_path(path("work"), f"batch-{name}")
    batch.withColumn("scan_ts", F.col(time).cast("timestamp_ntz")).write.parquet(f"{work}/scans")
    try:
        scans = spark.read.parquet(f"{work}/scans")
        rejects = scans.where("reject is not null").select(F.col(line).alias("source_line_no"), F.col("reject").alias("reason_code"), F.concat_ws(",", F.col("scan_ts").cast("string"), *[F.coalesce(F.col(s[1]).cast("string"), F.lit("")) for s in signals]).alias("payload"))
        part("stream_rejected", rejects)
        part("stream_gaps", scans.where("gap_seconds is not null").select(F.col("scan_ts").alias("gap_end"), "gap_seconds"))
        accepted = scans.where("reject is null")
        validate.melted(accepted, signals).withColumn("reading_date", day_of(F.col("reading_ts"))).write.parquet(f"{work}/readings")
        n = scans.agg(F.count(F.lit(1)).alias("read"), F.count("reject").alias("rejected"), F.count("gap_seconds").alias("gaps")).first()
        incremental.note_touched(spark.read.parquet(f"{work}/readings"), folder.rstrip("/"), f"stream-{name}-{batch_id}")
        inserted, skipped = archive.insert(spark.read.parquet(f"{work}/readings"), path("readings"), ["sensor_id", "reading_ts"], ["sensor_id", "reading_date"], "reading_date")
        note("SUCCEEDED", n["read"], inserted, skipped, n["rejected"], n["gaps"])
    finally:
        archive.remove(spark, work)


def load_stream(checked: DataFrame, folder: str, signals: list[tuple[int, str, float, float, bool]], checkpoint: str, name: str = "scans", line: str = "line", time: str = "ts") -> DataStreamWriter:
    """A writer that loads the output of ``validated_stream`` (with a line column) of one
    logger into ``folder``; start it to run the load.

    ``signals``: (sensor_id, column, low, high, digital).  A load that was killed goes on
    from ``checkpoint``: Spark hands over the batch that was not committed again, under the
    same number, and ``load_batch`` stores every key once, however far it had come.
    """
    return checked.writeStream.foreachBatch(lambda batch, batch_id: load_batch(batch, batch_id, folder, name, signals, line, time)).option("checkpointLocation", checkpoint).queryName(name)


def stream_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(stream, batch, status, counts): the newest state of every micro-batch of every load."""
    return spark.read.schema(f"{LEDGER}, stream string, batch string").parquet(f"{folder.rstrip('/')}/stream_ledger").drop("batch")
