"""Rollups that are kept up to date instead of being built again.

A partial is what a bucket says of its readings in a form that merges: counts, extremes,
mean and sum of squared deviations, first and last reading, weights, and a quantile
sketch.  Hours merge to days, months or any window, without the readings.  A load says
which dates it touched; only those, and the day before where a reading's weight reached
into them, are worked out again.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import day_of, hour_of, usable

from .quantiles import SKETCH, sketch
from .rollup import weighted

DAY_SECONDS = 86_400


def partials(readings: DataFrame, default_seconds: int = C.SCAN_SECONDS, most_seconds: int = C.GAP_SECONDS) -> DataFrame:
    """(sensor_id, reading_date, bucket_start, measures): the partial of every hour of every sensor."""
    v, at = F.col("value").cast("double"), F.col("reading_ts")
    d = weighted(readings, default_seconds, most_seconds)
    edge = lambda pick: pick(F.struct(at.alias("ts"), v.alias("value")), at)
    return d.groupBy("sensor_id", day_of(at).alias("reading_date"), hour_of(at).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(usable(F.col("quality_code_id"))).alias("good_count"),
        F.count(v).alias("n"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        edge(F.min_by).alias("first"),
        edge(F.max_by).alias("last"),
        F.sum(v * F.col("weight")).alias("weighted"),
        F.sum("weight").cast("double").alias("weight"),
        sketch("value").alias("sketch"),
    )


def _moments(parts: Column) -> Column:
    """(n, mean, m2) of all parts, added one by one, which loses nothing to cancellation."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, x: Column) -> Column:
        n, off = a["n"] + x["n"], x["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + off * x["n"] / n).alias("mean"), (a["m2"] + x["m2"] + off * off * a["n"] * x["n"] / n).alias("m2"))

    return F.aggregate(F.array_sort(parts), start, add)


def merged(parts: DataFrame, by: list[str], bucket: Column, name: str) -> DataFrame:
    """Partials of coarser buckets: those of ``by`` and ``bucket``, a column over bucket_start
    and reading_date.  A bucket's partials are gathered in its row: 24 to a day."""
    one = F.when(F.col("n") > 0, F.struct(F.col("bucket_start"), F.col("n").cast("double").alias("n"), "mean", "m2"))
    d = parts.groupBy(*by, bucket.alias(name)).agg(
        F.sum("sample_count").alias("sample_count"),
        F.sum("good_count").alias("good_count"),
        F.sum("n").alias("n"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.collect_list(one).alias("_p"),
        F.min_by("first", "first.ts").alias("first"),
        F.max_by("last", "last.ts").alias("last"),
        F.sum("weighted").alias("weighted"),
        F.sum("weight").alias("weight"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"),
    )
    d = d.withColumn("_m", _moments(F.col("_p")))
    return d.withColumns({"mean": F.when(F.col("n") > 0, F.col("_m.mean")), "m2": F.when(F.col("n") > 0, F.col("_m.m2"))}).drop("_p", "_m")


def as_rollup(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials as rows of ``rollup.rollup`` with the time-weighted mean."""
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return parts.select(*keys, "sample_count", "good_count", "min_value", "max_value", F.col("mean").alias("avg_value"), deviation.alias("stddev_value"), F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"), F.try_divide("weighted", "weight").alias("time_weighted_avg"))


def daily(parts: DataFrame) -> DataFrame:
    return merged(parts, ["sensor_id"], F.col("reading_date"), "bucket_date")


# --- keeping them up to date ------------------------------------------------------


def note_touched(rows: DataFrame, folder: str, load: str) -> None:
    """Remember the dates of a load's readings; called before they are inserted, so that a
    load that dies half-way is seen as well."""
    own = f"{load}-{uuid.uuid4().hex}"
    rows.select("reading_date").distinct().withColumn("load_id", F.lit(own)).coalesce(1).write.mode("append").parquet(f"{folder}/touched")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # not written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _days(d: DataFrame, days: list[date]) -> DataFrame:
    """Rows of these dates; runs of dates become ranges, so that years of them stay a short filter."""
    days, keep, k = sorted(set(days)), F.lit(False), 0
    while k < len(days):
        z = k
        while z + 1 < len(days) and days[z + 1] - days[z] == timedelta(days=1):
            z += 1
        keep, k = keep | F.col("reading_date").between(F.lit(days[k]), F.lit(days[z])), z + 1
    return d.where(keep)


def rebuild_dates(spark: SparkSession, folder: str, days: list[date], default_seconds: int = C.SCAN_SECONDS, most_seconds: int = C.GAP_SECONDS) -> None:
    """Work out the partials of ``days`` again, and of the days before them, whose last
    readings weigh up to the first ones of these; only these partitions are read and
    replaced (and the days after, for the reading that the last weight reaches to)."""
    if most_seconds > DAY_SECONDS:
        raise ValueError("a reading may weigh a day at most")
    one = timedelta(days=1)
    own = sorted({*days, *(d - one for d in days)})
    readings = _days(spark.read.parquet(f"{folder}/readings"), [*own, *(d + one for d in own)])
    parts = _days(partials(readings, default_seconds, most_seconds), own)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reading_date").parquet(f"{folder}/hourly_partials")


def refresh(spark: SparkSession, folder: str, default_seconds: int = C.SCAN_SECONDS, most_seconds: int = C.GAP_SECONDS) -> list[date]:
    """Bring ``hourly_partials`` up to date with all loads noted since the last time; returns
    the dates that loads had touched.  If it dies, the next one does them again."""
    folder = folder.rstrip("/")
    done = _table(spark, f"{folder}/refreshed", "load_id string")
    todo = _table(spark, f"{folder}/touched", "reading_date date, load_id string").join(done, "load_id", "left_anti")
    loads = todo.groupBy("load_id").agg(F.collect_set("reading_date").alias("days")).collect()  # a row for each load since
    days = sorted({d for r in loads for d in r["days"]})
    if days:
        rebuild_dates(spark, folder, days, default_seconds, most_seconds)
        spark.createDataFrame([(r["load_id"],) for r in loads], "load_id string").coalesce(1).write.mode("append").parquet(f"{folder}/refreshed")
    return days
