"""Hourly, daily and per-state rollups, time-weighted means, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import block_of, day_of, hour_of, pct, seconds_between, trusted, usable, with_states

from .ordered import leading
from .quantiles import exact_quantiles

BUCKETS = {"hour": (hour_of, "bucket_start"), "day": (day_of, "bucket_date")}


def weighted(readings: DataFrame, default_seconds: int = C.SCAN_SECONDS, most_seconds: int = C.GAP_SECONDS) -> DataFrame:
    """``readings`` with ``weight``: seconds to the sensor's next reading, at most
    ``most_seconds``, so that no reading carries the weight of a gap."""
    d = readings.withColumn("_block", block_of(F.col("reading_ts")))
    d = leading(d, ["sensor_id"], "_block", ["reading_ts"], {"_next": "reading_ts"})
    return d.withColumn("weight", F.least(F.coalesce(seconds_between(F.col("reading_ts"), F.col("_next")), F.lit(default_seconds)), F.lit(most_seconds))).drop("_next", "_block")


def measures(time: str = "reading_ts") -> list[Column]:
    """What a bucket says of its readings: counts, extremes, mean, sample deviation, first and last value."""
    v = F.col("value").cast("double")
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(usable(F.col("quality_code_id"))).alias("good_count"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("avg_value"),
        F.stddev_samp(v).alias("stddev_value"),
        F.min_by(v, time).alias("first_value"),
        F.max_by(v, time).alias("last_value"),
    ]


def rollup(readings: DataFrame, bucket: str = "hour", time_weighted: bool = False, **weights) -> DataFrame:
    """One row per sensor and bucket: counts, extremes, mean, sample deviation, first
    and last value; with ``time_weighted`` the time-weighted mean in the same pass."""
    f, name = BUCKETS[bucket]
    d = weighted(readings, **weights) if time_weighted else readings
    v, aggs = F.col("value").cast("double"), measures()
    if time_weighted:
        aggs.append(F.try_divide(F.sum(v * F.col("weight")), F.sum("weight").cast("double")).alias("time_weighted_avg"))
    return d.groupBy("sensor_id", f(F.col("reading_ts")).alias(name)).agg(*aggs)


def state_rollup(readings: DataFrame, scan_state: DataFrame | None, analogue_ids: list[int]) -> DataFrame:
    """Hourly statistics per sensor and operating state over trusted analogue readings;
    without ``scan_state`` the readings bring their states (``analysis.stated``)."""
    v = F.col("value").cast("double")
    r = readings.where(F.col("sensor_id").isin(analogue_ids) & trusted(F.col("quality_code_id")))
    return with_states(r, scan_state).groupBy("sensor_id", "operating_state", hour_of(F.col("reading_ts")).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("avg_value"), F.stddev_samp(v).alias("stddev_value")
    )


def latest(readings: DataFrame) -> DataFrame:
    """The newest reading of every sensor, by partial aggregation rather than ranking."""
    newest = F.max_by(F.struct("reading_ts", "value", "quality_code_id"), "reading_ts").alias("r")
    return readings.groupBy("sensor_id").agg(newest).select("sensor_id", "r.*")


def hourly_coverage(readings: DataFrame, per_hour: float = C.SAMPLES_PER_HOUR) -> DataFrame:
    """Live hourly aggregation with the share of expected samples that arrived."""
    r = rollup(readings)
    return r.select("sensor_id", "bucket_start", "sample_count", pct(F.col("sample_count"), F.lit(per_hour)).alias("coverage_pct"), F.col("good_count").alias("usable_count"), "min_value", "avg_value", "max_value", "stddev_value")


def aggregate_comparison(hourly: DataFrame) -> DataFrame:
    """Time-weighted against simple mean; the difference is null where the mean is 0."""
    diff = 100.0 * F.try_divide(F.col("time_weighted_avg") - F.col("avg_value"), F.abs(F.col("avg_value")))
    return hourly.select("sensor_id", "bucket_start", "sample_count", "avg_value", "time_weighted_avg", (F.col("time_weighted_avg") - F.col("avg_value")).alias("difference"), diff.alias("difference_pct"))


def daily_distribution(readings: DataFrame, selected: bool = False) -> DataFrame:
    """Per sensor and day: extremes, mean, true median and 95th percentile; ``selected`` finds
    the percentiles by selection, for days of more readings than a task can hold."""
    v = F.col("value").cast("double")
    day = readings.withColumn("bucket_date", day_of(F.col("reading_ts")))
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.min(v).alias("min_value"), F.avg(v).alias("avg_value"), F.max(v).alias("max_value")]
    by = ["sensor_id", "bucket_date"]
    if selected:
        found = exact_quantiles(day, by, "value", (0.5, 0.95)).select(*by, F.col("q").alias("p"))
        d = day.groupBy(*by).agg(*aggs).join(found, by)
    else:
        d = day.groupBy(*by).agg(*aggs, F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return d.select(*by, "sample_count", "min_value", "avg_value", "max_value", F.col("p")[0].alias("median_value"), F.col("p")[1].alias("p95_value"))
