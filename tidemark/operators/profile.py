"""Profile of a wide file: columns, intervals, coverage, frozen blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import block_of, day_of, epoch, pct

from .analysis import inside_windows
from .ordered import lagged, runs


def columns(scans: DataFrame, signals: list[str]) -> DataFrame:
    """Per signal: nulls, distinct values, extremes, mean, deviation, quartiles, mode."""
    cells = scans.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v")) for c in signals])).alias("c")).select("c.*")
    by_value = cells.where("v is not null").groupBy("signal", "v").agg(F.count(F.lit(1)).alias("n"))
    mode = by_value.groupBy("signal").agg(F.count(F.lit(1)).alias("distinct_values"), F.max_by("v", F.struct("n", -F.col("v"))).alias("mode_value"))
    p = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = cells.groupBy("signal").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg("v").alias("mean_value"), F.stddev_samp("v").alias("stddev_value"), p.alias("p"))
    d = d.join(mode, "signal", "left")
    return d.select("signal", "rows", "nulls", "distinct_values", "mode_value", "min_value", "max_value", "mean_value", "stddev_value", *[F.col("p")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75"))])


def intervals(scans: DataFrame, time: str = "scan_ts") -> DataFrame:
    """How often each step between successive scans occurs, in seconds."""
    d = lagged(scans.withColumn("_block", block_of(F.col(time))), [], "_block", [time], {"_was": time})
    return d.where("_was is not null").groupBy((epoch(F.col(time)) - epoch(F.col("_was"))).alias("seconds")).agg(F.count(F.lit(1)).alias("steps"))


def coverage(scans: DataFrame, per_day: float, time: str = "scan_ts") -> DataFrame:
    """Scans per day against what a full day holds; low days are flagged."""
    d = scans.groupBy(day_of(F.col(time)).alias("bucket_date")).agg(F.count(F.lit(1)).alias("scans"))
    return d.withColumns({"coverage_pct": pct(F.col("scans"), F.lit(per_day)), "is_low": pct(F.col("scans"), F.lit(per_day)) < 50})


def monthly(scans: DataFrame, time: str = "scan_ts") -> DataFrame:
    return scans.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("scans"))


def duplicates(scans: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one in ``keys``."""
    return scans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def failure_profile(scans: DataFrame, failures: DataFrame, signals: list[str], scan_seconds: float, time: str = "scan_ts") -> DataFrame:
    """Scans and means inside each failure, both ends included, against the expected number."""
    r = inside_windows(scans, failures, time, "start_ts", "end_ts", closed=True)
    d = r.groupBy("failure_event_id").agg(F.count(F.lit(1)).alias("scans"), *[F.avg(c).alias(f"mean_{c}") for c in signals])
    expected = F.floor((epoch(F.col("end_ts")) - epoch(F.col("start_ts"))) / scan_seconds) + 1
    return failures.select("failure_event_id", "source_reference", expected.alias("expected_scans")).join(d, "failure_event_id", "left").withColumn("scans", F.coalesce("scans", F.lit(0)))


def frozen_blocks(scans: DataFrame, signals: list[str], top: int = 10, time: str = "scan_ts") -> DataFrame:
    """The longest runs of scans that repeat the one before in every signal, whatever their length."""
    d = scans.withColumn("_block", block_of(F.col(time)))
    d = lagged(d, [], "_block", [time], {f"_w{k}": c for k, c in enumerate(signals)})
    same = F.lit(True)
    for k, c in enumerate(signals):
        same = same & F.coalesce(F.col(c) == F.col(f"_w{k}"), F.lit(False))
    d = runs(d, [], "_block", [time], same)
    blocks = d.where("run_length > 0").groupBy("island").agg(F.min(time).alias("block_start"), F.max(time).alias("block_end"), F.count(F.lit(1)).alias("frozen_scans"))
    return blocks.drop("island").orderBy(F.desc("frozen_scans"), "block_start").limit(top)


def longest_constant(scans: DataFrame, signals: list[str], time: str = "scan_ts") -> DataFrame:
    """Per signal, the longest run of equal values: its length, value and start."""
    cells = scans.select(time, F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v")) for c in signals])).alias("c")).select(time, "c.*").where("v is not null")
    d = lagged(cells.withColumn("_block", block_of(F.col(time))), ["signal"], "_block", [time], {"_was": "v"})
    d = runs(d, ["signal"], "_block", [time], F.coalesce(F.col("v") == F.col("_was"), F.lit(False)))
    r = d.groupBy("signal", "island").agg(F.count(F.lit(1)).alias("run"), F.min(time).alias("run_start"), F.max("v").alias("value"))
    w = Window.partitionBy("signal").orderBy(F.desc("run"), "run_start")
    return r.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("signal", "run", "value", "run_start")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, d in tables.items():
        c = d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def value_counts(scans: DataFrame, signals: list[str]) -> DataFrame:
    """How often each value of each signal occurs."""
    cells = scans.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in signals])).alias("c")).select("c.*")
    return cells.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("scans"))


def band_counts(scans: DataFrame, signal: str, bands: tuple[float, ...]) -> DataFrame:
    """Scans per band of a signal: 0 below the first edge, n at or above the last."""
    band = sum(((F.col(signal) >= b).cast("int") for b in bands), F.lit(0))
    return scans.where(F.col(signal).isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("scans"), F.min(signal).alias("min_value"), F.max(signal).alias("max_value"))


def setpoint_agreement(scans: DataFrame, signal: str, switch: str, setpoint: float) -> DataFrame:
    """How often a switch agrees with its documented setpoint (on below it)."""
    expected = (F.col(signal) < setpoint).cast("double")
    d = scans.where(F.col(signal).isNotNull() & F.col(switch).isNotNull())
    return d.agg(F.count(F.lit(1)).alias("scans"), F.count_if(expected == F.col(switch)).alias("agreeing")).withColumn("agreement_pct", pct(F.col("agreeing"), F.col("scans")))


def contamination(frozen: DataFrame, windows: DataFrame, time: str = "scan_ts") -> DataFrame:
    """Held scans inside each window (window_start to start_ts); windows without any have 0.

    ``frozen`` has ``time`` and ``is_stale``.
    """
    d = inside_windows(frozen, windows, time).groupBy("source_reference", "hours").agg(F.count(F.lit(1)).alias("scans"), F.count_if("is_stale").alias("held"))
    d = windows.select("source_reference", "hours").join(d, ["source_reference", "hours"], "left")
    return d.select("source_reference", "hours", F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("held", F.lit(0)).alias("held"), pct(F.col("held"), F.col("scans")).alias("held_pct"))
