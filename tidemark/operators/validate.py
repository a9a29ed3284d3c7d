"""Validation of wide scans: every line is stored, held or quarantined, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import seconds_between

from .ordered import lagged, running, runs

FORMAT = "yyyy-MM-dd HH:mm:ss"
LINES_PER_BLOCK = 100_000
CRITICAL = ("SCHEMA_MISMATCH", "UNPARSEABLE_TIMESTAMP", "DUPLICATE_TIMESTAMP", "NON_MONOTONIC_TS", "OUT_OF_RANGE", "NON_BINARY_DIGITAL")
WARNING = ("FLATLINE", "XSENSOR_DIVERGENCE", "MISSING_VALUE")


def check_header(found: list[str], expected: list[str]) -> list[str]:
    """Extra columns, sorted; raises ValueError if one is missing."""
    if missing := sorted(set(expected) - set(found)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return sorted(set(found) - set(expected))


def severity(issue: Column) -> Column:
    return F.when(issue.isin(*CRITICAL), "CRITICAL").when(issue.isin(*WARNING), "WARNING").otherwise("INFO")


def checked_order(raw: DataFrame, by_previous_line: bool = False, form: str = FORMAT) -> DataFrame:
    """``raw`` with scan_ts, delta (seconds since the scan before), prev_ts and reject.

    A scan is in order if it is later than every accepted scan before it.  With
    ``by_previous_line`` it is compared with the parsed line just above, dropped or
    not, which lets a scan that is too early pass after a step back.  Times are compared
    in full; ``delta`` counts the second boundaries between them.
    """
    d = raw.withColumn("scan_ts", F.try_to_timestamp("timestamp", F.lit(form)).cast("timestamp_ntz"))
    d = d.withColumn("_block", F.floor(F.col("source_line_no") / LINES_PER_BLOCK))
    order = ["source_line_no"]
    if not by_previous_line:  # a time that is none changes no maximum, so all lines go one way
        d = running(d, [], "_block", order, "prev_ts", F.col("scan_ts"), "max", before=True, spans=True)
        known = F.col("scan_ts").isNotNull()
        d = d.withColumn("prev_ts", F.when(known, F.col("prev_ts")))
        reject = F.when(~known, "UNPARSEABLE_TIMESTAMP").when(F.col("scan_ts") == F.col("prev_ts"), "DUPLICATE_TIMESTAMP").when(F.col("scan_ts") < F.col("prev_ts"), "NON_MONOTONIC_TIMESTAMP")
        return d.withColumns({"delta": seconds_between(F.col("prev_ts"), F.col("scan_ts")), "reject": reject})
    parsed = lagged(d.where("scan_ts is not null"), [], "_block", order, {"prev_ts": "scan_ts"}, spans=True)
    parsed = parsed.withColumn("delta", seconds_between(F.col("prev_ts"), F.col("scan_ts")))
    parsed = parsed.withColumn("reject", F.when(F.col("scan_ts") == F.col("prev_ts"), "DUPLICATE_TIMESTAMP").when(F.col("scan_ts") < F.col("prev_ts"), "NON_MONOTONIC_TIMESTAMP"))
    bad = d.where("scan_ts is null").withColumns({"prev_ts": F.lit(None).cast("timestamp_ntz"), "delta": F.lit(None).cast("long"), "reject": F.lit("UNPARSEABLE_TIMESTAMP")})
    return parsed.unionByName(bad)


def rejected(ordered: DataFrame, columns: list[str]) -> DataFrame:
    """The quarantine: line, reason, detail and the line as it was (its ``payload`` column
    where the source keeps one, otherwise the parsed columns in order)."""
    detail = F.when(F.col("reject") == "UNPARSEABLE_TIMESTAMP", "Timestamp could not be parsed.").otherwise(F.concat(F.lit("Delta from previous reading was "), F.col("delta").cast("string"), F.lit(" s.")))
    payload = F.col("payload") if "payload" in ordered.columns else F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return ordered.where("reject is not null").select("source_line_no", F.col("reject").alias("reason_code"), detail.alias("reason_detail"), payload.alias("payload"))


def gaps(ordered: DataFrame, gap_seconds: int = C.GAP_SECONDS, scan_seconds: int = C.SCAN_SECONDS) -> DataFrame:
    """Steps between accepted scans longer than ``gap_seconds``; the scan itself is kept."""
    d = ordered.where((F.col("reject").isNull()) & (F.col("delta") > gap_seconds))
    missing = F.greatest(F.floor(F.col("delta") / scan_seconds) - 1, F.lit(0)).cast("long")
    return d.select(F.col("prev_ts").alias("gap_start"), F.col("scan_ts").alias("gap_end"), F.col("delta").alias("gap_seconds"), missing.alias("missing_scans"))


def frozen(ordered: DataFrame, analogue: tuple[str, ...], samples: int = C.FLATLINE_SAMPLES) -> DataFrame:
    """Accepted scans with ``is_stale``: part of a run in which every analogue signal
    repeats the scan before; the first scan of a freeze is good.  Null repeats nothing."""
    d = ordered.where("reject is null")
    d = lagged(d, [], "_block", ["source_line_no"], {f"_was_{c}": c for c in analogue})
    same = F.lit(True)
    for c in analogue:
        same = same & F.coalesce(F.col(c) == F.col(f"_was_{c}"), F.lit(False))
    d = d.withColumn("unchanged", same).drop(*[f"_was_{c}" for c in analogue])
    d = runs(d, [], "_block", ["source_line_no"], F.col("unchanged"))
    return d.withColumn("is_stale", F.col("run_length") >= max(samples - 1, 1))


def cell_quality(value: Column, low: float, high: float, digital: bool, stale: Column) -> Column:
    """Missing, then non-binary, then out of range, then held, then good."""
    odd = ~value.isin(0.0, 1.0) if digital else F.lit(False)
    return F.when(value.isNull() | F.isnan(value), C.MISSING).when(odd, C.BAD_DIGITAL).when((value < low) | (value > high), C.BAD_RANGE).when(stale, C.STALE).otherwise(C.GOOD)


def melted(scans: DataFrame, signals: list[tuple[int, str, float, float, bool]], also: tuple[str, ...] = ()) -> DataFrame:
    """Wide to narrow with a quality code per cell; missing cells are not stored.

    ``signals``: (sensor_id, column, low, high, digital).  Each reading takes the columns
    ``also`` of its scan along.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("sensor_id"), F.col(c).alias("value"), cell_quality(F.col(c), low, high, digital, F.col("is_stale")).alias("quality_code_id")) for i, c, low, high, digital in signals])
    d = scans.select(F.col("scan_ts").alias("reading_ts"), *also, F.explode(cells).alias("c"))
    return d.select("c.sensor_id", "reading_ts", "c.value", "c.quality_code_id", *also).where(F.col("quality_code_id") != C.MISSING)


def divergence(scans: DataFrame, left: str, right: str, most: float = C.DIVERGENCE) -> DataFrame:
    """One row if two signals that should agree differ by more than ``most``."""
    gap = F.abs(F.col(left) - F.col(right))
    return scans.where(gap > most).agg(F.count(F.lit(1)).alias("affected_rows"), F.min("scan_ts").alias("window_start"), F.max("scan_ts").alias("window_end"), F.max(gap).alias("observed_value")).where("affected_rows > 0")


def issue_totals(ordered: DataFrame, scans: DataFrame, signals, left: str, right: str, most: float = C.DIVERGENCE, gap_seconds: int = C.GAP_SECONDS) -> DataFrame:
    """Exact totals per issue type and sensor (null: the scan as a whole).  A value that
    is neither binary nor in range counts under both."""
    of_line = ordered.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("reject") == "NON_MONOTONIC_TIMESTAMP", "NON_MONOTONIC_TS").otherwise(F.col("reject")),
                    F.when(F.col("reject").isNull() & (F.col("delta") > gap_seconds), "GAP"),
                )
            )
        ).alias("issue_type"),
        F.lit(None).cast("int").alias("sensor_id"),
    )
    held = scans.where("is_stale").select(F.lit("FLATLINE").alias("issue_type"), F.lit(None).cast("int").alias("sensor_id"))
    apart = scans.where(F.abs(F.col(left) - F.col(right)) > most).select(F.lit("XSENSOR_DIVERGENCE").alias("issue_type"), F.lit(None).cast("int").alias("sensor_id"))
    kinds = []
    for i, c, low, high, digital in signals:
        v = F.col(c)
        tests = [("MISSING_VALUE", v.isNull() | F.isnan(v)), ("OUT_OF_RANGE", (v < low) | (v > high))] + ([("NON_BINARY_DIGITAL", ~v.isin(0.0, 1.0))] if digital else [])
        kinds += [F.when(t, F.struct(F.lit(k).alias("issue_type"), F.lit(i).alias("sensor_id"))) for k, t in tests]
    cells = scans.select(F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("x.*")
    every = of_line.unionByName(held).unionByName(apart).unionByName(cells)
    return every.groupBy("issue_type", "sensor_id").agg(F.count(F.lit(1)).alias("affected_rows")).withColumn("severity", severity(F.col("issue_type")))


def issue_details(ordered: DataFrame, scans: DataFrame, left: str, right: str, most: float = C.DIVERGENCE, gap_seconds: int = C.GAP_SECONDS, scan_seconds: int = C.SCAN_SECONDS) -> DataFrame:
    """One row per gap and per frozen block, and one for the divergence: (issue_type,
    severity, window_start, window_end, affected_rows, observed_value, details)."""
    hours = lambda seconds: F.format_string("%.2f", seconds / 3600.0)
    count = lambda n: F.format_number(n, 0)
    g = gaps(ordered, gap_seconds, scan_seconds).withColumn("s", F.col("gap_seconds").cast("double"))
    gap = g.select(F.lit("GAP").alias("issue_type"), F.col("gap_start").alias("window_start"), F.col("gap_end").alias("window_end"), F.col("missing_scans").alias("affected_rows"), F.col("s").alias("observed_value"), F.concat(F.lit("No data for "), hours(F.col("s")), F.lit(" h ("), count("s"), F.lit(f" s), against a {gap_seconds} s threshold.")).alias("details"))
    # the first scan of a freeze is good, but the block begins with it
    f = scans.where("is_stale").groupBy("island").agg(F.min("prev_ts").alias("window_start"), F.max("scan_ts").alias("window_end"), F.count(F.lit(1)).alias("affected_rows"))
    held = F.col("affected_rows") + 1
    flat = f.select(F.lit("FLATLINE").alias("issue_type"), "window_start", "window_end", "affected_rows", F.lit(None).cast("double").alias("observed_value"), F.concat(F.lit("All analogue signals held identical values for "), count(held), F.lit(" consecutive scans ("), hours(held * scan_seconds), F.lit(" h). Marked UNCERTAIN_STALE; excluded from baselines.")).alias("details"))
    text = F.concat(F.lit(f"|{left} - {right}| exceeded {most} on "), count("affected_rows"), F.lit(" scan(s); worst was "), F.format_string("%.3f", "observed_value"), F.lit("."))
    apart = divergence(scans, left, right, most).select(F.lit("XSENSOR_DIVERGENCE").alias("issue_type"), "window_start", "window_end", "affected_rows", "observed_value", text.alias("details"))
    return gap.unionByName(flat).unionByName(apart).withColumn("severity", severity(F.col("issue_type")))


def capped_details(details: DataFrame, by: str, order: list[str], most: int = C.DETAIL_CAP) -> DataFrame:
    """At most ``most`` details per type, and a row that says so where more exist."""
    w = Window.partitionBy(by).orderBy(*order)
    kept = details.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    text = F.concat(F.lit("Per-event detail for "), F.col(by), F.lit(f" was capped at {most:,} rows. The summary row above carries the exact total."))
    said = {by: F.col(by), "severity": F.lit("INFO"), "affected_rows": F.lit(0), "is_summary": F.lit(True), "details": text}
    over = details.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    return kept.unionByName(over.select(*[said.get(c, F.lit(None)).cast(t).alias(c) for c, t in details.dtypes]))


def reconciliation(read: int | Column, rejected_rows, missing, inserted, skipped, sensors: int) -> list[Column]:
    """Expected against accounted readings; CRITICAL unless they agree."""
    expected = (read - rejected_rows) * sensors - missing
    short = expected - (inserted + skipped)
    return [expected.alias("expected"), short.alias("shortfall"), F.when(short == 0, "INFO").otherwise("CRITICAL").alias("severity")]


def run_status(rows_read: int, truncated: bool) -> str:
    return "FAILED" if rows_read == 0 else "PARTIAL" if truncated else "SUCCEEDED"
