"""Operating states, baselines, detectors, trends, forecasts, failure analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import block_of, day_of, epoch, hours_between, operating_state, pct, severity_by_z, trusted, with_states

from .ordered import lagged, running, runs
from .quantiles import exact_quantiles
from .sliding import before_each
from .validate import cell_quality, melted

# --- states -----------------------------------------------------------------------


def scan_states(readings: DataFrame, current_id: int, compressor_id: int, bands=C.STATE_BANDS) -> DataFrame:
    """(reading_ts, motor_current, operating_state, comp_active, is_stale), one row per
    reading of the current sensor; comp_active is null where the switch has none."""
    m = readings.where(F.col("sensor_id") == current_id).select("reading_ts", F.col("value").alias("motor_current"), F.col("quality_code_id").alias("q"))
    c = readings.where(F.col("sensor_id") == compressor_id).select("reading_ts", F.col("value").alias("c"))
    active = F.when(F.col("c") >= 0.5, True).when(F.col("c").isNotNull(), False)
    return m.join(c, "reading_ts", "left").select("reading_ts", "motor_current", operating_state(F.col("motor_current"), bands).alias("operating_state"), active.alias("comp_active"), (F.col("q") == C.STALE).alias("is_stale"))


def stated(scans: DataFrame, signals: list[tuple[int, str, float, float, bool]], current_id: int, bands=C.STATE_BANDS) -> DataFrame:
    """``melted`` readings with the ``operating_state`` and ``is_stale`` that ``scan_states``
    has at their instant: a scan's readings share its row, so nothing is joined."""
    _, current, low, high, digital = next(s for s in signals if s[0] == current_id)
    q = cell_quality(F.col(current), low, high, digital, F.col("is_stale"))
    d = scans.where(q != C.MISSING).withColumns({"operating_state": operating_state(F.col(current), bands), "_held": q == C.STALE})
    return melted(d, signals, ("operating_state", "_held")).withColumnRenamed("_held", "is_stale")


def state_distribution(states: DataFrame) -> DataFrame:
    return states.groupBy("operating_state").agg(F.count(F.lit(1)).alias("scans"), F.sum(F.col("is_stale").cast("long")).alias("stale_scans"))


def duty_cycle(states: DataFrame, scan_seconds: float = C.SCAN_SECONDS) -> DataFrame:
    """Scans per state and day, share loaded, hours running, and a seven-day running share (at least three days)."""
    n = lambda *s: F.count_if(F.col("operating_state").isin(*s))
    d = states.groupBy(day_of(F.col("reading_ts")).alias("bucket_date")).agg(
        F.count(F.lit(1)).alias("usable_scans"),
        *[n(s).alias(f"{s.lower()}_scans") for s in C.STATES],
        pct(n("LOADED"), F.count(F.lit(1))).alias("loaded_pct"),
        (n("LOADED", "OFFLOADED", "STARTING") * float(scan_seconds) / 3600.0).alias("running_hours"),
        pct(n("LOADED", "OFFLOADED", "STARTING"), F.count(F.lit(1))).alias("running_pct"),
    )
    w = Window.orderBy("bucket_date").rowsBetween(-6, 0)
    return d.withColumn("running_pct_7d", F.when(F.count("running_pct").over(w) >= 3, F.avg("running_pct").over(w)))


# --- baselines --------------------------------------------------------------------

PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def baselines(readings: DataFrame, states: DataFrame | None, start: str, end: str, name: str, min_samples: int = C.BASELINE_MIN_SAMPLES, wanted=C.BASELINE_STATES, approximate: bool = False, selected: bool = False) -> DataFrame:
    """Statistics and IQR fences per sensor and state over trusted readings of a window.

    Percentiles are exact.  On groups of more readings than a task can hold, ``selected``
    finds them by selection, exact as well, in some more passes; ``approximate`` takes a
    sketch's in one.  Without ``states`` the readings bring theirs (``stated``).
    """
    v = F.col("value").cast("double")
    ps = F.array(*map(F.lit, PERCENTILES))
    p = F.percentile_approx(v, list(PERCENTILES), 100_000) if approximate else F.percentile(v, ps)
    inside = lambda d: d.where((F.col("reading_ts") >= F.to_timestamp_ntz(F.lit(start))) & (F.col("reading_ts") < F.to_timestamp_ntz(F.lit(end))))
    r = inside(readings).where(trusted(F.col("quality_code_id")))
    by = ["sensor_id", "operating_state"]
    rows = with_states(r, states if states is None else inside(states)).where(F.col("operating_state").isin(*wanted))
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.avg(v).alias("mean_value"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev_value")]
    if selected:
        d = rows.groupBy(*by).agg(*aggs).join(exact_quantiles(rows, by, "value", PERCENTILES).select(*by, F.col("q").alias("p")), by)
    else:
        d = rows.groupBy(*by).agg(*aggs, p.alias("p"))
    d = d.where(F.col("sample_count") >= min_samples)
    low, high = F.col("p")[1], F.col("p")[3]
    return d.select(
        "sensor_id",
        "operating_state",
        F.lit(name).alias("baseline_name"),
        "sample_count",
        "mean_value",
        "stddev_value",
        *[F.col("p")[k].alias(n) for k, n in enumerate(("p01", "p25", "p50", "p75", "p99"))],
        (low - C.IQR_FENCE * (high - low)).alias("iqr_lower_fence"),
        (high + C.IQR_FENCE * (high - low)).alias("iqr_upper_fence"),
        ((high - low == 0) | (F.col("stddev_value") == 0)).alias("is_degenerate"),
    )


def stored_baselines(base: DataFrame, name: str) -> DataFrame:
    """The baselines of one name, a row per sensor and state."""
    return base.where(F.col("baseline_name") == name)


def state_against_global(readings: DataFrame, states: DataFrame, sensor_id: int) -> DataFrame:
    """Quartiles per state and over all states, in one pass over grouping sets."""
    v = F.col("value").cast("double")
    r = readings.where((F.col("sensor_id") == sensor_id) & trusted(F.col("quality_code_id")))
    d = r.join(states.where("not is_stale").select("reading_ts", "operating_state"), "reading_ts")
    p = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    g = d.groupingSets([["operating_state"], []], "operating_state").agg(F.grouping("operating_state").alias("g"), F.count(F.lit(1)).alias("n"), p.alias("p"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))
    return g.select(F.when(F.col("g") == 1, "(all states)").otherwise(F.col("operating_state")).alias("state"), "n", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p75"), "min_value", "max_value")


# --- detectors --------------------------------------------------------------------

ANOMALY = ("sensor_id", "reading_ts", "value", "expected_low", "expected_high", "method", "score", "severity", "operating_state")


def persistent(df: DataFrame, by: list[str], order: str, flag: Column, required: int = C.PERSISTENCE) -> DataFrame:
    """Rows with ``flag`` in runs of at least ``required`` consecutive rows."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("_f").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_i"))).where(F.col("_n") >= required).drop("_f", "_i", "_n")


HOURS_PER_BLOCK, HOURS_PER_PIECE = 1_024, 4_096  # of a sensor's and state's hourly means


def detect_mad(hourly_state: DataFrame, window: int = C.ADAPTIVE_WINDOW, min_history: int = C.ADAPTIVE_MIN_HISTORY, persistence: int = C.PERSISTENCE) -> DataFrame:
    """Robust z-score of each hourly value against the same sensor's and state's
    ``window`` buckets before it (never itself)."""
    by = ["sensor_id", "operating_state"]
    d = hourly_state.withColumn("_block", F.floor(block_of(F.col("bucket_start")) / HOURS_PER_BLOCK))
    d = before_each(d, by, "_block", "bucket_start", "avg_value", window, min_history, HOURS_PER_PIECE).drop("_block")
    d = d.withColumn("_z", F.when(F.col("_mad") > 0, C.MAD_SCALE * (F.col("avg_value") - F.col("_m")) / F.col("_mad")))
    d = persistent(d, ["sensor_id", "operating_state"], "bucket_start", F.abs(F.col("_z")) >= C.ROBUST_Z_WARNING, persistence)
    return _robust(d, "bucket_start", "avg_value", "ADAPTIVE_MAD")


def _robust(d: DataFrame, time: str, value: str, method: str) -> DataFrame:
    spread = C.ROBUST_Z_WARNING * F.col("_mad") / C.MAD_SCALE
    score = F.abs(F.col("_z"))
    return d.select("sensor_id", F.col(time).alias("reading_ts"), F.col(value).alias("value"), (F.col("_m") - spread).alias("expected_low"), (F.col("_m") + spread).alias("expected_high"), F.lit(method).alias("method"), score.alias("score"), severity_by_z(score).alias("severity"), "operating_state")


def detect_scan_mad(readings: DataFrame, states: DataFrame, sensors: list[int], window: int = C.ADAPTIVE_WINDOW, min_history: int = C.ADAPTIVE_MIN_HISTORY, persistence: int = C.PERSISTENCE) -> DataFrame:
    """``detect_mad`` on single trusted readings of ``sensors`` instead of hourly means: the
    window is ``window`` readings of the same sensor and state.

    Series are cut into blocks and pieces throughout, so none has to fit in one task.
    """
    by = ["sensor_id", "operating_state"]
    r = readings.where(F.col("sensor_id").isin(*sensors) & trusted(F.col("quality_code_id"))).select("sensor_id", "reading_ts", "value")
    d = r.join(states.where("not is_stale").select("reading_ts", "operating_state"), "reading_ts").withColumn("_block", block_of(F.col("reading_ts")))
    d = before_each(d, by, "_block", "reading_ts", "value", window, min_history)
    d = d.withColumn("_z", F.when(F.col("_mad") > 0, C.MAD_SCALE * (F.col("value") - F.col("_m")) / F.col("_mad")))
    d = runs(d, by, "_block", ["reading_ts"], F.abs(F.col("_z")) >= C.ROBUST_Z_WARNING).where(F.col("run_length") >= persistence)
    return _robust(d, "reading_ts", "value", "SCAN_MAD")


def detect_iqr(hourly_state: DataFrame, base: DataFrame, persistence: int = C.PERSISTENCE) -> DataFrame:
    """Hourly values outside the stored fences of their sensor and state."""
    b = base.where("p75 - p25 > 0").select("sensor_id", "operating_state", F.col("iqr_lower_fence").alias("_lo"), F.col("iqr_upper_fence").alias("_hi"), (F.col("p75") - F.col("p25")).alias("_iqr"))
    d = hourly_state.join(b, ["sensor_id", "operating_state"])
    d = persistent(d, ["sensor_id", "operating_state"], "bucket_start", (F.col("avg_value") < F.col("_lo")) | (F.col("avg_value") > F.col("_hi")), persistence)
    score = F.when(F.col("avg_value") < F.col("_lo"), F.col("_lo") - F.col("avg_value")).otherwise(F.col("avg_value") - F.col("_hi")) / F.col("_iqr")
    return d.select("sensor_id", F.col("bucket_start").alias("reading_ts"), F.col("avg_value").alias("value"), F.col("_lo").alias("expected_low"), F.col("_hi").alias("expected_high"), F.lit("BASELINE_IQR").alias("method"), score.alias("score"), F.when(score >= C.IQR_CRITICAL, "CRITICAL").otherwise("WARNING").alias("severity"), "operating_state")


def setpoint_episodes(readings: DataFrame, sensor_id: int, setpoint: float = C.SETPOINT, min_scans: int = C.SETPOINT_MIN_SCANS, gap_seconds: int | None = C.GAP_SECONDS, minute_groups: bool = False) -> DataFrame:
    """Episodes of trusted readings below a setpoint: (episode_start, episode_end, scans, lowest).

    An episode ends at a gap or a reading that does not qualify.  ``minute_groups``
    instead groups by minute number minus rank, which mixes separate runs; it is kept
    for comparison with archives that were grouped so.
    """
    r = readings.where(F.col("sensor_id") == sensor_id).withColumn("_block", block_of(F.col("reading_ts")))
    low = (F.col("value") < setpoint) & trusted(F.col("quality_code_id"))
    if minute_groups:
        d = running(r.where(low), [], "_block", ["reading_ts"], "_rank", F.lit(1).cast("long"))
        d = d.withColumn("_g", F.floor(epoch(F.col("reading_ts")) / 60) - F.col("_rank"))
    else:
        d = lagged(r.withColumn("_low", F.coalesce(low, F.lit(False))), [], "_block", ["reading_ts"], {"_was": "_low", "_before": "reading_ts"})
        new = ~F.coalesce(F.col("_was"), F.lit(False)) | (epoch(F.col("reading_ts")) - epoch(F.col("_before")) > gap_seconds if gap_seconds is not None else F.lit(False))
        d = running(d, [], "_block", ["reading_ts"], "_g", (F.col("_low") & new).cast("long")).where("_low")
    e = d.groupBy("_g").agg(F.min("reading_ts").alias("episode_start"), F.max("reading_ts").alias("episode_end"), F.count(F.lit(1)).alias("scans"), F.min("value").alias("lowest"))
    return e.where(F.col("scans") >= min_scans).drop("_g")


def detect_setpoint(episodes: DataFrame, sensor_id: int, setpoint: float = C.SETPOINT, critical: float = C.SETPOINT_CRITICAL) -> DataFrame:
    return episodes.select(F.lit(sensor_id).alias("sensor_id"), F.col("episode_start").alias("reading_ts"), F.col("lowest").alias("value"), F.lit(setpoint).alias("expected_low"), F.lit(None).cast("double").alias("expected_high"), F.lit("SETPOINT").alias("method"), (setpoint - F.col("lowest")).alias("score"), F.when(F.col("lowest") < critical, "CRITICAL").otherwise("WARNING").alias("severity"), F.lit(None).cast("string").alias("operating_state"))


def alarm_rate(anomalies: DataFrame, days: float) -> DataFrame:
    per_day = F.col("total") / float(days)
    verdict = F.when(per_day <= C.ALARMS_TARGET, "WITHIN TARGET").when(per_day <= C.ALARMS_MAX, "MANAGEABLE").otherwise("ALARM FLOOD")
    return anomalies.groupBy("method").agg(F.count(F.lit(1)).alias("total")).select("method", "total", per_day.alias("per_day"), verdict.alias("verdict"))


# --- trends and forecasts ---------------------------------------------------------


def trend_frame(hourly: DataFrame, window: int = 24) -> DataFrame:
    """Rolling statistics once a quarter of the window is there; rates by elapsed hours."""
    by = Window.partitionBy("sensor_id").orderBy("bucket_start")
    w = by.rowsBetween(-(window - 1), 0)
    enough = F.count("avg_value").over(w) >= max(window // 4, 2)
    d = hourly.select("sensor_id", "bucket_start", "avg_value", "min_value", "max_value", "sample_count")
    d = d.withColumns({f"rolling_{n}": F.when(enough, f("avg_value").over(w)) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))})
    elapsed = (epoch(F.col("bucket_start")) - epoch(F.lag("bucket_start").over(by))) / 3600.0
    rate = lambda c: F.try_divide(F.col(c) - F.lag(c).over(by), elapsed)
    return d.withColumns({"rate_of_change_per_hour": rate("avg_value"), "trend_slope_per_hour": rate("rolling_mean")})


def trend_summary(trend: DataFrame) -> DataFrame:
    v = F.col("avg_value")
    last = lambda c: F.max_by(c, "bucket_start")
    return trend.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("std"),
        last("avg_value").alias("latest"), last("rolling_mean").alias("latest_rolling_mean"), F.avg("trend_slope_per_hour").alias("mean_slope_per_hour"), F.max(F.abs("rate_of_change_per_hour")).alias("max_abs_rate_of_change"),
    )


def rolling_hours(hourly: DataFrame, window: int = 24) -> DataFrame:
    """Mean and deviation over the last ``window`` rows (1 to 168), change from the row
    before, hours since it and the rate per elapsed hour."""
    by = Window.partitionBy("sensor_id").orderBy("bucket_start")
    w = by.rowsBetween(-(max(1, min(int(window), 168)) - 1), 0)
    change = F.col("avg_value") - F.lag("avg_value").over(by)
    gap = hours_between(F.lag("bucket_start").over(by), F.col("bucket_start"))
    return hourly.select("sensor_id", "bucket_start", "avg_value", "sample_count", F.avg("avg_value").over(w).alias("rolling_mean"), F.stddev_samp("avg_value").over(w).alias("rolling_std"), change.alias("change"), gap.alias("gap_hours"), F.try_divide(change, gap.cast("double")).alias("rate_per_hour"), F.count(F.lit(1)).over(w).alias("window_buckets"))


def daily_series(hourly_state: DataFrame, state: str = "LOADED", min_samples: int = 100) -> DataFrame:
    """Daily means of one state, weighted by samples; thin days are left out."""
    d = hourly_state.where(F.col("operating_state") == state).groupBy("sensor_id", day_of(F.col("bucket_start")).alias("bucket_date"))
    return d.agg(F.try_divide(F.sum(F.col("avg_value") * F.col("sample_count")), F.sum("sample_count").cast("double")).alias("value"), F.sum("sample_count").alias("samples")).where(F.col("samples") >= min_samples)


def _scores(pred: DataFrame) -> DataFrame:
    err = F.col("actual") - F.col("predicted")
    return pred.groupBy("sensor_id", "method").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.when(F.min(F.abs("actual")) > 1e-6, F.avg(100.0 * F.abs(err) / F.abs("actual"))).alias("mape"), F.count(F.lit(1)).alias("n")
    )


def forecast_scores(series: DataFrame, holdout: int = C.HOLDOUT_DAYS, ma: int = C.MA_DAYS, slack: int = 10) -> DataFrame:
    """Walk-forward scores of persistence and a moving average on the last ``holdout``
    days, with the improvement over persistence; short series have none."""
    by = Window.partitionBy("sensor_id").orderBy("bucket_date")
    n = F.count(F.lit(1)).over(Window.partitionBy("sensor_id"))
    d = series.withColumns({"_k": F.row_number().over(by), "_n": n, "_naive": F.lag("value").over(by), "_ma": F.avg("value").over(by.rowsBetween(-ma, -1))})
    d = d.where((F.col("_n") >= holdout + ma + slack) & (F.col("_k") > F.col("_n") - holdout))
    both = F.explode(F.array(F.struct(F.lit("naive_persistence").alias("method"), F.col("_naive").alias("predicted")), F.struct(F.lit(f"moving_average_{ma}d").alias("method"), F.col("_ma").alias("predicted")))).alias("p")
    return improvement(_scores(d.select("sensor_id", F.col("value").alias("actual"), both).select("sensor_id", "actual", "p.*")))


def improvement(scores: DataFrame) -> DataFrame:
    """``scores`` with the percentage by which each mean error is below persistence."""
    naive = F.max(F.when(F.col("method") == "naive_persistence", F.col("mae"))).over(Window.partitionBy("sensor_id"))
    return scores.withColumn("improvement_pct", F.when(F.col("method") != "naive_persistence", 100.0 * F.try_divide(naive - F.col("mae"), naive)))


def forecast_verdict(scores: DataFrame) -> DataFrame:
    """(sensor_id, benchmark_mae, best_method, best_mae, verdict): whether any method beats
    persistence on a series; sensors without that benchmark have no row."""
    naive = F.col("method") == "naive_persistence"
    other = F.when(~naive, F.struct("mae", "method"))
    d = scores.groupBy("sensor_id").agg(F.max(F.when(naive, F.col("mae"))).alias("benchmark_mae"), F.min(other).alias("b")).where("benchmark_mae is not null and b is not null")
    verdict = F.when(F.col("b.mae") < F.col("benchmark_mae"), "BEATS PERSISTENCE").otherwise("NOTHING BEATS PERSISTENCE")
    return d.select("sensor_id", "benchmark_mae", F.col("b.method").alias("best_method"), F.col("b.mae").alias("best_mae"), verdict.alias("verdict"))


def holt_winters_scores(series: DataFrame, holdout: int = C.HOLDOUT_DAYS, ma: int = C.MA_DAYS, slack: int = 10) -> DataFrame:
    """Walk-forward scores of additive-trend exponential smoothing, refitted every day.

    Smoothing is sequential, so a sensor's daily series (a few thousand points) is one
    pandas group; the parameters come from a grid refined around its best point.
    """
    import numpy as np
    import pandas as pd

    def one_step(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level, slope = np.full(a.shape, y[0]), np.full(a.shape, y[1] - y[0])
        sse = np.zeros(a.shape)
        for x in y[1:]:
            ahead = level + slope
            sse += (x - ahead) ** 2
            new = a * x + (1 - a) * ahead
            slope = b * (new - level) + (1 - b) * slope
            level = new
        return sse, level + slope

    def predict(y: np.ndarray) -> float:
        best, width = (0.5, 0.5), 0.5
        for _ in range(4):
            a, b = (np.clip(np.linspace(c - width, c + width, 11), 0.01, 0.99) for c in best)
            a, b = (x.ravel() for x in np.meshgrid(a, b))
            sse, ahead = one_step(y, a, b)
            k = int(np.argmin(sse))
            best, width = (a[k], b[k]), width / 4
        return float(ahead[k])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = g.sort_values("bucket_date")["value"].to_numpy(float)
        first = len(y) - holdout
        return pd.DataFrame({"sensor_id": g["sensor_id"].iloc[0], "actual": y[first:], "method": "holt_winters_additive", "predicted": [predict(y[:k]) for k in range(first, len(y))]})

    long = series.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= holdout + ma + slack).select("sensor_id")
    series = series.select("sensor_id", "bucket_date", "value").join(long, "sensor_id", "left_semi")
    return _scores(series.groupBy("sensor_id").applyInPandas(run, "sensor_id int, actual double, method string, predicted double"))


# --- failures ---------------------------------------------------------------------


def lead_up_windows(failures: DataFrame, hours=C.LEAD_UP_HOURS) -> DataFrame:
    """One row per failure and horizon: the stretch of so many hours before its start."""
    h = F.explode(F.array(*map(F.lit, hours))).alias("hours")
    d = failures.select("failure_event_id", "source_reference", "start_ts", "end_ts", h)
    return d.withColumn("window_start", F.col("start_ts") - F.make_dt_interval(F.lit(0), F.col("hours")))


CELLS = 16  # cells of a window: up to two more where its edges lie inside cells


def _cell(ts: Column, seconds: int, level: Column) -> Column:
    return F.call_function("shiftright", F.floor(epoch(ts) / seconds), level)


def window_cells(windows: DataFrame, start: str, end: str, cell_seconds: int = 86_400) -> DataFrame:
    """``windows`` once for each cell of time that covers them (``_level``, ``_d``).

    A cell of level k is ``cell_seconds << k`` long; a window takes the first level at which
    about ``CELLS`` cells cover it, so it becomes a bounded number of rows whatever its
    length.  Windows without an edge, or that end before they start, have no cells.
    """
    a, z = (F.floor(epoch(F.col(c)) / cell_seconds) for c in (start, end))
    level = F.ceil(F.log2((z - a + 1) / F.lit(float(CELLS)))).cast("int")
    w = windows.where(F.col(start) <= F.col(end)).withColumn("_level", F.greatest(F.lit(0), level))
    first, last = (_cell(F.col(c), cell_seconds, F.col("_level")) for c in (start, end))
    return w.withColumn("_d", F.explode(F.sequence(first, last)))


def inside_windows(rows: DataFrame, windows: DataFrame, time: str, start: str = "window_start", end: str = "start_ts", closed: bool = False, cell_seconds: int = 86_400) -> DataFrame:
    """Range join of windows, half-open or ``closed``, with the rows inside them.

    Both sides meet on cells of time, so it stays an equi-join however many windows there
    are; a row looks into one cell of each level that some window has.
    """
    w = window_cells(windows, start, end, cell_seconds)
    levels = w.agg(F.collect_set("_level").alias("_levels"))  # one row, a level for each power of two at most
    r = rows.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).withColumn("_d", _cell(F.col(time), cell_seconds, F.col("_level"))).drop("_levels")
    before = F.col(time) <= F.col(end) if closed else F.col(time) < F.col(end)
    return r.join(w, ["_level", "_d"]).where((F.col(time) >= F.col(start)) & before).drop("_level", "_d")


def failure_correlation(readings: DataFrame, failures: DataFrame, base: DataFrame) -> DataFrame:
    """Per failure and horizon: scans, held, usable share, mean over trusted readings and
    z against a one-row baseline (mean_value, stddev_value); gated at half usable."""
    ok = trusted(F.col("quality_code_id"))
    v = F.when(ok, F.col("value").cast("double"))
    d = inside_windows(readings, lead_up_windows(failures), "reading_ts").groupBy("failure_event_id", "source_reference", "start_ts", "hours")
    d = d.agg(F.count(F.lit(1)).alias("total_scans"), F.count_if(F.col("quality_code_id") == C.STALE).alias("held_scans"), F.count_if(ok).alias("usable_scans"), F.avg(v).alias("m"), F.stddev_samp(v).alias("usable_stddev"), F.max(v).alias("usable_max"))
    share = pct(F.col("usable_scans"), F.col("total_scans"))
    gate = lambda c: F.when(share < 50, None).otherwise(c)
    return d.crossJoin(base.select(F.col("mean_value").alias("baseline_mean"), F.col("stddev_value").alias("baseline_stddev"))).select(
        "source_reference", "start_ts", "hours", "total_scans", "held_scans", share.alias("usable_pct"), gate(F.col("m")).alias("lead_up_mean"), "usable_max", "baseline_mean",
        gate(F.try_divide(F.col("m") - F.col("baseline_mean"), F.col("baseline_stddev"))).alias("z_vs_baseline"), F.when(share < 50, "INSUFFICIENT DATA").otherwise("COMPARABLE").alias("verdict"),
    )


def window_analysis(readings: DataFrame, states: DataFrame, failures: DataFrame, base: DataFrame) -> DataFrame:
    """Per failure, horizon, sensor and state, against the stored baseline."""
    ok = trusted(F.col("quality_code_id"))
    d = inside_windows(readings, lead_up_windows(failures), "reading_ts").join(states.select("reading_ts", "operating_state"), "reading_ts")
    d = d.groupBy("source_reference", "hours", "sensor_id", "operating_state").agg(F.count(F.lit(1)).alias("total_scans"), F.count_if(ok).alias("usable_scans"), F.avg(F.when(ok, F.col("value").cast("double"))).alias("mean_value"))
    b = base.select("sensor_id", "operating_state", F.col("mean_value").alias("baseline_mean"), F.col("stddev_value").alias("baseline_sd"))
    d = d.join(b, ["sensor_id", "operating_state"], "left")
    fine = (F.col("usable_scans") / F.col("total_scans") >= C.MIN_USABLE_FRACTION) & F.col("mean_value").isNotNull()
    return d.withColumns({"is_usable": fine, "z_vs_baseline": F.when(fine & (F.col("baseline_sd") > 0), (F.col("mean_value") - F.col("baseline_mean")) / F.col("baseline_sd"))})


def state_comparison(readings: DataFrame, states: DataFrame, failures: DataFrame, base: DataFrame, sensor_id: int) -> DataFrame:
    """Means of one sensor by failure, horizon and state over readings that are not held."""
    held = F.col("quality_code_id") == C.STALE
    r = readings.where(F.col("sensor_id") == sensor_id)
    d = inside_windows(r, lead_up_windows(failures), "reading_ts").join(states.select("reading_ts", "operating_state"), "reading_ts")
    d = d.groupBy("source_reference", "hours", "operating_state").agg(F.count(F.lit(1)).alias("scans"), F.count_if(held).alias("held"), F.avg(F.when(~held, F.col("value").cast("double"))).alias("m"))
    b = base.where(F.col("sensor_id") == sensor_id).select("operating_state", F.col("mean_value").alias("b"), F.col("stddev_value").alias("s"))
    d = d.join(b, "operating_state", "left")
    return d.select(
        F.col("source_reference").alias("event"), F.col("hours").alias("hours_before"), F.col("operating_state").alias("state"), "scans", "held", pct(F.col("scans") - F.col("held"), F.col("scans")).alias("usable_pct"), F.col("m").alias("mean"),
        F.when(F.col("b") != 0, F.col("b")).alias("baseline_mean"), F.when(F.col("s") > 0, (F.col("m") - F.col("b")) / F.col("s")).alias("z"),
    )


def lead_time(anomalies: DataFrame, failures: DataFrame, bounds: DataFrame, hours: int = 24) -> DataFrame:
    """Anomaly rates inside the windows (hours before a failure to its end) against
    elsewhere, per method; overlapping windows count twice."""
    w = failures.withColumn("_from", F.col("start_ts") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    spans = w.agg(F.coalesce(F.sum(epoch(F.col("end_ts")) - epoch(F.col("_from"))) / 3600.0, F.lit(0.0)).alias("window_hours"))
    hits = inside_windows(anomalies.select("method", "reading_ts"), w, "reading_ts", "_from", "end_ts").groupBy("method").agg(F.count(F.lit(1)).alias("i"))
    d = anomalies.groupBy("method").agg(F.count(F.lit(1)).alias("total")).join(hits, "method", "left").crossJoin(spans)
    d = d.crossJoin(bounds.select(hours_between(F.col("first_ts"), F.col("last_ts")).alias("archive_hours")))
    inside = F.coalesce("i", F.lit(0))
    other = F.greatest(F.col("archive_hours") - F.col("window_hours"), F.lit(1.0))
    d = d.select("method", inside.alias("anomalies_in_windows"), (F.col("total") - inside).alias("anomalies_elsewhere"), "window_hours", other.alias("other_hours"))
    d = d.withColumns({"rate_in_windows_per_hour": F.coalesce(F.try_divide(F.col("anomalies_in_windows"), F.col("window_hours")), F.lit(0.0)), "rate_elsewhere_per_hour": F.col("anomalies_elsewhere") / F.col("other_hours")})
    return d.withColumn("enrichment", F.try_divide("rate_in_windows_per_hour", "rate_elsewhere_per_hour"))


# --- further analyses -------------------------------------------------------------


def naive_flag_rate(readings: DataFrame, states: DataFrame, base: DataFrame) -> DataFrame:
    """Share of single readings outside the fences of their sensor and state: what an
    alarm on every reading, without persistence, would cost."""
    r = readings.where(trusted(F.col("quality_code_id"))).join(states.where("not is_stale").select("reading_ts", "operating_state"), "reading_ts")
    d = r.join(base.select("sensor_id", "operating_state", "iqr_lower_fence", "iqr_upper_fence"), ["sensor_id", "operating_state"])
    out = (F.col("value") < F.col("iqr_lower_fence")) | (F.col("value") > F.col("iqr_upper_fence"))
    return d.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("readings"), F.count_if(out).alias("flagged"), pct(F.count_if(out), F.count(F.lit(1))).alias("flagged_pct"))


def monthly_state_means(hourly_state: DataFrame) -> DataFrame:
    """Sample-weighted means per sensor, state and month."""
    d = hourly_state.groupBy("sensor_id", "operating_state", F.date_format("bucket_start", "yyyy-MM").alias("month"))
    return d.agg(F.try_divide(F.sum(F.col("avg_value") * F.col("sample_count")), F.sum("sample_count").cast("double")).alias("mean_value"), F.sum("sample_count").alias("samples"))
