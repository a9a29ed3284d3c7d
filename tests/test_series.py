"""Carries in two levels, range joins over cells of many lengths, sliding order statistics."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import analysis, ordered, profile, sliding

T0 = datetime(2024, 1, 1)
SPAN = 1 << ordered.SPAN_BITS


@pytest.fixture(scope="module")
def long_series(spark):
    """Two series over many spans, some blocks and whole spans empty, some values unknown."""
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        k = -3 * SPAN
        while k < 4 * SPAN:
            k += rng.choice([1, 1, 1, 7, 40, SPAN + 5 if rng.random() < 0.02 else 2])
            rows += [(g, k, k * 10 + j, rng.choice([None, rng.randint(0, 9)]), rng.random() < 0.97) for j in range(rng.randint(1, 3))]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, b long, k long, v long, f boolean").cache()
    yield d
    d.unpersist()


@pytest.mark.parametrize("by, spans", [(["g"], True), ([], True), (["g"], False)])
def test_carries_equal_one_window(long_series, by, spans):
    d = long_series if by else long_series.where("g = 'a'")
    w = Window.partitionBy(*by).orderBy("k")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = d.select("g", "k", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.last("v", True).over(up).alias("filled"))
    x = ordered.leading(ordered.lagged(d, by, "b", ["k"], {"p": "v"}, spans), by, "b", ["k"], {"n": "v"}, spans)
    x = ordered.running(ordered.running(x, by, "b", ["k"], "s", F.col("v"), spans=spans), by, "b", ["k"], "m", F.col("v"), "max", before=True, spans=spans)
    x = ordered.filled(x.withColumn("filled", F.col("v")), by, "b", ["k"], ("filled",), spans)
    assert sorted(map(tuple, x.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("spans", [False, True])
def test_runs_over_spans(long_series, spans):
    rows = sorted(long_series.select("g", "k", "f").collect())
    want, size = {}, {}
    island = {"a": 0, "b": 0}
    for g, k, f in rows:
        island[g] += not f
        want[g, k] = (g, island[g]) if f else None
        size[g, island[g]] = size.get((g, island[g]), 0) + f
    got = {(r["g"], r["k"]): r["run_length"] for r in ordered.runs(long_series, ["g"], "b", ["k"], F.col("f"), spans=spans).collect()}
    assert got == {x: size[i] if i else 0 for x, i in want.items()}
    all_of_it = ordered.runs(long_series, ["g"], "b", ["k"], F.lit(True), spans=spans).groupBy("g").agg(F.min("run_length").alias("a"), F.max("run_length").alias("z"), F.count("*").alias("n")).collect()
    assert all(r["a"] == r["z"] == r["n"] for r in all_of_it)


def test_no_task_orders_all_edges(long_series):
    """Windows over edges hold a span's blocks, or one row per span."""
    edges = long_series.groupBy("g", "b").agg(F.sum("v").alias("c"))
    spans = edges.select("g", F.shiftright("b", ordered.SPAN_BITS).alias("s")).groupBy("g", "s").count()
    assert spans.agg(F.max("count")).first()[0] <= SPAN and spans.count() < edges.count() / 50
    out = ordered.carried(edges, ["g"], "b", {"c": "sum"}, spans=True)
    assert out.count() == edges.count()
    assert ordered.carried(edges.where("false"), ["g"], "b", {"c": "last"}, spans=True).count() == 0


def windows(spark, rng):
    """From no time to years, some upside down or without an edge."""
    rows = []
    for n in range(120):
        start = T0 + timedelta(seconds=rng.randint(0, 500 * 86400))
        length = timedelta(seconds=int(10 ** rng.uniform(0, 7.9)))
        rows.append((n, start, start + length))
    rows += [(200, T0, T0), (201, T0 + timedelta(days=9), T0), (202, None, T0), (203, T0, None), (204, datetime(1960, 1, 1), datetime(2060, 1, 1)), (205, T0, T0 + timedelta(days=9))]
    return rows, spark.createDataFrame(rows, "n int, window_start timestamp_ntz, start_ts timestamp_ntz")


@pytest.mark.parametrize("closed", [False, True])
def test_windows_of_any_length(spark, closed):
    rng = random.Random(8)
    rows, w = windows(spark, rng)
    times = [T0 + timedelta(seconds=rng.randint(-86400, 600 * 86400)) for _ in range(300)] + [T0, T0 + timedelta(days=9), datetime(1961, 5, 5)]
    times += [r[1] for r in rows[:40]] + [r[2] for r in rows[:40]]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(times)] + [(-1, None)], "k int, at timestamp_ntz")
    got = sorted((r["n"], r["k"]) for r in analysis.inside_windows(d, w, "at", closed=closed).collect())
    want = sorted((n, k) for n, a, z in rows if a and z for k, t in enumerate(times) if a <= t and (t <= z if closed else t < z))
    assert got == want
    assert analysis.inside_windows(d, w.where("false"), "at").count() == 0


def test_a_window_is_a_bounded_number_of_cells(spark):
    rows, w = windows(spark, random.Random(8))
    cells = analysis.window_cells(w, "window_start", "start_ts")
    n = {r["n"]: r["count"] for r in cells.groupBy("n").count().collect()}
    assert set(n) == {k for k, a, z in rows if a and z and a <= z} and max(n.values()) <= analysis.CELLS + 2
    assert {r["_level"] for r in cells.where("n = 205").collect()} == {0} and n[205] == 10
    assert cells.select("_level").distinct().count() > 3


def test_failure_profile_ends_are_inside(spark):
    s = spark.createDataFrame([(T0 + timedelta(hours=h), float(h)) for h in range(100)], "scan_ts timestamp_ntz, x double")
    f = spark.createDataFrame([(1, "f", T0, T0 + timedelta(hours=60)), (2, "g", T0 + timedelta(days=50), T0 + timedelta(days=51))], "failure_event_id int, source_reference string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {r["failure_event_id"]: (r["scans"], r["mean_x"]) for r in profile.failure_profile(s, f, ["x"], 3600).collect()}
    assert got == {1: (61, 30.0), 2: (0, None)}


def plain(values, window, least):
    for k in range(len(values)):
        h = sorted(x for x in values[max(0, k - window) : k] if x is not None)
        if len(h) < max(least, 1):
            yield len(h), None, None
            continue
        mid = lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2.0
        m = mid(h)
        yield len(h), m, mid(sorted(abs(x - m) for x in h))


@pytest.mark.parametrize("window, least", [(1, 0), (2, 1), (5, 3), (48, 12), (200, 1)])
def test_order_statistics_equal_sorting(window, least):
    rng = random.Random(window)
    for values in ([rng.gauss(0, 1) for _ in range(700)], [rng.choice([None, 1.0, 2.0, 2.0, -0.5]) for _ in range(700)], [3.0] * 50, [float(k) for k in range(300)], [-(2.0**k) for k in range(60)]):
        s, got = sliding.Sliding(window), []
        for x in values:
            got.append((len(s), *(s.middle() if len(s) >= max(least, 1) else (None, None))))
            s.push(x)
        assert got == list(plain(values, window, least))


def test_not_finite_values_come_and_go():
    s = sliding.Sliding(3)
    for x in (1.0, math.nan, 2.0):
        s.push(x)
    assert s.middle()[0] == 2.0
    s.push(math.inf)
    s.push(4.0)
    assert s.middle()[0] == 4.0 and len(s) == 3
    for x in (5.0, 6.0):
        s.push(x)
    assert s.middle() == (5.0, 1.0) and s.odd == 0


@pytest.mark.parametrize("cut", [1, 60, 10_000])
def test_pieces_equal_whole_series(spark, cut):
    rng = random.Random(cut)
    rows = [(g, T0 + timedelta(minutes=7 * k), rng.choice([None, *[rng.gauss(0, 3)] * 9]), k) for g in range(3) for k in range(400)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g int, t timestamp_ntz, v double, k int").withColumn("b", F.floor(F.col("k") / 37))
    got = {}
    for r in sliding.before_each(d, ["g"], "b", "t", "v", 25, 6, cut).collect():
        assert (r["g"], r["k"]) not in got
        got[r["g"], r["k"]] = (r["_n"], r["_m"], r["_mad"])
    for g in range(3):
        series = [x[2] for x in sorted((x for x in rows if x[0] == g), key=lambda x: x[1])]
        want = list(plain(series, 25, 6))
        assert [got[g, k] for k in range(400)] == want
    assert sliding.before_each(d.where("false"), ["g"], "b", "t", "v", 25, 6).count() == 0


def test_scan_detector_equals_hourly_one(spark):
    """On hourly readings both detectors say the same."""
    rng = random.Random(2)
    rows = [(s, T0 + timedelta(hours=h), 50.0 if h % 190 in (100, 101, 102, 103) else rng.gauss(10, 1), 192) for s in (1, 2) for h in range(600)]
    r = spark.createDataFrame(rows, "sensor_id int, reading_ts timestamp_ntz, value double, quality_code_id int")
    st = spark.createDataFrame([(T0 + timedelta(hours=h), "LOADED", h % 50 == 0) for h in range(600)], "reading_ts timestamp_ntz, operating_state string, is_stale boolean")
    hours = r.join(st.where("not is_stale"), "reading_ts").select("sensor_id", "operating_state", F.col("reading_ts").alias("bucket_start"), F.col("value").alias("avg_value"))
    got, want = analysis.detect_scan_mad(r, st, [1, 2], 40, 10, 2), analysis.detect_mad(hours, 40, 10, 2)
    assert sorted(map(tuple, got.drop("method").collect())) == sorted(map(tuple, want.drop("method").collect()))
    assert want.count() > 10
