"""Hand-computed cases of the operators."""

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import hours_between, minutes_between, operating_state, seconds_between
from tidemark.operators import analysis, compress, ordered, profile, rollup, serve, validate, views
from tidemark.sources import archive

T0 = datetime(2021, 1, 1)
ANALOGUE = ("a1", "a2", "a3", "a4", "a5", "a6", "a7")
DIGITAL = ("d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8")
SIGNALS = [(k + 1, c, -1.0, 16.0, False) for k, c in enumerate(ANALOGUE)] + [(k + 8, c, 0.0, 1.0, True) for k, c in enumerate(DIGITAL)]


def raw(spark, lines):
    """lines: (timestamp, analogue value, overrides)"""
    data = []
    for k, (t, v, over) in enumerate(lines):
        row = {"source_index": k * 10, "source_line_no": k + 2, "timestamp": t if isinstance(t, str) else t.strftime("%Y-%m-%d %H:%M:%S"), **{c: v for c in ANALOGUE}, **{c: 1.0 for c in DIGITAL}, **over}
        data.append(tuple(row.values()))
    return spark.createDataFrame(data, "source_index long, source_line_no long, timestamp string, " + ", ".join(f"{c} double" for c in ANALOGUE + DIGITAL))


@pytest.fixture(scope="module")
def hostile(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    lines = [(at(0), 5.0, {}), (at(10), 5.1, {}), (at(20), 5.2, {}), ("not-a-timestamp", 5.3, {}), (at(30), 5.4, {}), (at(30), 5.5, {}), (at(25), 5.6, {}), (at(40), 5.7, {"a1": 999.0, "d1": 0.5}), (at(7200), 7.0, {})]
    lines += [(at(7200 + 10 * k), 7.0, {}) for k in range(1, 7)] + [(at(7270), 8.0, {})]
    return raw(spark, lines)


@pytest.mark.parametrize("by_line", [False, True])
def test_hostile_file(hostile, by_line):
    o = validate.checked_order(hostile, by_line)
    reasons = sorted(r["reason_code"] for r in validate.rejected(o, ["source_index", "timestamp"]).collect())
    assert reasons == ["DUPLICATE_TIMESTAMP", "NON_MONOTONIC_TIMESTAMP", "UNPARSEABLE_TIMESTAMP"]
    clean = validate.frozen(o, ANALOGUE)
    stored = validate.melted(clean, SIGNALS)
    assert stored.count() == 13 * 15
    by = {r[0]: r[1] for r in stored.groupBy("quality_code_id").count().collect()}
    assert by[C.STALE] == 90 and by[C.BAD_RANGE] == 1 and by[C.BAD_DIGITAL] == 1
    totals = {(r["issue_type"], r["sensor_id"]): r["affected_rows"] for r in validate.issue_totals(o, clean, SIGNALS, "a1", "a2").collect()}
    assert totals["FLATLINE", None] == 6 and totals["OUT_OF_RANGE", 1] == 1 and totals["NON_BINARY_DIGITAL", 8] == 1 and totals["GAP", None] == 1


def test_step_back_and_recovery(spark):
    """30, 20 (dropped), 25: too early as well, unless only the line above counts."""
    at = lambda s: T0 + timedelta(seconds=s)
    lines = raw(spark, [(at(10), 1.0, {}), (at(30), 1.1, {}), (at(20), 1.2, {}), (at(25), 1.3, {})])
    n = lambda d: d.where("reject is not null").count()
    assert n(validate.checked_order(lines)) == 2 and n(validate.checked_order(lines, True)) == 1


def test_flatline_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(validate, "LINES_PER_BLOCK", 3)
    lines = raw(spark, [(T0 + timedelta(seconds=10 * k), 5.0, {}) for k in range(10)])
    assert validate.frozen(validate.checked_order(lines), ANALOGUE).where("is_stale").count() == 9
    assert validate.frozen(validate.checked_order(lines.limit(3)), ANALOGUE).where("is_stale").count() == 0


def test_header():
    assert validate.check_header(["timestamp", "a", "z", "y"], ["timestamp", "a"]) == ["y", "z"]
    with pytest.raises(ValueError):
        validate.check_header(["a"], ["timestamp", "a"])


def test_status():
    assert [validate.run_status(0, False), validate.run_status(5, True), validate.run_status(5, False)] == ["FAILED", "PARTIAL", "SUCCEEDED"]


def test_state_bands(spark):
    values = [0, 0.04, 0.999, 1, 4, 4.999, 5, 7, 7.999, 8, 9, 30]
    d = spark.createDataFrame([(float(v),) for v in values], "v double").select(operating_state(F.col("v")).alias("s"))
    assert [r[0] for r in d.collect()] == ["OFF"] * 3 + ["OFFLOADED"] * 3 + ["LOADED"] * 3 + ["STARTING"] * 3


def test_boundaries_are_counted(spark):
    d = spark.createDataFrame([("2024-01-01 00:59:59.9", "2024-01-01 01:00:00.1")], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    a, b = F.col("a"), F.col("b")
    assert tuple(d.select(seconds_between(a, b), minutes_between(a, b), hours_between(a, b)).first()) == (1, 1, 1)


@pytest.mark.parametrize("flags, kept", [([1, 0, 1], 0), ([1, 1, 1], 3), ([0, 1, 1, 1, 0, 1, 1], 3), ([1, 1, 1, 0, 1, 1, 1], 6), ([], 0)])
def test_persistence(spark, flags, kept):
    d = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate(flags)], "g int, k int, f boolean")
    assert analysis.persistent(d, ["g"], "k", F.col("f"), 3).count() == kept
    assert analysis.persistent(d, ["g"], "k", F.col("f"), 1).count() == sum(flags)


def test_modified_z(spark):
    d = spark.createDataFrame([(1, "LOADED", T0 + timedelta(hours=k), float(v)) for k, v in enumerate([1, 2, 3, 4, 100, 100])], "sensor_id int, operating_state string, bucket_start timestamp_ntz, avg_value double")
    r = analysis.detect_mad(d, window=5, min_history=5, persistence=1).collect()
    assert len(r) == 1 and math.isclose(r[0]["score"], 0.6745 * 97 / 1, rel_tol=1e-9) and r[0]["severity"] == "CRITICAL"


def readings(spark, rows):
    return spark.createDataFrame([(1, T0 + timedelta(seconds=s), float(v), q) for s, v, q in rows], "sensor_id int, reading_ts timestamp_ntz, value double, quality_code_id int")


def test_time_weights_stop_at_gaps(spark):
    r = readings(spark, [(0, 1, 192), (10, 2, 192), (5000, 3, 192)])
    assert [x["weight"] for x in rollup.weighted(r).orderBy("reading_ts").collect()] == [10, 30, 10]


def test_latest_and_rollup(spark):
    r = readings(spark, [(0, 5, 192), (10, 7, 65), (20, 6, 8)])
    assert rollup.latest(r).first()["value"] == 6.0
    h = rollup.rollup(r).first()
    assert (h["sample_count"], h["good_count"], h["first_value"], h["last_value"]) == (3, 2, 5.0, 6.0)


def _kept(seconds, values, e, quality=None, gap=30.0, spark=None):
    q = quality or [192] * len(seconds)
    r = readings(spark, list(zip(seconds, values, q)))
    dev = spark.createDataFrame([(1, float(e))], "sensor_id int, deviation double")
    base = {T0 + timedelta(seconds=s): k for k, s in enumerate(seconds)}
    return sorted(base[x["reading_ts"]] for x in compress.compress(r, dev, gap).collect())


def test_door_breaks(spark):
    t = [0, 10, 20, 30, 5000, 5010, 5020]
    kept = _kept(t, [1.0] * 7, 0.5, spark=spark)
    assert {3, 4} <= set(kept)
    kept = _kept([10 * k for k in range(20)], [1.0] * 20, 0.5, [192] * 10 + [65] * 10, spark=spark)
    assert {9, 10} <= set(kept)


def test_door_shapes():
    t = np.arange(100) * 10.0
    assert list(compress.door(t, 0.1 * t, 0.5)) == [0, 99] and list(compress.door(t, np.ones(100), 0.5)) == [0, 99]
    step = np.r_[np.zeros(5), np.full(5, 10.0)]
    assert {4, 5} <= set(compress.door(t[:10], step, 0.5))
    saw = np.arange(500) % 2 * 10.0
    assert len(compress.door(np.arange(500) * 10.0, saw, 0.5)) == 500
    assert len(compress.door(t, t, 0)) == 100 and len(compress.door(t[:2], t[:2], 1)) == 2 and len(compress.door(t[:0], t[:0], 1)) == 0


@pytest.mark.parametrize("seed", range(40))
def test_door_keeps_its_promise(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 600)
    t = np.cumsum([rng.uniform(9, 13) for _ in range(n)])
    shapes = [lambda k: math.sin(k / 9) * 5, lambda k: k * 0.01, lambda k: rng.gauss(0, 1), lambda k: float(k // 50)]
    for f in shapes:
        v = np.array([f(k) for k in range(n)])
        e = rng.uniform(0.01, 1)
        kept = compress.door(t, v, e)
        assert kept[0] == 0 and kept[-1] == n - 1
        assert np.abs(np.interp(t, t[kept], v[kept]) - v).max() <= e + 1e-9


def test_value_at(spark):
    kept = readings(spark, [(0, 0, 192), (20, 10, 192), (1000, 50, 192)])
    sensors = spark.createDataFrame([(1, "Analogue")], "sensor_id int, sensor_class string")
    ask = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in (-5, 0, 5, 20, 500, 1000, 2000)], "sensor_id int, at timestamp_ntz")
    got = {int((r["at"] - T0).total_seconds()): (r["value"], r["method"]) for r in compress.value_at(kept, ask, sensors).collect()}
    assert got == {0: (0.0, "EXACT"), 5: (2.5, "INTERPOLATED"), 1000: (50.0, "EXACT"), 2000: (50.0, "HELD_END_OF_ARCHIVE")}


def test_stitched_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(k % 3, k, rng.randint(0, 5)) for k in range(300)]
    d = spark.createDataFrame(rows, "g int, k int, v int").withColumn("b", F.floor(F.col("k") / 17))
    out = ordered.running(ordered.leading(ordered.lagged(d, ["g"], "b", ["k"], {"p": "v"}), ["g"], "b", ["k"], {"n": "v"}), ["g"], "b", ["k"], "s", F.col("v"))
    for g in range(3):
        mine = out.where(F.col("g") == g).orderBy("k").collect()
        v = [r[2] for r in rows if r[0] == g]
        assert [r["p"] for r in mine] == [None, *v[:-1]] and [r["n"] for r in mine] == [*v[1:], None] and [r["s"] for r in mine] == list(np.cumsum(v))


def test_forecast_on_a_ramp(spark):
    d = spark.createDataFrame([(1, (T0 + timedelta(days=k)).date(), float(k)) for k in range(100)], "sensor_id int, bucket_date date, value double")
    s = {r["method"]: r for r in analysis.forecast_scores(d, 10, 7).collect()}
    assert s["naive_persistence"]["mae"] == 1.0 and s["naive_persistence"]["n"] == 10 and s["moving_average_7d"]["mae"] == 4.0
    assert analysis.forecast_scores(d.limit(5), 10, 7).count() == 0
    assert analysis.holt_winters_scores(d, 10, 7).first()["mae"] < 1e-6


def test_resolution_and_windows():
    h = lambda n: T0 + timedelta(hours=n)
    assert [serve.choose_resolution(T0, h(n)) for n in (6, 6.01, 720, 720.01)] == ["raw", "hourly", "hourly", "daily"]
    assert serve.resolve_window(None, None, h(1000))[0] == h(1000 - 168)
    for bad in ((h(2), h(1)), (T0, T0 + timedelta(days=401))):
        with pytest.raises(serve.InvalidTimeRange):
            serve.resolve_window(*bad, h(9))


def test_lookup(spark):
    s = spark.createDataFrame([(3, "TP3", True)], "sensor_id int, sensor_code string, is_active boolean")
    assert serve.resolve_sensor(s, "3") == serve.resolve_sensor(s, "tp3") == (3, "TP3")
    with pytest.raises(serve.NotFound):
        serve.resolve_sensor(s, "x")


def test_cache_expires():
    now = [0.0]
    calls = []
    c = serve.TimedCache(60, lambda: now[0])
    make = lambda: calls.append(1) or len(calls)
    assert (c.get(make), c.get(make)) == (1, 1)
    now[0] = 61
    assert c.get(make) == 2


def test_insert_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "k int, v double")
    path = str(tmp_path / "t")
    assert archive.insert(d, path, ["k"]) == (2, 1)
    assert archive.insert(d, path, ["k"]) == (0, 3)
    assert archive.insert(d.limit(0), path, ["k"]) == (0, 0)


def test_loads_are_compared_with_their_own_dates(spark, tmp_path):
    rows = [(1, T0 + timedelta(days=k % 3, seconds=k), float(k)) for k in range(9)]
    d = spark.createDataFrame(rows, "sensor_id int, reading_ts timestamp_ntz, value double").withColumn("day", F.to_date("reading_ts"))
    path, keys = str(tmp_path / "t"), ["sensor_id", "reading_ts"]
    assert archive.insert(d.where("day < '2021-01-03'"), path, keys, ["sensor_id", "day"], "day") == (6, 0)
    assert archive.insert(d, path, keys, ["sensor_id", "day"], "day") == (3, 6)
    twice = d.withColumn("value", F.col("value") + 100).unionByName(d)
    other = str(tmp_path / "u")
    archive.insert(twice, other, keys, ["day"], "day")
    assert {r["value"] for r in spark.read.parquet(other).collect()} == {float(k) for k in range(9)}  # of one key the least


def test_csv_source(spark, tmp_path):
    f = tmp_path / "scan.csv"
    f.write_text(",timestamp,TP2,X\n0,2021-01-01 00:00:00,1.5,9\n10,bad,2.5,9\n20,2021-01-01 00:00:20,,9\n")
    raw = archive.read_scans(spark, str(f), ["TP2"])
    assert [r["payload"] for r in raw.orderBy("source_line_no").collect()] == ["0,2021-01-01 00:00:00,1.5,9", "10,bad,2.5,9", "20,2021-01-01 00:00:20,,9"]
    d = raw.orderBy("source_line_no").collect()
    assert [(r["source_line_no"], r["source_index"], r["timestamp"], r["TP2"]) for r in d] == [(2, 0, "2021-01-01 00:00:00", 1.5), (3, 10, "bad", 2.5), (4, 20, "2021-01-01 00:00:20", None)]
    assert archive.file_identity(spark, str(f))[1] == f.stat().st_size
    with pytest.raises(ValueError):
        archive.read_scans(spark, str(f), ["NOPE"])


def test_lines_follow_the_file_over_splits(spark, tmp_path):
    import hashlib

    f = tmp_path / "big.csv"
    f.write_text(",timestamp,A\n" + "".join(f"{'' if k % 7 == 0 else 5000 - k},2021-01-01 00:00:00,{k}.0\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = archive.read_scans(spark, str(f), ["A"])
        assert spark.read.csv(str(f)).rdd.getNumPartitions() > 1
        assert [(r["source_line_no"], r["A"]) for r in d.orderBy("source_line_no").collect()] == [(k + 2, float(k)) for k in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert archive.file_identity(spark, str(f)) == (hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size)


def test_ledger(spark, tmp_path):
    p = str(tmp_path / "ledger")
    archive.ledger_event(spark, p, 1, "a.csv", "s1", "RUNNING", T0)
    archive.ledger_event(spark, p, 1, "a.csv", "s1", "SUCCEEDED", T0 + timedelta(minutes=5), 10, 9, 1)
    archive.ledger_event(spark, p, 2, "b.csv", "s2", "RUNNING", T0 + timedelta(hours=1))
    runs = archive.ledger(spark.read.parquet(p))
    assert {r["run_id"]: r["status"] for r in runs.collect()} == {1: "SUCCEEDED", 2: "RUNNING"}
    assert archive.completed_run(runs, "s1").first()["run_id"] == 1 and archive.completed_run(runs, "s2").isEmpty()
    assert archive.last_run(runs).first()["run_id"] == 1
    checks = dict(serve.health_checks({"readings": runs}, runs, ["readings", "anomaly"], T0 + timedelta(days=3)))
    assert checks["table anomaly"] == "MISSING" and checks["stuck runs"] == "1 STUCK" and checks["baselines"] == "NONE"


def test_dates_limit_keeps_unparsed(spark):
    d = spark.createDataFrame([(T0,), (None,), (T0 + timedelta(days=3),)], "scan_ts timestamp_ntz")
    first, cut = archive.first_days(d, 2)
    assert first.count() == 2 and cut


def test_merge_and_replace(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in archive.merged(a, b, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_parts_are_replaced(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda name, *ks: spark.createDataFrame([(name, k) for k in ks], "name string, k int")
    archive.replace_part(p, "name", "a/b", rows("a/b", 1, 2))
    archive.replace_part(p, "name", "c", rows("c", 3))
    archive.replace_part(p, "name", "a/b", rows("a/b", 4))
    assert {(r["name"], r["k"]) for r in spark.read.parquet(p).collect()} == {("a/b", 4), ("c", 3)}
    archive.replace_part(p, "name", "c", rows("c"))
    assert {(r["name"], r["k"]) for r in spark.read.parquet(p).collect()} == {("a/b", 4)}


def test_built_tables_follow_their_source(spark, tmp_path):
    import os

    source = str(tmp_path / "src")
    n = lambda: archive.built(spark, source, "n", lambda: spark.read.parquet(f"{source}/events.parquet").groupBy().count()).first()[0]
    spark.range(3).write.parquet(f"{source}/events.parquet")
    assert n() == n() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{source}/events.parquet")
    os.utime(f"{source}/events.parquet", (2e9, 2e9))
    assert n() == 5
    archive.forget(spark)
    assert n() == 5


def test_carried_values(spark):
    rng = random.Random(9)
    rows = [(k % 2, k, rng.choice([None, None, 1.0, 2.0, 3.0])) for k in range(200)]
    d = spark.createDataFrame(rows, "g int, k int, v double").withColumn("b", F.floor(F.col("k") / 11))
    got = {r["k"]: r["v"] for r in ordered.filled(d, ["g"], "b", ["k"], ("v",)).collect()}
    last = {}
    for g, k, v in rows:
        last[g] = v if v is not None else last.get(g)
        assert got[k] == last[g]


def test_long_runs_cross_blocks(spark):
    flags = [1, 1, 0] + [1] * 40 + [0, 1]
    d = spark.createDataFrame([(k, bool(f)) for k, f in enumerate(flags)], "k int, f boolean").withColumn("b", F.floor(F.col("k") / 6))
    got = [r["run_length"] for r in ordered.runs(d, [], "b", ["k"], F.col("f")).orderBy("k").collect()]
    assert got == [2, 2, 0] + [40] * 40 + [0, 1]


def test_as_of_both_ways(spark):
    rng = random.Random(4)
    points = sorted(rng.sample(range(0, 40_000), 60))
    ask = sorted(rng.sample(range(-500, 41_000), 200)) + points[:5]
    at = lambda s: T0 + timedelta(seconds=s)
    p = spark.createDataFrame([(1, at(s), float(s)) for s in points], "sensor_id int, reading_ts timestamp_ntz, value double")
    r = spark.createDataFrame([(1, at(s)) for s in ask], "sensor_id int, at timestamp_ntz")
    for x in ordered.bracketed(p, r, "sensor_id", "at", "reading_ts", "value").collect():
        s = int((x["at"] - T0).total_seconds())
        assert x["prev_value"] == max((float(q) for q in points if q <= s), default=None)
        assert x["next_value"] == min((float(q) for q in points if q > s), default=None)


def test_pieces_bound_a_group(spark):
    r = readings(spark, [(10 * k, math.sin(k / 5), 192) for k in range(500)])
    dev = spark.createDataFrame([(1, 0.05)], "sensor_id int, deviation double")
    whole, cut = compress.compress(r, dev), compress.compress(r, dev, cut_rows=100)
    assert compress.segments(r, cut_rows=100).groupBy("segment", "piece").count().agg(F.max("count")).first()[0] == 100
    assert whole.count() <= cut.count() <= whole.count() + 10
    assert compress.compression_stats(r, cut, dev).first()["within_bound"]
    s = {x["pct"]: x for x in compress.sweep(r, (1.0, 10.0), cut_rows=100).collect()}
    assert s[1.0]["kept_count"] > s[10.0]["kept_count"] and not s[1.0]["violations"] and 0.5 < s[10.0]["worst_budget_used"] <= 1


def test_series_and_pages_know_what_is_left(spark):
    r = readings(spark, [(10 * k, k, 192) for k in range(10)])
    q = spark.createDataFrame(C.QUALITY, "quality_code_id int, code string, family string, is_usable boolean")
    for limit, more in ((9, True), (10, False), (11, False)):
        s = serve.raw_series(r, q, 1, None, None, limit)
        assert s.rows.count() == min(limit, 10) and s.truncated == more
    d = spark.createDataFrame([(1, T0, "M", "WARNING", st, 1.0) for st in ("A", "B", "C")], "sensor_id int, reading_ts timestamp_ntz, method string, severity string, operating_state string, score double")
    pages = [serve.anomaly_page(d, 1, k, severity="WARNING") for k in range(3)]
    assert [p.rows.first()["operating_state"] for p in pages] == ["A", "B", "C"] and pages[0].total.first()["total"] == 3
    with pytest.raises(ValueError):
        serve.summary(2, points=r)


def test_overview_and_age(spark):
    sf = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    from tidemark.plans import base
    from tidemark.sources import adapters

    r = base.narrow(spark, sf)
    o = serve.overview(adapters.equipment(spark), adapters.sensors(spark), r, adapters.quality_codes(spark), base.anomalies(spark, sf), adapters.failures(spark), views.sensor_quality(r), 1)
    assert o["counts"] == [{"equipment_count": 1, "sensor_count": 5}] and len(o["latest_readings"]) == 5 and len(o["active_anomalies"]) <= 50 and len(o["recent_failures"]) == 4
    runs = spark.createDataFrame([(1, "SUCCEEDED", T0)], "run_id long, status string, started_utc timestamp_ntz")
    newest = o["archive"][0]["last_ts"]
    age = lambda hours: dict(serve.health_checks({"readings": r}, runs, [], newest + timedelta(hours=hours), max_age_hours=24))["newest reading"]
    assert age(3) == "OK" and age(30) == "30.0 HOURS OLD"


def test_frozen_blocks_and_extremes(spark):
    s = spark.createDataFrame([(T0 + timedelta(hours=k), float(v)) for k, v in enumerate([1, 2, 2, 2, 3, 3])], "scan_ts timestamp_ntz, a double")
    assert [r["frozen_scans"] for r in profile.frozen_blocks(s, ["a"]).collect()] == [2, 1]
    r = profile.longest_constant(s, ["a"]).first()
    assert (r["run"], r["value"]) == (3, 2.0)
    daily = spark.createDataFrame([(1, T0.date(), 1.0, 9.0, 3), (1, (T0 + timedelta(days=1)).date(), 1.0, 9.0, 4)], "sensor_id int, bucket_date date, min_value double, max_value double, sample_count long")
    sensors = spark.createDataFrame([(1, "A", True)], "sensor_id int, sensor_code string, is_active boolean")
    x = views.extremes(daily, sensors).first()
    assert x["min_value_date"] == x["max_value_date"] == T0.date() and x["total_samples"] == 7


def test_usable_gate(spark):
    f = spark.createDataFrame([(1, "F", T0 + timedelta(hours=24), T0 + timedelta(hours=30))], "failure_event_id int, source_reference string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    base = spark.createDataFrame([(5.0, 1.0)], "mean_value double, stddev_value double")
    for held, verdict in ((50, "COMPARABLE"), (51, "INSUFFICIENT DATA")):
        r = readings(spark, [(86400 - 1 - k, 7, 65 if k < held else 192) for k in range(100)])
        x = analysis.failure_correlation(r, f, base).where("hours = 24").first()
        assert x["verdict"] == verdict and (x["z_vs_baseline"] == 2.0) == (verdict == "COMPARABLE")


def test_doors_over_batches(spark):
    """Pieces cut anywhere by Arrow batches, under several settings, against each piece alone."""
    rng = np.random.default_rng(12)
    t0, rows, now = datetime(2024, 1, 1), [], 0
    for _ in range(900):
        now += int(rng.choice([10, 10, 10, 10, 10, 500]))
        rows.append((1 + now % 2, t0 + timedelta(seconds=now), float(np.round(rng.normal(0, 1) + (now // 700) % 5, 3)), int(rng.choice([192, 192, 192, 192, 65]))))
    r = spark.createDataFrame(rows, "sensor_id int, reading_ts timestamp_ntz, value double, quality_code_id int")
    dev = spark.createDataFrame([(s, e, n) for s in (1, 2) for e, n in ((0.0, "none"), (0.4, "some"), (2.5, None))], "sensor_id int, deviation double, setting string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for size in (3, 7, 100_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            found.append(sorted((x["sensor_id"], str(x["setting"]), x["reading_ts"]) for x in compress.compress(r, dev, 60, cut_rows=40).collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    pieces = {}
    for x in compress.segments(r, 60, 40).collect():
        pieces.setdefault((x["sensor_id"], x["segment"], x["piece"]), []).append((x["reading_ts"], x["value"]))
    for (s, _, _), p in pieces.items():
        p.sort()
        t = np.array([(a - p[0][0]).total_seconds() for a, _ in p])
        for e, n in ((0.0, "none"), (0.4, "some"), (2.5, "None")):
            want += [(s, n, p[k][0]) for k in compress.door(t, np.array([v for _, v in p]), e)]
    assert found[0] == found[1] == found[2] == sorted(want) and len(pieces) > 100


def test_long_corridors_are_followed_alike(monkeypatch):
    """Point by point or as arrays, the door keeps the same."""
    rng = np.random.default_rng(3)
    for k in range(30):
        n = int(rng.integers(3, 900))
        t, v = np.cumsum(rng.integers(0, 20, n)).astype(float), np.round(np.cumsum(rng.normal(0, 0.1, n)), 3)
        e = float(rng.choice([0.05, 0.5, 5.0]))
        kept = []
        for near in (1, 5, 48, 10_000):
            monkeypatch.setattr(compress, "_NEAR", near)
            kept.append(list(compress.door(t, v, e)))
        assert kept.count(kept[0]) == 4


def test_keyset_pages_joined_are_the_whole(spark, tmp_path):
    """Nulls, ties and both directions; each page by the last key of the one before."""
    import random

    from tidemark.operators import serve

    rng = random.Random(8)
    rows = list({(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(6)]), rng.choice([None, "x", "y", "z"])): None for _ in range(300)})
    d = spark.createDataFrame(rows, "a int, b long, c string").repartition(3)
    for name, order in (("one", (("a", False), ("b", True), ("c", False))), ("two", (("b", True), ("a", True), ("c", True)))):
        stored = serve.stored_in_order(d, order, str(tmp_path / name))
        whole, pages, after = [tuple(r) for r in d.orderBy(*serve._keys(order)).collect()], [], None
        while page := serve.keyset_page(stored, order, 17, after).collect():
            pages += [tuple(r) for r in page]
            after = serve.cursor_of(page, order)
        assert pages == whole and len(whole) > 50 and serve.cursor_of([], order) is None
    plan = serve.keyset_page(stored, order, 5, {"b": 3, "a": 1, "c": "x"})._jdf.queryExecution().toString()
    assert "LessThanOrEqual(b,3)" in plan and "TakeOrdered" in plan
