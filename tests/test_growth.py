"""What large archives are read and moved for: once where once is enough."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analysis, ordered, quantiles, rollup, validate

T0 = datetime(2024, 1, 1)
SIGNALS = [(1, "p", 0.0, 300.0, False), (4, "s", 0.0, 300.0, True), (5, "i", 0.0, 300.0, False)]
BANDS = (15.0, 35.0, 70.0)


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scans(spark):
    rng = random.Random(3)
    cell = lambda: rng.choice([None, float("nan"), 400.0, 12.0, 20.0, 50.0, 90.0])
    rows = [(T0 + timedelta(minutes=7 * k), cell(), rng.choice([None, 0.0, 1.0, 0.5]), cell(), rng.random() < 0.2) for k in range(800)]
    return spark.createDataFrame(rows, "scan_ts timestamp_ntz, p double, s double, i double, is_stale boolean").localCheckpoint()


def test_readings_bring_their_states(scans):
    narrow = validate.melted(scans, SIGNALS)
    states = analysis.scan_states(narrow, 5, 4, BANDS)
    own = analysis.stated(scans, SIGNALS, 5, BANDS)
    want = narrow.join(states.select("reading_ts", "operating_state", "is_stale"), "reading_ts").select(*own.columns)
    assert own.count() == want.count() > 0 and own.exceptAll(want).isEmpty()
    window = "2024-01-01 00:00:00", "2024-01-03 00:00:00", "B", 5
    for a, b in (
        (rollup.state_rollup(own, None, [1, 5]), rollup.state_rollup(narrow, states, [1, 5])),
        (analysis.baselines(own, None, *window), analysis.baselines(narrow, states, *window)),
    ):
        assert "Join" not in plan(a)
        key = lambda r: str(r[:3])
        got, expected = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
        assert len(got) == len(expected) > 0
        assert all(x == pytest.approx(y, rel=1e-12) if isinstance(x, float) else x == y for r, s in zip(got, expected) for x, y in zip(r, s))


def test_selection_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    d = spark.range(3_000).withColumn("v", F.udf(count, "double")(F.col("id").cast("double")))
    r = quantiles.exact_quantiles(d.select(F.lit(1).alias("g"), "v"), ["g"], "v", (0.25, 0.5), few=10).first()
    # twice in one pass: for the filter of nulls and for the column
    assert r["q"] == [749.75, 1499.5] and made.value <= 2 * 3_000


@pytest.mark.parametrize("spans", [False, True])
def test_runs_over_blocks_stay_where_they_are(spark, spans):
    rng, rows = random.Random(8), []
    for s in ("a", "b"):
        flags = [f for _ in range(60) for f in [rng.random() < 0.5] * rng.choice([1, 2, 5, 30])]
        start = 0
        for k in range(len(flags) + 1):
            if k == len(flags) or not flags[k]:
                rows += [(s, j, k // 7 if j == k else j // 7, flags[j], k - start) for j in range(start, k)]
                if k < len(flags):
                    rows.append((s, k, k // 7, False, 0))
                start = k + 1
    d = spark.createDataFrame(rows, "s string, n int, b int, f boolean, want int").localCheckpoint()
    got = ordered.runs(d, ["s"], "b", ["n"], F.col("f"), spans=spans)
    assert got.where("run_length <> want").count() == 0 and got.count() == len(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved = plan(ordered.runs(d.withColumn("more", F.lit("x")), ["s"], "b", ["n"], F.col("f"), spans=spans))
        assert "hashpartitioning(s, b, island" not in moved.replace("#", " #").replace(" #", "#").translate(str.maketrans("", "", "#0123456789"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hourly_detector_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(s, st, T0 + timedelta(hours=2 * k), rng.gauss(0, 1) if rng.random() < 0.8 else rng.gauss(0, 30)) for s in (1, 2) for st in ("OFF", "LOADED") for k in range(150)]
    d = spark.createDataFrame(rows, "sensor_id int, operating_state string, bucket_start timestamp_ntz, avg_value double")
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        series = [r for r in rows if (r[0], r[1]) == key]
        for k, r in enumerate(series):
            h = [x[3] for x in series[max(0, k - 12) : k]]
            if len(h) >= 6 and (mad := median([abs(x - median(h)) for x in h])) > 0 and abs(0.6745 * (r[3] - median(h)) / mad) >= 3.5:
                want.add((*key, r[2]))
    monkeypatch.setattr(analysis, "HOURS_PER_BLOCK", 10)
    monkeypatch.setattr(analysis, "HOURS_PER_PIECE", 20)
    found = analysis.detect_mad(d, 12, 6, 1)
    assert {(r["sensor_id"], r["operating_state"], r["reading_ts"]) for r in found.collect()} == want and want
    assert "collect_list" not in plan(found)
