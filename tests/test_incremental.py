import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import incremental, rollup
from tidemark.sources import archive

SCHEMA = "sensor_id int, reading_ts timestamp_ntz, value double, quality_code_id int"


def readings(rng, n, days=5, offset=1e6):
    """Readings some seconds apart, over days with nights off and steps over midnight."""
    rows, t0 = {}, datetime(2024, 3, 1)
    while len(rows) < n:
        at = t0 + timedelta(days=rng.randrange(days), seconds=rng.choice([rng.randrange(86400), rng.randrange(86380, 86400), rng.randrange(20)]))
        rows[(rng.choice([1, 2]), at)] = (offset + rng.gauss(0, 1), rng.choice([192, 65, 8]))
    return [(s, t, v, q) for (s, t), (v, q) in rows.items()]


def tidy(d, key):
    return {(r["sensor_id"], r[key]): {c: round(v, 6) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in d.collect()}


def load(spark, folder, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("reading_date", F.to_date("reading_ts"))
    incremental.note_touched(d, folder, "load")
    return archive.insert(d, f"{folder}/readings", ["sensor_id", "reading_ts"], ["sensor_id", "reading_date"], "reading_date")


@pytest.mark.parametrize("seed", range(2))
def test_refreshed_rollups_equal_a_rebuild(spark, tmp_path, seed):
    """Loads in any order, some of them twice, a refresh after each or after several."""
    rng, folder = random.Random(seed), str(tmp_path)
    rows = readings(rng, 240)
    rng.shuffle(rows)
    loads = [rows[:90], rows[90:100], rows[60:150], rows[150:240]]
    for k, part in enumerate(loads):
        load(spark, folder, part)
        if k == 1:
            continue
        jobs.refresh_rollups(spark, folder)
        every = spark.read.parquet(f"{folder}/readings")
        assert tidy(spark.read.parquet(f"{folder}/hourly"), "bucket_start") == tidy(rollup.rollup(every, "hour", time_weighted=True), "bucket_start")
    assert jobs.refresh_rollups(spark, folder) == 0
    days = tidy(spark.read.parquet(f"{folder}/daily"), "bucket_date")
    assert days == tidy(rollup.rollup(every, "day", time_weighted=True), "bucket_date") and len(days) == 10


def test_only_touched_dates_are_rebuilt(spark, tmp_path):
    folder = str(tmp_path)
    load(spark, folder, readings(random.Random(1), 200))
    assert jobs.refresh_rollups(spark, folder) == 5
    files = lambda: {p.parent.name: p.name for p in tmp_path.glob("hourly_partials/reading_date=*/*.parquet")}
    before = files()
    load(spark, folder, [(1, datetime(2024, 3, 4, 12, 0, 1), 5.0, 192)])
    assert incremental.refresh(spark, folder) == [date(2024, 3, 4)]
    assert {d for d, name in files().items() if before[d] != name} == {"reading_date=2024-03-03", "reading_date=2024-03-04"}


def test_a_refresh_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    load(spark, folder, readings(random.Random(2), 100))
    with monkeypatch.context() as m:
        m.setattr(incremental, "rebuild_dates", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            incremental.refresh(spark, folder)
    assert len(incremental.refresh(spark, folder)) == 5 and incremental.refresh(spark, folder) == []


def test_moments_merge_without_cancellation(spark):
    """Values far from zero, whose squares drown their spread."""
    rng = random.Random(3)
    d = spark.createDataFrame(readings(rng, 300, 3, offset=1e9), SCHEMA)
    parts = incremental.partials(d)
    got = incremental.as_rollup(incremental.merged(parts, ["sensor_id"], F.lit(1), "k"), "sensor_id", "sample_count").collect()
    want = {r["sensor_id"]: r for r in d.groupBy("sensor_id").agg(F.stddev_samp("value").alias("s"), F.avg("value").alias("m"), F.max_by("value", "reading_ts").alias("z"), F.count(F.lit(1)).alias("n")).collect()}
    for r in got:
        w = want[r["sensor_id"]]
        assert abs(r["stddev_value"] - w["s"]) < 1e-4 and abs(r["avg_value"] - w["m"]) < 1e-5 and r["last_value"] == w["z"] and r["sample_count"] == w["n"]
    one = incremental.as_rollup(incremental.partials(d.limit(1)), "sensor_id").first()
    assert one["stddev_value"] is None and one["first_value"] == one["last_value"]


def test_a_stored_load_is_noted(spark, tmp_path):
    """run_ingestion says which dates it touched, and refresh_rollups follows."""
    csv, folder = tmp_path / "scans.csv", str(tmp_path / "archive")
    t0 = datetime(2024, 3, 1, 23, 59, 0)
    csv.write_text(",timestamp,a\n" + "".join(f"{k},{t0 + timedelta(seconds=10 * k)},{k}.5\n" for k in range(20)))
    jobs.run_ingestion(spark, str(csv), folder, [(1, "a", 0.0, 100.0, False)], ("a",))
    assert jobs.refresh_rollups(spark, folder) == 2
    hourly = tidy(spark.read.parquet(f"{folder}/hourly"), "bucket_start")
    assert hourly == tidy(rollup.rollup(spark.read.parquet(f"{folder}/readings"), "hour", time_weighted=True), "bucket_start")
    assert sorted(r["sample_count"] for r in hourly.values()) == [6, 14]
