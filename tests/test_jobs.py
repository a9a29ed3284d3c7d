from datetime import datetime, timedelta

import pytest

from tidemark import jobs
from tidemark.operators import report

T0 = datetime(2021, 1, 1)
ANALOGUE = tuple(f"a{k}" for k in range(1, 8))
DIGITAL = tuple(f"d{k}" for k in range(1, 9))
SIGNALS = [(k + 1, c, -1.0, 16.0, False) for k, c in enumerate(ANALOGUE)] + [(k + 8, c, 0.0, 1.0, True) for k, c in enumerate(DIGITAL)]


def write(path, lines):
    body = [",timestamp," + ",".join(ANALOGUE + DIGITAL)]
    for k, (t, v, over) in enumerate(lines):
        stamp = t if isinstance(t, str) else (T0 + timedelta(seconds=t)).strftime("%Y-%m-%d %H:%M:%S")
        body.append(",".join([str(10 * k), stamp, *(str(over.get(c, v)) for c in ANALOGUE), *(str(over.get(c, 1.0)) for c in DIGITAL)]))
    path.write_text("\n".join(body) + "\n")


@pytest.fixture
def hostile(tmp_path):
    lines = [(0, 5.0, {}), (10, 5.1, {}), (20, 5.2, {}), ("not-a-timestamp", 5.3, {}), (30, 5.4, {}), (30, 5.5, {}), (25, 5.6, {}), (40, 5.7, {"a1": 999, "d1": 0.5}), (7200, 7.0, {})]
    lines += [(7200 + 10 * k, 7.0, {}) for k in range(1, 7)] + [(7270, 8.0, {})]
    f = tmp_path / "hostile.csv"
    write(f, lines)
    return str(f)


def test_hostile_file_end_to_end(spark, hostile, tmp_path):
    folder = str(tmp_path / "archive")
    r = jobs.run_ingestion(spark, hostile, folder, SIGNALS, ANALOGUE, now=T0)
    assert (r.status, r.rows_read, r.rows_rejected, r.inserted, r.skipped, r.shortfall) == ("SUCCEEDED", 16, 3, 195, 0, 0)
    assert r.issues["FLATLINE", None] == 6 and r.issues["OUT_OF_RANGE", 1] == 1 and r.issues["NON_BINARY_DIGITAL", 8] == 1 and r.issues["UNPARSEABLE_TIMESTAMP", None] == 1
    stored = spark.read.parquet(folder + "/readings")
    assert stored.where("quality_code_id = 65").count() == 90 and stored.where("sensor_id = 1 and value = 999").first()["quality_code_id"] == 8
    assert jobs.run_ingestion(spark, hostile, folder, SIGNALS, ANALOGUE, now=T0 + timedelta(hours=1)).status == "SKIPPED"
    again = jobs.run_ingestion(spark, hostile, folder, SIGNALS, ANALOGUE, force=True, now=T0 + timedelta(hours=2))
    assert (again.inserted, again.skipped, again.shortfall) == (0, 195, 0)
    out = jobs.run_analytics(spark, folder, 1, 8, [1, 2, 3], ("2021-01-01 00:00:00", "2021-01-02 00:00:00"), min_samples=2)
    assert out["scans"] == 13
    assert jobs.run_compression(spark, folder, [1, 2, 3]) and spark.read.parquet(folder + "/compressed").count() <= 39


def test_a_load_that_raises_is_closed(spark, hostile, tmp_path):
    from tidemark.sources import archive

    folder = str(tmp_path / "archive")
    with pytest.raises(ValueError):
        jobs.run_ingestion(spark, hostile, folder, [*SIGNALS, (99, "nowhere", 0.0, 1.0, False)], ANALOGUE, now=T0)
    assert [r["status"] for r in archive.ledger(spark.read.parquet(folder + "/ledger")).collect()] == ["FAILED"]


def test_quarantine_keeps_the_line(spark, tmp_path):
    f = tmp_path / "odd.csv"
    write(f, [(0, 1.0, {}), ("never", 1.5, {"a1": "n/a"})])
    folder = str(tmp_path / "archive")
    jobs.run_ingestion(spark, str(f), folder, SIGNALS, ANALOGUE, now=T0)
    assert spark.read.parquet(folder + "/rejected").first()["payload"] == "10,never,n/a" + ",1.5" * 6 + ",1.0" * 8


def test_baselines_of_other_names_stay(spark, hostile, tmp_path):
    folder = str(tmp_path / "archive")
    jobs.run_ingestion(spark, hostile, folder, SIGNALS, ANALOGUE, now=T0)
    window = ("2021-01-01 00:00:00", "2021-01-02 00:00:00")
    for name in ("REFERENCE", "2020", "REFERENCE"):
        jobs.run_analytics(spark, folder, 1, 8, [1, 2, 3], window, name=name, min_samples=2, pressure_id=2)
    base = spark.read.parquet(folder + "/baseline")
    assert {str(r[0]): r[1] for r in base.groupBy("baseline_name").count().collect()} == {"2020": base.count() // 2, "REFERENCE": base.count() // 2} and base.count()
    assert spark.read.parquet(folder + "/anomaly").where("method = 'SETPOINT'").count() == 1


def test_issue_details_are_stored(spark, hostile, tmp_path):
    from tidemark.operators import views
    from tidemark.sources import archive

    folder = str(tmp_path / "archive")
    jobs.run_ingestion(spark, hostile, folder, SIGNALS, ANALOGUE, pair=("a1", "a2"), now=T0)
    stored = spark.read.parquet(folder + "/issues")
    at = lambda s: T0 + timedelta(seconds=s)
    got = {(r["run_id"], r["issue_type"], r["severity"], r["window_start"], r["window_end"], r["affected_rows"], r["observed_value"]) for r in stored.where("not is_summary").collect()}
    assert got == {
        (1, "GAP", "INFO", at(40), at(7200), 715, 7160.0),
        (1, "FLATLINE", "WARNING", at(7200), at(7260), 6, None),
        (1, "XSENSOR_DIVERGENCE", "WARNING", at(40), at(40), 1, 999 - 5.7),
    }
    assert stored.where("is_summary and issue_type = 'GAP'").first()["details"] == "Run total: 1 occurrence(s) of GAP for all sensors."
    runs = archive.ledger(spark.read.parquet(folder + "/ledger"))
    assert [tuple(r) for r in views.timestamp_gaps(stored, runs).collect()] == [(1, at(40), at(7200), 7160.0, 7160.0 / 3600, 715)]


def test_many_details_are_capped_in_words(spark, tmp_path):
    lines = [(100 * k, float(k % 7), {}) for k in range(1003)]
    write(tmp_path / "gaps.csv", lines)
    folder = str(tmp_path / "archive")
    jobs.run_ingestion(spark, str(tmp_path / "gaps.csv"), folder, SIGNALS, ANALOGUE, now=T0)
    stored = spark.read.parquet(folder + "/issues").where("issue_type = 'GAP'")
    kept = [r["window_start"] for r in stored.where("not is_summary").orderBy("window_start").collect()]
    assert kept == [T0 + timedelta(seconds=100 * k) for k in range(1000)]
    rest = {(r["run_id"], r["severity"], r["affected_rows"], r["details"]) for r in stored.where("is_summary").collect()}
    assert rest == {(1, "INFO", 1002, "Run total: 1,002 occurrence(s) of GAP for all sensors."), (1, "INFO", 0, "Per-event detail for GAP was capped at 1,000 rows. The summary row above carries the exact total.")}


def test_empty_and_partial(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    folder = str(tmp_path / "archive")
    assert jobs.run_ingestion(spark, str(empty), folder, SIGNALS, ANALOGUE, now=T0).status == "FAILED"
    days = tmp_path / "days.csv"
    write(days, [(0, 1.0, {}), ("bad", 1.1, {}), (86400 * 3, 1.2, {})])
    r = jobs.run_ingestion(spark, str(days), folder, SIGNALS, ANALOGUE, limit_days=1, now=T0)
    assert (r.status, r.rows_read, r.rows_rejected, r.inserted) == ("PARTIAL", 2, 1, 15)


def test_reports(spark):
    d = spark.createDataFrame([(1, None), (2, "a|b")], "k int, v string")
    assert report.markdown(d).splitlines()[2:] == ["| 1 |  |", "| 2 | a\\|b |"]
    assert report.json_lines(d).first()[0] == '{"k":1}'
    with pytest.raises(ValueError):
        report.markdown(d, 1)
    assert report.latencies([float(x) for x in range(1, 21)]) == {"min": 1.0, "median": 10.5, "p95": 19.0, "max": 20.0}


def test_summaries_by_wording(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import summary_by_wording

    d = spark.createDataFrame([("Run total: 5",), ("detail was capped at 1,000 rows",), ("a gap",), (None,)], "t string")
    assert [r[0] for r in d.select(summary_by_wording(F.col("t"))).collect()] == [True, True, False, False]


def test_a_folder_of_files_and_quoted_lines(spark, tmp_path):
    """Files follow each other by name, no two lines share a number, and a payload is its line."""
    from tidemark.sources import archive

    head = ',timestamp,"a 1",note'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text(head + '\n7,2021-01-02 00:00:00,"3.5","late, quoted ""x"""\n')
    (tmp_path / "in" / "a.csv").write_text(head + '\n0,2021-01-01 00:00:00,1.5,plain\n\n1,"2021-01-01 00:00:10",,\nx,,oops,\n')
    got = sorted((r["source_line_no"], r["source_index"], r["timestamp"], r["a 1"], r["payload"]) for r in archive.read_scans(spark, str(tmp_path / "in"), ["a 1"]).collect())
    assert got == [
        (2, 0, "2021-01-01 00:00:00", 1.5, "0,2021-01-01 00:00:00,1.5,plain"),
        (3, 1, "2021-01-01 00:00:10", None, '1,"2021-01-01 00:00:10",,'),
        (4, None, None, None, "x,,oops,"),
        (6, 7, "2021-01-02 00:00:00", 3.5, '7,2021-01-02 00:00:00,"3.5","late, quoted ""x"""'),
    ]
    assert archive.read_scans(spark, str(tmp_path / "in" / "b.csv"), ["a 1"]).first()["source_line_no"] == 2
    sha, size = archive.file_identity(spark, str(tmp_path / "in"))
    assert size == sum(archive.file_identity(spark, str(tmp_path / "in" / f))[1] for f in ("a.csv", "b.csv")) and len(sha) == 64
    (tmp_path / "in" / "c.csv").write_text("timestamp,a 1,note,\n2021-01-02 00:00:00,1,2,3\n")
    assert archive.file_identity(spark, str(tmp_path / "in"))[0] != sha
    with pytest.raises(Exception, match="another header"):
        archive.read_scans(spark, str(tmp_path / "in"), ["a 1"]).collect()


def test_lines_of_many_splits(spark, tmp_path):
    from tidemark.sources import archive

    f = tmp_path / "long.csv"
    f.write_text(",timestamp,a\n" + "".join(f"{k},2021-01-01 00:00:00,{k}.0\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = archive.read_scans(spark, str(f), ["a"])
        got = {r["source_line_no"]: r["a"] for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k + 2: float(k) for k in range(5000)}
