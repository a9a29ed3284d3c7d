import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import rollup
from tidemark.streaming import LateRows, freezes, load_stream, rollup_stream, validated_stream
from tidemark.streaming.load import stream_ledger


def test_state_crosses_micro_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("m", t0 + timedelta(seconds=10 * k), 5.0) for k in range(8)] + [("m", t0, 6.0), ("m", t0 + timedelta(seconds=500), 7.0)]
    schema = "machine string, ts timestamp, a double"
    for k in range(0, 10, 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = validated_stream(source, "machine", "ts", ["a"]).writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("checked").collect()
    assert len(got) == 10
    assert sum(r["is_stale"] for r in got) == 7  # all but the first of eight equal scans, as in the batch
    assert [r["reject"] for r in got if r["reject"]] == ["NON_MONOTONIC_TIMESTAMP"]
    assert [r["gap_seconds"] for r in got if r["gap_seconds"] is not None] == [430.0]


def test_lines_are_judged_in_order(spark, tmp_path):
    """Rows written out of order over several files of one trigger, against the batch validator."""
    from tidemark.operators import validate

    t0 = datetime(2024, 1, 1)
    steps = [0, 10, 20, 20, 15, 30, 40, 50, 60, 70, 80, 75, 200]
    rows = [("m", k + 2, t0 + timedelta(seconds=s), float(k > 11)) for k, s in enumerate(steps)] + [("m", 99, None, 1.0)]
    schema = "machine string, line long, ts timestamp, a double"
    d = spark.createDataFrame(rows, schema)
    d.orderBy("a", "ts").repartition(5).write.parquet(str(tmp_path / "in"))
    q = validated_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "machine", "ts", ["a"], line="line").writeStream.format("memory").queryName("by_line").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["line"]: (r["reject"], r["gap_seconds"]) for r in spark.table("by_line").collect()}
    batch = validate.checked_order(d.selectExpr("line as source_line_no", "line as source_index", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "a"))
    want = {r["source_line_no"]: (r["reject"], float(r["delta"]) if r["reject"] is None and (r["delta"] or 0) > 30 else None) for r in batch.collect()}
    assert got == want and sum(x is not None for x, _ in got.values()) == 4


# --- hold-back --------------------------------------------------------------------


def scans_of(rng, n):
    """Lines with freezes of many lengths, repeated and early times, unreadable ones."""
    t0, now, value, rows = datetime(2024, 1, 1), 0, 0.0, []
    while len(rows) < n:
        value += 1
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 9, 14])):
            now += rng.choice([10, 10, 10, 10, 200])
            odd = rng.random()
            at = None if odd < 0.05 else t0 + timedelta(seconds=now if odd > 0.15 else now - 10 * rng.choice([1, 2, 3]))
            rows.append(("m", len(rows) + 2, at, value, None if rng.random() < 0.03 else 2 * value))
    return rows[:n]


SCANS = "machine string, line long, ts timestamp, a double, b double"


def run_cut(spark, tmp_path, rows, cuts, name, **options):
    """The stream over files of rows[cut:next cut], a file a trigger."""
    import time

    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        spark.createDataFrame(rows[a:z], SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)  # files are taken by age
    source = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return validated_stream(source, "machine", "ts", ["a", "b"], line="line", **options), name


def batch_flags(spark, rows):
    from tidemark.operators import validate

    d = spark.createDataFrame(rows, SCANS).selectExpr("line as source_line_no", "line as source_index", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "a", "b")
    o = validate.checked_order(d)
    held = {r["source_line_no"]: r["is_stale"] for r in validate.frozen(o, ("a", "b")).collect()}
    return {r["source_line_no"]: (r["reject"], held.get(r["source_line_no"], False)) for r in o.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_held_back_scans_are_those_of_the_batch(spark, tmp_path, seed):
    """Any cut into micro-batches gives every scan the flag of the batch validator, but for
    the scans that still wait, and those are the last ones of an unfinished freeze."""
    rng = random.Random(seed)
    rows = scans_of(rng, 80)
    cuts = sorted({0, len(rows), *rng.sample(range(1, len(rows)), 6)})
    d, name = run_cut(spark, tmp_path, rows, cuts, f"held{seed}")
    q = d.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    out = [(r["line"], (r["reject"], r["is_stale"])) for r in spark.table(name).collect()]
    got, want = dict(out), batch_flags(spark, rows)
    assert len(got) == len(out)  # each line once
    waiting = sorted(want.keys() - got.keys())
    assert all(got[k] == want[k] for k in got)
    assert len(waiting) <= 4 and all(want[k] == (None, False) for k in waiting)
    accepted = [k for k in sorted(want) if want[k][0] is None]
    assert waiting == accepted[len(accepted) - len(waiting) :]
    assert any(stale for _, stale in want.values()) and any(r for r, _ in want.values())


def test_a_timer_lets_waiting_scans_go(spark, tmp_path):
    import time

    t0 = datetime(2024, 1, 1)
    rows = [("m", k + 2, t0 + timedelta(seconds=10 * k), 5.0, 5.0) for k in range(4)]
    d, name = run_cut(spark, tmp_path, rows, [0, 4], "timer", flush_after=2)
    q = d.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 60
    while time.time() < until and spark.table(name).count() < 4:
        time.sleep(0.5)
    q.stop()
    assert sorted((r["line"], r["is_stale"]) for r in spark.table(name).collect()) == [(k + 2, False) for k in range(4)]


def test_freezes_in_parts():
    """The decision on runs, cut anywhere, against the whole."""
    rng = random.Random(5)
    for _ in range(300):
        same = [False] + [rng.random() < 0.75 for _ in range(rng.randint(0, 25))]
        want, k = [], 0
        while k < len(same):
            z = k
            while z < len(same) and same[z]:
                z += 1
            want += [z - k >= 5] * (z - k) if z > k else [False]
            k = max(z, k + 1)
        got, waiting, length, at = {}, [], 0, 0
        while at < len(same):
            z = min(len(same), at + rng.randint(1, 6))
            held, wait, before, length = freezes(np.array(same[at:z]), length, 5)
            if before is not None:
                got |= {w: before for w in waiting}
                waiting = []
            got |= {at + j: bool(held[j]) for j in range(z - at) if not wait[j]}
            waiting += [at + j for j in range(z - at) if wait[j]]
            at = z
        assert got | {w: False for w in waiting} == dict(enumerate(want))


# --- rollups by event time --------------------------------------------------------

READINGS = "sensor_id int, reading_ts timestamp, value double, quality_code_id int"


def test_stream_rollup_equals_the_batch_without_late_rows(spark, tmp_path):
    import time

    rng, t0, batches = random.Random(3), datetime(2024, 1, 1), []
    for k in range(8):
        rows = [(rng.choice([1, 2]), t0 + timedelta(seconds=60 * 45 * k + rng.randrange(-2 * 3600 - 1800, 2700)), float(rng.randrange(100)), rng.choice([192, 65, 8])) for _ in range(40)]
        batches.append(rows + rows[:3])  # some arrive twice
    batches.append([(1, t0 + timedelta(days=3), 1.0, 192)])  # closes every bucket
    lateness, newest, on_time, late, seen = timedelta(hours=1), datetime(1970, 1, 1), [], 0, set()
    marks = [newest, newest]  # rows are late by the watermark that the micro-batch before worked with
    for rows in batches:
        for r in rows:
            if r[1] <= marks[-2]:
                late += 1
            elif (r[0], r[1]) not in seen:
                seen.add((r[0], r[1]))
                on_time.append(r)
        newest = max([newest, *(r[1] for r in rows)])
        marks.append(max(marks[-1], newest - lateness))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    counter = LateRows()
    spark.streams.addListener(counter)
    try:
        source = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = rollup_stream(source, "hour", "1 hour").writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        until = time.time() + 20
        while counter.late.get("hourly", 0) < late and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counter)
    assert late > 10 and counter.late["hourly"] == late
    key = lambda r: (r["sensor_id"], r["bucket_start"])
    tidy = lambda r: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()}
    want = {key(r): tidy(r) for r in rollup.rollup(spark.createDataFrame(on_time[:-1], READINGS)).collect()}
    got = {key(r): tidy(r) for r in spark.table("hourly").collect()}
    assert got == want and len(got) > 10


def test_days_of_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 23)
    rows = [(1, t0 + timedelta(minutes=20 * k), float(k), 192) for k in range(9)] + [(1, t0 + timedelta(days=5), 0.0, 192)]
    spark.createDataFrame(rows, READINGS).write.parquet(str(tmp_path / "in"))
    q = rollup_stream(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")), "day").writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["bucket_date"]), r["sample_count"], r["first_value"], r["last_value"]) for r in spark.table("daily").collect())
    assert got == [("2024-01-01", 3, 0.0, 2.0), ("2024-01-02", 6, 3.0, 8.0)]


# --- loads ------------------------------------------------------------------------

SIGNALS = [(1, "a", 0.0, 1e9, False), (2, "b", 0.0, 1e9, False)]


@pytest.mark.parametrize("where", ["insert", "melted", "replace_part"])
def test_a_killed_load_stores_each_key_once(spark, tmp_path, monkeypatch, where):
    """Dies before, inside or after the insert of a batch, goes on from the checkpoint, and
    equals the load of the whole file."""
    from tidemark.operators import validate
    from tidemark.sources import archive

    rows = scans_of(random.Random(11), 60) + [("m", 99, datetime(2024, 2, 1), 1e6, 1e6)]
    cuts = [0, 20, 41, 61]
    folder = str(tmp_path / "archive")
    d, name = run_cut(spark, tmp_path, rows, cuts, f"load_{where}")
    start = lambda: load_stream(d, folder, SIGNALS, str(tmp_path / "c"), name).start()
    module, calls = (validate, []) if where == "melted" else (archive, [])
    plain = getattr(module, where)

    def dies(*args, **kw):
        calls.append(1)
        if where == "insert" and len(calls) == 2:  # stored, but the batch never hears of it
            plain(*args, **kw)
        if len(calls) == {"insert": 2, "melted": 2, "replace_part": 8}[where]:
            raise RuntimeError("killed")
        return plain(*args, **kw)

    with monkeypatch.context() as m:
        m.setattr(module, where, dies)
        q = start()
        with pytest.raises(Exception, match="killed"):
            q.processAllAvailable()
    q = start()
    q.processAllAvailable()
    q.stop()
    stored = spark.read.parquet(f"{folder}/readings")
    got = sorted((r["sensor_id"], r["reading_ts"], r["value"], r["quality_code_id"]) for r in stored.collect())
    d = spark.createDataFrame(rows, SCANS).selectExpr("line as source_line_no", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "a", "b")
    want = validate.melted(validate.frozen(validate.checked_order(d), ("a", "b")), SIGNALS)
    assert got == sorted((r["sensor_id"], r["reading_ts"], r["value"], r["quality_code_id"]) for r in want.collect())
    assert len({(r[0], r[1]) for r in got}) == len(got)
    rejects = spark.read.parquet(f"{folder}/stream_rejected").collect()
    assert len(rejects) == sum(r is not None for r, _ in batch_flags(spark, rows).values())
    ledger = {r["batch_id"]: r for r in stream_ledger(spark, folder).collect()}
    assert sorted(ledger) == [0, 1, 2] and {r["status"] for r in ledger.values()} == {"SUCCEEDED"}
    assert sum(r["rows_read"] for r in ledger.values()) == len(rows)
    assert not list((tmp_path / "archive" / "work").glob("*"))  # nothing is left behind
