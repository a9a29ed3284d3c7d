import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles as Q

PROBS = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.95, 1.0)


def groups(rng):
    """Groups of many shapes: ties, two values, outliers, one row, nulls, no group."""
    rows = [("flat", 7.0)] * 300 + [("two", float(k % 2)) for k in range(501)] + [("one", 3.5), ("pair", 1.0), ("pair", 2.0), ("none", None)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    rows += [("heavy", 5.0 if rng.random() < 0.9 else rng.gauss(0, 1)) for _ in range(900)]
    rows += [(None, rng.random()) for _ in range(400)] + [("holes", rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    rows += [("zero", rng.choice([0.0, -0.0, 1e-300])) for _ in range(50)] + [("edge", rng.choice([float("inf"), 1.0, 2.0])) for _ in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [3, 2048])
def test_selection_equals_percentile(spark, few):
    d = spark.createDataFrame(groups(random.Random(few)), "g string, v double").repartition(5)
    want = {r["g"]: (r["n"], r["q"]) for r in d.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    got = {r["g"]: (r["n"], r["q"]) for r in Q.exact_quantiles(d, ["g"], "v", PROBS, few).collect()}
    assert got.keys() == want.keys() and "none" not in got
    for g, (n, q) in want.items():
        assert got[g][0] == n
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[g][1], q)), (g, got[g], q)


def test_selection_by_several_columns_and_of_nothing(spark):
    rng = random.Random(9)
    d = spark.createDataFrame([(rng.randint(0, 2), rng.choice(["x", None]), rng.randint(0, 99)) for _ in range(900)], "a int, b string, v int")
    want = {(r["a"], r["b"]): r["q"] for r in d.groupBy("a", "b").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    assert {(r["a"], r["b"]): r["q"] for r in Q.exact_quantiles(d, ["a", "b"], "v", (0.5, 0.9), 10).collect()} == want
    assert Q.exact_quantiles(d.where("false"), ["a"], "v", (0.5,)).count() == 0
    assert Q.exact_quantiles(d, [], "v", (0.5,), 10).first()["q"] == [sorted(d.toPandas()["v"])[449] / 2 + sorted(d.toPandas()["v"])[450] / 2]


def test_nothing_is_left_behind(spark, tmp_path):
    from pathlib import Path

    from tidemark.sources.archive import shared_dir

    base = Path(shared_dir(spark).removeprefix("file://"))
    before = set(base.iterdir())
    d = spark.createDataFrame([(1, float(k)) for k in range(500)], "g int, v double")
    Q.exact_quantiles(d, ["g"], "v", (0.5,), 5).collect()
    assert [p.name.split("-")[1] for p in set(base.iterdir()) - before] == ["found"]


def test_sketches_merge_within_their_bound(spark):
    """Any cut of the rows into sketches, against exact ranks."""
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 30), rng.gauss(0, 1) if g else float(rng.randint(0, 9))) for g in (0, 1) for _ in range(20_000)]
    d = spark.createDataFrame(rows, "g int, part int, v double")
    parts = d.groupBy("g", "part").agg(Q.sketch("v").alias("sketch"))
    found = Q.merged_quantiles(parts, ["g"], PROBS)
    assert {r["g"]: r["n"] for r in found.collect()} == {0: 20_000, 1: 20_000}
    errors = Q.rank_errors(d, ["g"], "v", found, PROBS).collect()
    assert len(errors) == 2 * len(PROBS) and max(r["error"] for r in errors) < 0.01
    wrong = found.withColumn("q", F.transform("q", lambda x: x + 5))
    assert max(r["error"] for r in Q.rank_errors(d, ["g"], "v", wrong, PROBS).collect()) > 0.1
