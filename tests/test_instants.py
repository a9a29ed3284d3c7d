"""Readings that share a millisecond: compression and its archive against their SQL."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import plans

STEPS = (1, 1, 7, 300, 900, 40_000, 5_000_000, 900_000_000, 4_000_000_000)  # microseconds


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    rng, at, stamps = random.Random(1), datetime(2024, 1, 1), []
    for _ in range(2_000):
        at += timedelta(microseconds=rng.choice(STEPS))
        stamps.append(at)
    n, d = len(stamps), tmp_path_factory.mktemp("dense")
    cells = {
        "event_id": pa.array(range(n), pa.int64()),
        "ts": pa.array(stamps, pa.timestamp("us")),
        "user_id": pa.array([1] * n, pa.int64()),
        "event_type": [rng.choice(("click", "error", "purchase", "view", "signup")) for _ in range(n)],
        "value": [round(rng.expovariate(1 / 50), 2) for _ in range(n)],
        "props": ["{}"] * n,
    }
    pq.write_table(pa.table(cells), d / "events.parquet")
    return str(d)


def plain(columns, rows):
    """Rows as sorted tuples, by column name; NaN as text, as it equals nothing."""
    at = [columns.index(c) for c in sorted(columns)]
    tidy = lambda x: ("nan" if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x
    return sorted((tuple(tidy(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same_as_sql(spark, folder, name):
    c = duckdb.connect(config={"memory_limit": "3GB", "threads": 4})
    c.execute(f"CREATE VIEW events AS FROM read_parquet('{folder}/events.parquet')")
    want = c.execute(plans.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = plans.queries()[name](spark, folder)
    assert plain(got.columns, got.collect()) == plain(columns, want.fetchall())


@pytest.mark.parametrize("name", ["compress_sdt", "compress_sweep", "compress_sweep_sensors", "compression_summary"])
def test_doors_of_one_instant(spark, dense, name):
    same_as_sql(spark, dense, name)


def test_value_between_points_of_one_instant(spark, dense):
    same_as_sql(spark, dense, "value_at_compressed")
