"""Quantiles of groups of any size: exact by selection, and by sketches that merge.

``F.percentile`` keeps a table of a group's distinct values in one task.  Here a group is
never in one place: ranks are located by counting.  For every rank that is asked, a
bracket of values is known to hold it; a quantile sketch of the bracket proposes a
narrower one, exact counts say on which side of it, or in it, the rank lies, and only rows
inside a bracket are looked at again.  When a bracket holds few rows, or a single value,
they are collected and the rank is read off.  Both kinds of pass aggregate partially, so
what is shuffled is a row for each task and group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.archive import Workspace, fresh_path, shared_dir

FEW = 2048  # rows of a bracket that may be collected
GRID = 64  # cells in which a bracket's sketch is read
ACCURACY = 2000


def _same(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by], F.lit(True))


def _with(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the state of their group, which has a row for each."""
    return rows.alias("r").join(state.alias("s"), _same(by, "r", "s")).select(*[f"r.{c}" for c in by], "r._v", "s._b")


def _inside(k: int) -> Column:
    return (F.col("_v") >= F.col("_b")[k]["lo"]) & (F.col("_v") <= F.col("_b")[k]["hi"])


def _open(b: Column, few: int) -> Column:
    return (b["n"] > few) & (b["lo"] < b["hi"])


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str], targets: int, few: int, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One round: every open bracket cut at two values of its sketch, or at one where those
    are its ends, and replaced by the part that holds the rank."""
    grid = [k / GRID for k in range(GRID + 1)]
    d = _with(rows, state, by)
    looked = d.groupBy(*by).agg(*[F.percentile_approx(F.when(_inside(k) & _open(F.col("_b")[k], few), F.col("_v")), grid, ACCURACY).alias(f"c{k}") for k in range(targets)])
    d = state.alias("r").join(looked.alias("s"), _same(by, "r", "s"), "left")

    def cut(k: int) -> Column:
        b, c = F.col("r._b")[k], F.col(f"s.c{k}")
        cell = F.floor(GRID * (b["rank"] - b["below"]) / b["n"])
        at = lambda j: F.get(c, F.greatest(F.least(j, F.lit(GRID)), F.lit(0)).cast("int"))
        low, high = at(cell - 1), at(cell + 2)
        stuck = (low <= b["lo"]) & (high >= b["hi"])
        return F.struct(*[b[x].alias(x) for x in ("rank", "lo", "hi", "below", "n")], F.when(stuck, at(cell)).otherwise(low).alias("cl"), F.when(stuck, at(cell)).otherwise(high).alias("ch"))

    state = table(d.select(*[f"r.{c}" for c in by], F.array(*[cut(k) for k in range(targets)]).alias("_b")))
    d = _with(rows, state, by)
    aggs = []
    for k in range(targets):
        b, v = F.col("_b")[k], F.col("_v")
        below, held, above = _inside(k) & (v < b["cl"]), _inside(k) & (v >= b["cl"]) & (v <= b["ch"]), _inside(k) & (v > b["ch"])
        aggs.append(F.struct(F.count_if(below).alias("under"), F.count_if(held).alias("held"), F.max(F.when(below, v)).alias("last"), F.min(F.when(above, v)).alias("first")).alias(f"n{k}"))
    d = state.alias("r").join(d.groupBy(*by).agg(*aggs).alias("s"), _same(by, "r", "s"), "left")

    def part(k: int) -> Column:
        b, n = F.col("r._b")[k], F.col(f"s.n{k}")
        make = lambda lo, hi, below, rows: F.struct(b["rank"].alias("rank"), lo.alias("lo"), hi.alias("hi"), below.alias("below"), rows.alias("n"))
        under, upto = b["below"] + n["under"], b["below"] + n["under"] + n["held"]
        now = make(b["lo"], b["hi"], b["below"], b["n"])
        return F.when(b["cl"].isNull(), now).when(b["rank"] < under, make(b["lo"], n["last"], b["below"], n["under"])).when(b["rank"] < upto, make(b["cl"], b["ch"], under, n["held"])).otherwise(make(n["first"], b["hi"], upto, b["n"] - n["under"] - n["held"]))

    return table(d.select(*[f"r.{c}" for c in by], F.array(*[part(k) for k in range(targets)]).alias("_b")))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probs: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(by, n, q): for each group the number of values and the quantiles ``probs`` as
    ``F.percentile`` gives them, linear between neighbouring ranks.

    Nulls count for nothing, a group of nulls has no row; null is a group of its own; NaN is
    the greatest value.  A task holds at most ``few`` rows of a rank at a time, whatever the
    size of the groups.  The result is a stored table; what was stored on the way is gone.
    """
    spark = rows.sparkSession
    base = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    targets = 2 * len(probs)
    with Workspace(spark, "quantiles") as w:
        at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
        ranks = [r for x in at for r in (F.floor(x), F.least(F.floor(x) + 1, F.col("_n") - 1))]
        base = w.table(base)  # every pass reads them, and what they are made of may be joins
        n = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        start = F.array(*[F.struct(r.cast("long").alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("_n").alias("n")) for r in ranks])
        groups = w.table(n.select(*by, "_n", start.alias("_b")))
        state, left = groups.select(*by, "_b"), base
        while not state.where(F.exists("_b", lambda b: _open(b, few))).isEmpty():
            state = _narrowed(left, state, by, targets, few, w.table)
            # from here on only rows of some bracket matter
            left = w.table(_with(left, state, by).where(reduce(lambda a, b: a | b, [_inside(k) & (F.col("_b")[k]["lo"] < F.col("_b")[k]["hi"]) for k in range(targets)])).select(*by, "_v"))
        # brackets of one value are known without their rows
        wanted = [_inside(k) & (F.col("_b")[k]["lo"] < F.col("_b")[k]["hi"]) for k in range(targets)]
        found = _with(left, state, by).groupBy(*by).agg(*[F.sort_array(F.collect_list(F.when(c, F.col("_v")))).alias(f"v{k}") for k, c in enumerate(wanted)])
        d = state.alias("r").join(found.alias("s"), _same(by, "r", "s"), "left").join(groups.alias("g"), _same(by, "r", "g"))
        value_at = lambda k: F.when(F.col("r._b")[k]["lo"] < F.col("r._b")[k]["hi"], F.get(F.col(f"s.v{k}"), (F.col("r._b")[k]["rank"] - F.col("r._b")[k]["below"]).cast("int"))).otherwise(F.col("r._b")[k]["lo"])
        q = []
        for k, p in enumerate(probs):
            x = F.lit(float(p)) * (F.col("g._n") - 1)
            part = x - F.floor(x)
            low, high = value_at(2 * k), value_at(2 * k + 1)
            q.append(F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high))
        out = fresh_path(shared_dir(spark), "quantiles-found")
        d.select(*[f"r.{c}" for c in by], F.col("g._n").alias("n"), F.array(*q).alias("q")).write.parquet(out)
    return spark.read.parquet(out)


# --- sketches ---------------------------------------------------------------------

SKETCH = 400  # k of the sketches: a rank is off by less than 1 % of the rows, with 99 % confidence


def sketch(value: str, k: int = SKETCH) -> Column:
    """Aggregate: a sketch of the values (KLL), of some kilobytes whatever their number."""
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))


def merged_quantiles(sketches: DataFrame, by: list[str], probs: tuple[float, ...], column: str = "sketch", k: int = SKETCH) -> DataFrame:
    """(by, n, q) of groups of stored sketches, without their readings: hours to days, days to
    any window."""
    d = sketches.groupBy(*by).agg(F.kll_merge_agg_double(column, F.lit(k)).alias("_s"))
    return d.select(*by, F.kll_sketch_get_n_double("_s").alias("n"), F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) for p in probs]).alias("q"))


def rank_errors(rows: DataFrame, by: list[str], value: str, found: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """(by, n, prob, error): how far the rank of each found quantile is from the one asked, as
    a share of the rows; 0 where ties cover it.  One pass of counts."""
    d = rows.where(F.col(value).isNotNull()).alias("r").join(found.alias("s"), _same(by, "r", "s"))
    v = F.col(f"r.{value}")
    counts = [F.array(F.count_if(v < F.col("s.q")[k]), F.count_if(v <= F.col("s.q")[k])) for k in range(len(probs))]
    d = d.groupBy(*[F.col(f"r.{c}").alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("c"))
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.greatest(F.col("c")[k][0] - p * F.col("n"), p * F.col("n") - F.col("c")[k][1], F.lit(0.0)).alias("off")) for k, p in enumerate(probs)]))
    return d.select(*by, "n", each.alias("e")).select(*by, "n", "e.prob", (F.col("e.off") / F.col("n")).alias("error"))
