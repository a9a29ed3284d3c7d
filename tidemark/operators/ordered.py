"""Window functions over long ordered series without one task per series.

``lag``, ``lead`` and running values over a whole series would put a series, or a
whole file, in one task.  Here a series is cut into blocks (hours, ranges of line
numbers) that keep its order: the window runs inside each block, and one row per block
carries what crosses its edge.

Hours grow with the time that an archive covers, some 9,000 a year, so their edges are
ordered as a whole.  Blocks of lines grow with the rows; ``spans=True`` carries their
edges in two levels, ordered inside spans of ``1 << SPAN_BITS`` blocks and then by one
row per span, so that no task sees all edges.  Blocks are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import block_of

SPAN_BITS = 10


def _span(block: str) -> Column:
    return F.shiftright(F.col(block).cast("long"), SPAN_BITS).alias("_span")


def _folded(keys: list[str], place: str, folds: dict[str, str]) -> dict[str, Column]:
    def over(c: str, how: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(F.desc(place) if how == "next" else F.asc(place)).rowsBetween(Window.unboundedPreceding, -1)
        return {"sum": F.sum, "max": F.max}.get(how, lambda c: F.last(c, ignorenulls=True))(c).over(w)

    return {c: over(c, how) for c, how in folds.items()}


def carried(edges: DataFrame, by: list[str], block: str, folds: dict[str, str], spans: bool = False) -> DataFrame:
    """(by, block) with each column of ``folds`` folded over all other blocks on its side:
    ``last`` known value, ``sum`` or ``max`` of the blocks before, ``next`` known value after.

    ``edges`` has one row per block.  With ``spans`` both levels read the same exchange.
    """
    if not spans:
        return edges.select(*by, block, *[f.alias(c) for c, f in _folded(by, block, folds).items()])
    e = edges.withColumn("_span", _span(block)).repartition(*by, "_span")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(block))
    whole = {"last": lambda c: F.max_by(c, known(c)), "next": lambda c: F.min_by(c, known(c)), "sum": F.sum, "max": F.max}
    far = e.groupBy(*by, "_span").agg(*[whole[how](c).alias(c) for c, how in folds.items()])
    far = far.select(*by, "_span", *[f.alias(f"_far_{c}") for c, f in _folded(by, "_span", folds).items()])
    near = e.select(*by, block, "_span", *[f.alias(c) for c, f in _folded([*by, "_span"], block, folds).items()])

    def both(c: str, how: str) -> Column:
        a, b = F.col(c), F.col(f"_far_{c}")
        if how == "max":
            return F.greatest(a, b)
        return F.coalesce(a + b, a, b) if how == "sum" else F.coalesce(a, b)

    return near.join(far, [*by, "_span"], "left").select(*by, block, *[both(c, how).alias(c) for c, how in folds.items()])


def _neighbour(df: DataFrame, by: list[str], block: str, order: list[str], cols: dict[str, str], forward: bool, spans: bool) -> DataFrame:
    inside = Window.partitionBy(*by, block).orderBy(*order)
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    edge = df.groupBy(*by, block).agg(pick(F.struct(*cols.values()), F.struct(*order)).alias("_edge"))
    carry = carried(edge, by, block, {"_edge": "next" if forward else "last"}, spans).withColumnRenamed("_edge", "_carry")
    at_edge = step(F.lit(True)).over(inside).isNull()
    out = df.join(carry, [*by, block], "left")
    for new, old in cols.items():
        out = out.withColumn(new, F.when(at_edge, F.col(f"_carry.{old}")).otherwise(step(old).over(inside)))
    return out.drop("_carry")


def lagged(df: DataFrame, by: list[str], block: str, order: list[str], cols: dict[str, str], spans: bool = False) -> DataFrame:
    """Columns {new: old} of the row before, in (by), ordered by ``order``."""
    return _neighbour(df, by, block, order, cols, False, spans)


def leading(df: DataFrame, by: list[str], block: str, order: list[str], cols: dict[str, str], spans: bool = False) -> DataFrame:
    """Columns {new: old} of the row after."""
    return _neighbour(df, by, block, order, cols, True, spans)


def running(df: DataFrame, by: list[str], block: str, order: list[str], new: str, value: Column, how: str = "sum", before: bool = False, spans: bool = False) -> DataFrame:
    """Running sum or max of ``value`` up to each row, or up to the row before it."""
    f = {"sum": F.sum, "max": F.max}[how]
    d = df.withColumn("_v", value)
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    carry = carried(d.groupBy(*by, block).agg(f("_v").alias("_carry")), by, block, {"_carry": how}, spans)
    d = d.join(carry, [*by, block], "left").withColumn("_in", f("_v").over(inside))
    both = F.greatest("_carry", "_in") if how == "max" else F.coalesce("_carry", F.lit(0)) + F.coalesce("_in", F.lit(0))
    return d.withColumn(new, both).drop("_v", "_in", "_carry")


def filled(df: DataFrame, by: list[str], block: str, order: list[str], cols: tuple[str, ...], spans: bool = False) -> DataFrame:
    """Each of ``cols`` with its last value carried forward over nulls."""
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    edge = df.groupBy(*by, block).agg(*[newest(c).alias(f"_c_{c}") for c in cols])
    carry = carried(edge, by, block, {f"_c_{c}": "last" for c in cols}, spans)
    d = df.join(carry, [*by, block], "left")
    return d.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in cols}).drop(*[f"_c_{c}" for c in cols])


def runs(df: DataFrame, by: list[str], block: str, order: list[str], flag: Column, island: str = "island", size: str = "run_length", spans: bool = False) -> DataFrame:
    """Number maximal runs of rows with ``flag`` and give each flagged row its run's
    length (0 elsewhere).  A run starts a new island after each unflagged row."""
    d = running(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), by, block, order, island, F.when(F.col("_flag"), 0).otherwise(1).cast("long"), spans=spans)
    d = d.withColumn("_part", F.count_if("_flag").over(Window.partitionBy(*by, block, island)))
    # only the first and last island of a block go on in others: two rows of each block tell the rest
    ends = d.groupBy(*by, block).agg(F.array_distinct(F.array(*[f(F.struct(island, "_part")) for f in (F.min, F.max)])).alias("_ends"))
    sizes = ends.select(*by, block, *[_span(block)][: int(spans)], F.inline("_ends"))
    if spans:  # and a run's total meets its blocks by span
        total = sizes.groupBy(*by, island, "_span").agg(F.sum("_part").alias("_part"))
        total = total.select(*by, island, "_span", F.sum("_part").over(Window.partitionBy(*by, island)).alias(size))
        sizes = sizes.drop("_part").join(total, [*by, island, "_span"]).drop("_span")
    else:
        sizes = sizes.select(*by, island, block, F.sum("_part").over(Window.partitionBy(*by, island)).alias(size))
    ends = sizes.groupBy(*by, block).agg(*[f(F.struct(island, size)).alias(n) for f, n in ((F.min, "_first"), (F.max, "_last"))])
    # by block alone, as the windows, so that the rows stay where they are
    d = d.join(ends, [*by, block], "left")
    whole = F.when(F.col(island) == F.col(f"_first.{island}"), F.col(f"_first.{size}")).when(F.col(island) == F.col(f"_last.{island}"), F.col(f"_last.{size}")).otherwise(F.col("_part"))
    return d.withColumn(size, F.when(F.col("_flag"), whole).otherwise(0)).drop("_flag", "_part", "_first", "_last")


def bracketed(points: DataFrame, requests: DataFrame, key: str, at: str, time: str, value: str) -> DataFrame:
    """As-of join both ways: each request with the last point at or before it
    (prev_ts, prev_value) and the first one after it (next_ts, next_value).

    Points and requests are merged in time order; the last point before a block comes
    in over its edge, so no series has to fit in one task.  Both directions look back
    over a growing frame, ahead of a request in descending order, so the cost stays
    in proportion to the rows.
    """
    p = points.select(key, F.col(time).alias("_t"), F.struct(F.col(time).alias("ts"), F.col(value).alias("value")).alias("_p"), F.lit(None).cast("struct<x:int>").alias("_r"), F.lit(0).alias("_k"))
    r = requests.withColumn("_req", F.struct(*[F.col(c) for c in requests.columns])).select(key, F.col(at).alias("_t"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col("_req").alias("_r"), F.lit(1).alias("_k"))
    both = p.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r).withColumn("_b", block_of(F.col("_t")))
    inside = Window.partitionBy(key, "_b").rowsBetween(Window.unboundedPreceding, 0)
    back = F.last("_p", ignorenulls=True).over(inside.orderBy("_t", "_k"))
    ahead = F.last("_p", ignorenulls=True).over(inside.orderBy(F.desc("_t"), F.desc("_k")))  # a request holds no point
    edge = both.where("_k = 0").groupBy(key, "_b").agg(F.max_by("_p", "_t").alias("z"), F.min_by("_p", "_t").alias("a"))
    blocks = both.select(key, "_b").distinct().join(edge, [key, "_b"], "left")
    carry = carried(blocks, [key], "_b", {"z": "last", "a": "next"}).withColumnsRenamed({"z": "_before", "a": "_after"})
    d = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_k = 1").join(carry, [key, "_b"], "left")
    d = d.withColumn("_back", F.coalesce("_back", "_before")).withColumn("_ahead", F.coalesce("_ahead", "_after"))
    return d.select("_r.*", F.col("_back.ts").alias("prev_ts"), F.col("_back.value").alias("prev_value"), F.col("_ahead.ts").alias("next_ts"), F.col("_ahead.value").alias("next_value"))
