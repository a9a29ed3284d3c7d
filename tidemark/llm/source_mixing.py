"""Mixing sources to target weights, with native functions only.

Sources in code point order (null last) weigh 3, 1, 2, repeating.  They share
``SHARE`` times all words by weight; a target stops at ``MOST`` times its source's
words, and the excess goes to the others by weight until none is above: with t the
common level, a target is min(MOST * words, t * weight).

Method: Pareto order sampling.  A source with target/words = c + f gives c certain
whole copies of every document, and a sample that holds f of its words.  Inclusion odds
are in proportion to a document's size: documents are ranked by random odds u/(1-u)
over their inclusion odds, and the sample is the head of that order that holds the
words wanted.  (The factor that would turn sizes into odds is the same for a whole
source and leaves the order as it is.)  Random numbers come from a digest of id and
text, so reruns agree.

A source may hold a third of all rows, so its order is not made in one task: places in
the order are cut into buckets of about ``BUCKET`` documents, words are added up by
bucket, and only the bucket in which the sample ends is ranked document by document.
There, documents that no longer fit are passed over while later ones fit, and one
last document is taken if that comes nearer to the target.  Outside that bucket a
document's copies follow from its own row and one row for its source.

Rows that repeat id, source and text are decided together.  Targets need all sources in
one order, a row of some fifty bytes for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, unboxed, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKET = 4096
FITS = 3
SEED = "mix-1"


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``by_source`` (source, words, ...) with target; a row per source, so small enough to sort at once."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = by_source.withColumn("weight", w).withColumn("cap", F.col("words") * F.lit(float(most)))
    rising = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("words").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    s = s.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("level", "cap")


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> dict[str, Column]:
    """What decides about a row: _id, _source, _key, size and u, all from the row itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(text.cast("binary"))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), key, F.lit(":" + seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return {"_id": F.col(id_col), "_source": F.col(source_col), "_key": key, "size": word_count(F.col(text_col)), "u": u}


def _placed(unit: DataFrame, sources: DataFrame) -> DataFrame:
    """``unit`` with its source's row, ``odds`` that rank it and the bucket ``b`` they fall in."""
    d = unit.join(sources, unit["_source"].eqNullSafe(sources["source"])).drop("source")
    d = d.withColumn("odds", F.col("u") / (1 - F.col("u")) / F.greatest("size", F.lit(1)))
    at = F.col("odds") * F.col("mean")
    return d.withColumn("b", F.floor(at / (1 + at) * F.col("buckets")))


def _decided(docs: DataFrame, id_col, source_col, text_col, weights, share, most, seed, bucket) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct units, one row per source, units of the edge buckets with ``more``)."""
    rows = docs.select(*[c.alias(k) for k, c in _units(docs, id_col, source_col, text_col, seed).items()])
    unit = rows.groupBy("_id", "_source", "_key", "size", "u").agg(F.count(F.lit(1)).alias("n"))
    unit = written(unit.withColumn("words", F.col("size") * F.col("n")), "mixing")
    sources = targets(unit.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("units")), weights, share, most)
    ratio = F.when(F.col("words") > 0, F.try_divide("target", F.col("words"))).otherwise(0.0)
    sources = sources.select("source", F.col("words").alias("source_size"), "target", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("f"), F.ceil(F.col("units") / bucket).alias("buckets"), (F.greatest("words", F.lit(1)) / F.col("units")).alias("mean"))
    sources = written(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    placed = _placed(unit, sources)
    sums = placed.groupBy("_source", "b").agg(F.sum("words").alias("w"), F.first("rest").alias("r"))
    upto = F.sum("w").over(Window.partitionBy("_source").orderBy("b"))
    sums = sums.withColumn("upto", upto).groupBy("_source").agg(F.min(F.when(F.col("upto") > F.col("r"), F.col("b"))).alias("edge"), F.max(F.when(F.col("upto") <= F.col("r"), F.struct("b", "upto"))).alias("full"))
    edges = sums.select(F.col("_source").alias("_s"), F.coalesce("edge", F.lit((1 << 62))).alias("edge"), F.coalesce("full.upto", F.lit(0)).alias("done"))
    # stored, so that Spark knows how small it is
    sources = written(sources.join(edges, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "sources")
    e = _placed(unit, sources).where("b = edge").withColumn("more", F.lit(False)).withColumn("left", F.col("rest") - F.col("done"))
    source, order = Window.partitionBy("_source"), Window.partitionBy("_source").orderBy("odds", "_id", "_key").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(FITS):
        e = e.withColumn("fits", ~F.col("more") & (F.col("words") <= F.col("left")))
        e = e.withColumn("now", F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("words")).otherwise(0)).over(order) <= F.col("left")))
        e = e.withColumn("left", F.col("left") - F.sum(F.when(F.col("now"), F.col("words")).otherwise(0)).over(source)).withColumn("more", F.col("more") | F.col("now"))
    near = Window.partitionBy("_source").orderBy(F.col("more"), F.abs(F.col("words") - F.col("left")), "odds", "_id", "_key")
    e = e.withColumn("more", F.col("more") | ((F.row_number().over(near) == 1) & (F.col("words") < 2 * F.col("left")) & (F.col("f") > 0)))
    return unit, sources, e


_AWAY = "b <> edge"
_MORE = "b < edge and f > 0"
_OUT = ("size", "source_size", "target", "copies", "taken")


def _copies(more: Column) -> Column:
    return (F.col("whole") + more.cast("long")).alias("copies")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """(_id, _source, _key, size, n, source_size, target, copies): one row per distinct
    id, source and text, with n rows each.

    Null and empty texts have size 0 and cost nothing; null is a source of its own.
    Very long texts count whole; ids may be of any type.
    """
    unit, sources, e = _decided(docs, id_col, source_col, text_col, weights, share, most, seed, bucket)
    cols = ["_id", "_source", "_key", "size", "n", "source_size", "target"]
    away = _placed(unit, sources).where(_AWAY).select(*cols, _copies(F.expr(_MORE)))
    return away.unionByName(e.select(*cols, _copies(F.col("more"))))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words, repeats
    counted); these replace input columns of their names, and other columns pass through
    under any name.  Null, empty and very long texts as in ``mixing_plan``; repeated rows
    get equal results; an empty table gives an empty one.

    Texts are not shuffled but for the documents of the edge buckets, which are joined
    with their decisions.
    """
    unit, sources, e = _decided(docs, id_col, source_col, text_col, weights, share, most, seed, bucket)
    d = _placed(boxed(docs, **_units(docs, id_col, source_col, text_col, seed)), sources)
    cols = ["_row", "size", "source_size", "target"]
    away = d.where(_AWAY).select(*cols, _copies(F.expr(_MORE)))
    e = written(e.select(F.col("_id").alias("_i"), F.col("_source").alias("_s"), F.col("_key").alias("_k"), "more"), "edges")
    on = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k"))
    out = away.unionByName(d.where("b = edge").join(e, on).select(*cols, _copies(F.col("more"))))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return unboxed(out, **{k: F.col(k) for k in _OUT})


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = mixing_plan(docs).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return plan.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS k FROM documents),
u AS (SELECT *, (('0x' || substr(md5(doc_id || ':' || k || ':mix-1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS words, count(*) AS units FROM u GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight, 2.0::DOUBLE * words AS cap FROM s),
l AS (SELECT *, (sum(words) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT *, least(cap, coalesce((SELECT min_by(lv, cap / weight) FROM l WHERE cap / weight >= lv) * weight, cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0 END AS ratio, ceil(units / 4096.0) AS buckets, greatest(words, 1)::DOUBLE / units AS mean FROM t),
j AS (SELECT doc_id, u.source, size, k, u, words AS source_size, target, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS f,
   u / (1 - u) / greatest(size, 1) AS odds, mean, buckets, target - floor(ratio) * words AS rest FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(odds * mean / (1 + odds * mean) * buckets) AS b FROM j),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY b) AS upto FROM p),
g AS (SELECT *, min(CASE WHEN upto > rest THEN b END) OVER (PARTITION BY source) AS edge,
   coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS done FROM o),
e0 AS (SELECT *, rest - done AS l0, false AS m0 FROM g WHERE b = edge),
e1 AS (SELECT *, NOT m0 AND size <= l0 AND sum(CASE WHEN NOT m0 AND size <= l0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS UNBOUNDED PRECEDING) <= l0 AS n1 FROM e0),
f1 AS (SELECT *, m0 OR n1 AS m1, l0 - sum(CASE WHEN n1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS l1 FROM e1),
e2 AS (SELECT *, NOT m1 AND size <= l1 AND sum(CASE WHEN NOT m1 AND size <= l1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS UNBOUNDED PRECEDING) <= l1 AS n2 FROM f1),
f2 AS (SELECT *, m1 OR n2 AS m2, l1 - sum(CASE WHEN n2 THEN size ELSE 0 END) OVER (PARTITION BY source) AS l2 FROM e2),
e3 AS (SELECT *, NOT m2 AND size <= l2 AND sum(CASE WHEN NOT m2 AND size <= l2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS UNBOUNDED PRECEDING) <= l2 AS n3 FROM f2),
f3 AS (SELECT *, m2 OR n3 AS m3, l2 - sum(CASE WHEN n3 THEN size ELSE 0 END) OVER (PARTITION BY source) AS l3 FROM e3),
x AS (SELECT *, m3 OR (row_number() OVER (PARTITION BY source ORDER BY m3, abs(size - l3), odds, doc_id) = 1 AND size < 2 * l3 AND f > 0) AS more FROM f3),
a AS (SELECT doc_id, size, source_size, target, whole, more FROM x UNION ALL
   SELECT doc_id, size, source_size, target, whole, (edge IS NULL OR b < edge) AND f > 0 FROM g WHERE edge IS NULL OR b <> edge)
SELECT doc_id, size, source_size, target, (whole + more::BIGINT) * size AS taken FROM a
"""
