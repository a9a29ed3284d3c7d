"""Importance resampling: documents whose words look like those of a target text.

Features are runs of 1 to ``NGRAM`` consecutive words, hashed into ``BUCKETS`` buckets.  A
bucket's gain is the log of its share among the target's features over its share among the
documents' features, both smoothed by one; a document's weight is the sum of the gains of
its features.  Weights with Gumbel noise drawn from a digest of the id rank the documents,
so that the head of that order is a sample without replacement in proportion to the
exponents of the weights.

Method: array-scored weights, then quantile-sketch bracketing.  Every partition adds its
features up in one array; the sums, ``BUCKETS`` numbers for the documents and as many for
the target, become the array of gains that every task scores with.  A sketch of the scores
brackets the cutoff; exact counts outside the bracket say whether it holds the cutoff, and
it is widened until it does.  Only the bracket is sorted to find where the sample ends;
what lies above it is ordered in ranges only to be numbered, and no text is shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG, numbered, ranged, small_batches, written

BUCKETS, NGRAM, SEED, RATE, LEAST = 10_000, 1, "2024", 10, 20
WIDTH = 0.005  # half the bracket's width, as a share of the documents
ACCURACY = 10_000  # of Spark's quantile sketch
_KNOWN = 1 << 18  # features whose gain a task remembers
#: words of a lower-cased text as UTF-8: digits, letters a-z and everything beyond ASCII
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def features(data: bytes, ngram: int = NGRAM) -> Iterator[list[bytes]]:
    """Features of a text, in lists for a part of about ``LONG`` bytes each."""
    at, carry = 0, []
    while at < len(data):
        stop = _BETWEEN.search(data, at + LONG)
        end = stop.start() if stop else len(data)
        words = _WORD.findall(data[at:end].lower())
        found = list(words)
        held = carry + words
        for n in range(2, ngram + 1):
            first = max(len(carry) - n + 1, 0)  # runs that end in this part
            found += [b" ".join(held[k : k + n]) for k in range(first, len(held) - n + 1)]
        carry = held[len(held) - ngram + 1 :] if ngram > 1 else []
        yield found
        at = end


def bucket_of(feature: bytes, buckets: int) -> int:
    return zlib.crc32(feature) % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column)


def bucket_counts(docs: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            seen: Counter = Counter()
            for text in _texts(b.column("text")):
                for part in features(text, ngram):
                    seen.update(part)
                    if len(seen) > _KNOWN:
                        _added(sums, seen, buckets)
                        seen = Counter()
            _added(sums, seen, buckets)
        full = np.flatnonzero(sums)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    text = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).where("text is not null")
    out = np.zeros(buckets, np.int64)
    for r in text.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _added(sums: np.ndarray, seen: Counter, buckets: int) -> None:
    if seen:
        at = np.fromiter((bucket_of(f, buckets) for f in seen), np.int64, len(seen))
        np.add.at(sums, at, np.fromiter(seen.values(), np.int64, len(seen)))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))."""
    b = len(source)
    whole, aimed = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * whole / ((s + 1.0) * aimed))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


class _Gains(dict):
    """Gains by feature, looked up in the array when a feature is first met."""

    def __init__(self, array: np.ndarray):
        super().__init__()
        self.array = array.tolist()

    def __missing__(self, feature: bytes) -> int:
        gain = self.array[bucket_of(feature, len(self.array))]
        if len(self) < _KNOWN:
            self[feature] = gain
        return gain


def weights(array: np.ndarray, ngram: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Gains(array)
        for column in batches:
            n, weight = [], []
            for text in _texts(column):
                parts = [(len(part), sum(map(table.__getitem__, part))) for part in features(text, ngram)]
                n.append(sum(p[0] for p in parts))
                weight.append(sum(p[1] for p in parts))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["n_features", "weight"])

    return run


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from a digest of seed and id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, array: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: str = SEED) -> DataFrame:
    """``docs`` with n_features, weight and score (long), which replace input columns of
    these names; other columns pass through.  A text without features weighs 0."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    w = F.arrow_udf(weights(array, ngram), "n_features long, weight long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select(row, w(text).alias("_w"), noise(F.col(f"`{id_col}`"), seed).alias("_g"))
    keep = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_features", "weight", "score")]
    return d.select(*keep, F.col("_w.n_features").alias("n_features"), F.col("_w.weight").alias("weight"), (F.col("_w.weight") + F.col("_g")).alias("score"))


def bracket(units: DataFrame, rate: float, width: float = WIDTH) -> tuple[int, int, float, float]:
    """(rows to draw, rows above the bracket, its lower and upper score).

    ``units`` has score and n (rows that the unit stands for).  The sketch only proposes:
    exact counts of what lies above and inside decide whether the cutoff is in there.
    """
    share = 1 - rate / 100.0
    while True:
        at = [max(share - width, 0.0), min(share + width, 1.0)]
        r = units.agg(F.sum("n").alias("n"), F.percentile_approx("score", at, ACCURACY).alias("q")).first()
        total = r["n"] or 0
        draw = math.floor(rate * total / 100)
        if not draw:
            return 0, 0, math.inf, math.inf
        low, high = (-math.inf, math.inf) if width >= 1 else r["q"]
        c = units.agg(F.sum(F.when(F.col("score") > high, F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(F.col("score") >= low, F.col("n")).otherwise(0)).alias("held")).first()
        if c["above"] < draw <= c["held"]:
            return draw, c["above"], low, high
        width *= 4


def ranks(docs: DataFrame, array: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: str = SEED, rate: float = RATE, least: int = LEAST, width: float = WIDTH) -> DataFrame:
    """(_id, _tie, n, n_features, weight, score, first): a row for every distinct id and
    text, ``n`` rows of the table with the places first to first + n - 1 in the sample;
    places beyond ``draw`` are not in it, and first is null where none is.

    Highest scores come first, ties by the smaller id (null first), then by the text.
    Documents of fewer than ``least`` words are scored but never drawn.
    """
    order = [F.desc("score"), F.asc("_id"), F.asc("_tie")]
    s = scored(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")), array, "_id", "_text", ngram, seed)
    words = F.col("n_features") if ngram == 1 else F.col("n_words")
    if ngram != 1:
        s = s.withColumn("n_words", F.coalesce(F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)))
    s = s.select("_id", F.xxhash64("_text").alias("_tie"), "n_features", "weight", "score", (words >= least).alias("fit"))
    s = written(s.groupBy("_id", "_tie", "n_features", "weight", "score", "fit").agg(F.count(F.lit(1)).alias("n")), "scores")
    fit = s.where("fit")
    draw, above, low, high = bracket(fit, rate, width)
    top, inside = F.col("score") > F.lit(high), (F.col("score") <= F.lit(high)) & (F.col("score") >= F.lit(low))
    cols = ["_id", "_tie", "n", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("first")
    if not draw:
        return s.select(*cols, none, F.lit(0).cast("long").alias("draw"))
    place = lambda d, name, more: numbered(ranged(d.select(*cols), name, *order), "_upto", "n", *order).withColumn("first", F.col("_upto") - F.col("n") + 1 + more)
    head, edge = place(fit.where(top), "head", 0), place(fit.where(inside), "bracket", above)
    out = head.select(*cols, "first").unionByName(edge.select(*cols, "first")).unionByName(s.where(~F.col("fit") | ~(top | inside)).select(*cols, none))
    return out.withColumn("first", F.when(F.col("first") <= draw, F.col("first"))).withColumn("draw", F.lit(draw).cast("long"))


def fitted(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The array of gains, from all texts of both tables."""
    return gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, seed: str = SEED, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that the sample takes, all columns with n_features, weight and
    score; texts are not shuffled, as a row's score alone says whether it lies above the
    cutoff, which is one score, id and text digest.

    Null texts have no features; repeated rows are taken together if their first is; ids
    may be of any type; an empty table, or an empty target, gives no row or a sample by
    the smoothed counts alone.
    """
    array = fitted(docs, target, text_col, target_col, ngram, buckets)
    r = ranks(docs, array, id_col, text_col, ngram, seed, rate, least)
    cut = r.where("first is not null").agg(F.max_by(F.struct("score", "_id", "_tie"), "first").alias("c")).first()["c"]
    d = scored(docs, array, id_col, text_col, ngram, seed)
    if cut is None:
        return d.where(F.lit(False))
    own, tie = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    level = F.col("score") == F.lit(cut["score"])
    last = F.lit(cut["_id"]).cast(d.schema[id_col].dataType)
    before = (own.isNull() & last.isNotNull()) | F.coalesce(own < last, F.lit(False)) | (own.eqNullSafe(last) & (tie <= F.lit(cut["_tie"])))
    words = F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return d.where(((F.col("score") > F.lit(cut["score"])) | (level & before)) & (F.coalesce(words, F.lit(0)) >= least))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = ranks(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")))
    at = F.col("first") + F.col("k")
    d = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return d.select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", F.when(at <= F.col("draw"), at).alias("rank"))


_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, text, {_LOWER} AS w FROM documents),
dw AS (SELECT w, count(*) AS s FROM (SELECT unnest(w) AS w FROM d) GROUP BY 1),
bw AS (SELECT w, count(*) AS t FROM (SELECT unnest({_LOWER}) AS w FROM benchmark) GROUP BY 1),
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(w))]), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 10000 AS b FROM h, crc),
n AS (SELECT b, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM k LEFT JOIN dw USING (w) LEFT JOIN bw USING (w) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM n),
x AS (SELECT r, sum(g)::BIGINT AS weight FROM (SELECT rowid AS r, unnest(w) AS w FROM (SELECT *, row_number() OVER () AS rowid FROM d)) JOIN k USING (w) JOIN g USING (b) GROUP BY 1),
y AS (SELECT doc_id, text, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS u FROM (SELECT *, row_number() OVER () AS r FROM d) LEFT JOIN x USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM o
"""
