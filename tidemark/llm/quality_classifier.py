"""Quality scores from document statistics.

Method: random Fourier features approximate a Gaussian kernel over standardised
statistics of the text.  Ridge scores come from normal equations that every partition
sums on its own and Spark adds up entry by entry; a monotone (isotonic) fit on rows
that the ridge has not seen turns scores into probabilities of label 1.

The statistics are read from the whole text and written once; labels are joined with
them, not with the texts.  What reaches the driver is of fixed size: the moments, the
(FEATURES + 1)^2 normal equations and the calibration bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, WordBlock, mix, overlapping, row_spans, small_batches, string_buffers, written
from .language_id import held_out

FEATURES = 128
WIDTH = 2.5  # of the kernel, in standard deviations
RIDGE = 1e-3  # times the number of rows
CLIP = 4.0
BINS = 400
SEED = 20240101
ACCEPT = 0.7

STATS = (
    "log_words",
    "word_bytes",
    "log_lines",
    "upper",
    "digits",
    "symbols",
    "marks",
    "exclaims",
    "high_bytes",
    "distinct_words",
    "distinct_pairs",
    "distinct_triples",
    "same_as_last",
    "long_words",
)

_KIND = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in "#*$%&|<>^~=_{}[]\\/@+" else 4 if _c in ".,;:?'\"()-" else 5 if _c == "!" else 6 if _c == "\n" else 0
_KIND[128:] = 7


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values per row."""
    if not len(h):
        return np.zeros(rows)
    u, first = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=rows).astype(float)


def _ratios(n, size, kinds, distinct, same, long_words) -> np.ndarray:
    """STATS from counts per row; ``kinds`` has a column per kind of byte."""
    some, words2, words3, body = np.maximum(n, 1), np.maximum(n - 1, 1), np.maximum(n - 2, 1), np.maximum(size, 1)
    one, two, three = distinct
    return np.stack(
        [
            np.log1p(n),
            size / some,
            np.log1p(kinds[:, 6]),
            kinds[:, 1] / body,
            kinds[:, 2] / body,
            kinds[:, 3] / body,
            kinds[:, 4] / body,
            kinds[:, 5] / body,
            kinds[:, 7] / body,
            one / some,
            two / words2,
            three / words3,
            same / words2,
            long_words / some,
        ],
        axis=1,
    )


def _wide_capitals(d: np.ndarray) -> np.ndarray:
    """Where capitals beyond ASCII begin, two-byte Latin: C3 80 to C3 9E."""
    return np.flatnonzero((d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)) if len(d) > 1 else np.zeros(0, np.int64)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    return pair, mix(pair[:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]


def statistics(block: WordBlock) -> np.ndarray:
    """STATS of each row of the block."""
    rows = len(block.first) - 1
    n = np.diff(block.first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(block.first))
    of_byte = np.repeat(np.arange(rows), np.diff(block.offsets))
    kinds = np.bincount(of_byte * 8 + _KIND[block.data], minlength=8 * rows).reshape(rows, 8).astype(float)
    kinds[:, 1] += np.bincount(of_byte[_wide_capitals(block.data)], minlength=rows)
    length = (block.ends - block.starts).astype(float)
    h = block.hashes
    pair, triple = _runs(h)
    in2, in3 = row[: len(pair)] == row[1 : len(pair) + 1], row[: len(triple)] == row[2 : len(triple) + 2]
    same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) > 1 else np.zeros(rows)
    distinct = _distinct(h, row, rows), _distinct(pair[in2], row[: len(pair)][in2], rows), _distinct(triple[in3], row[: len(triple)][in3], rows)
    return _ratios(n, np.bincount(row, weights=length, minlength=rows), kinds, distinct, same, np.bincount(row, weights=length > 24, minlength=rows))


def long_statistics(data: np.ndarray, part: int = 1 << 21) -> np.ndarray:
    """STATS of one very long text, a part at a time: memory is that of a part and eight
    bytes for each distinct word, pair and triple."""
    kinds = np.zeros((1, 8))
    for at in range(0, len(data), part):
        d = data[at : at + part + 1]
        kinds[0] += np.bincount(_KIND[d[:part]], minlength=8)
        kinds[0, 1] += int((_wide_capitals(d) < part).sum())
    n = size = same = long_words = 0
    sets = [np.zeros(0, np.uint64)] * 3
    for word, block, _ in overlapping(data, 2, part):
        old = n - word  # words of the part before that come again
        length, h = (block.ends - block.starts)[old:], block.hashes
        same += int((h[1:] == h[:-1])[max(old - 1, 0) :].sum())
        n, size, long_words = n + len(length), size + int(length.sum()), long_words + int((length > 24).sum())
        sets = [np.union1d(x, y) for x, y in zip(sets, (h, *_runs(h)))]
    one = lambda x: np.array([float(x)])
    return _ratios(one(n), one(size), kinds, [one(len(x)) for x in sets], one(same), one(long_words))


def all_statistics(text: pa.Array) -> np.ndarray:
    data, offsets = string_buffers(text)
    parts = []
    for lo, hi in row_spans(offsets):
        d = data[offsets[lo] : offsets[hi]]
        parts.append(long_statistics(d) if len(d) > LONG and hi - lo == 1 else statistics(WordBlock(d, offsets[lo : hi + 1] - offsets[lo])))
    return np.concatenate(parts) if parts else np.zeros((0, len(STATS)))


def _to_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _stats(text: pa.Array) -> pa.Array:
    return _to_lists(all_statistics(text))


def _from_lists(arr: pa.Array) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1) if len(arr) else np.zeros((0, len(STATS)))


class Scorer:
    """Standardise, random Fourier features, ridge weights, monotone calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.cos(x @ self.w + self.shift) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def probability(self, stats: np.ndarray) -> np.ndarray:
        s = self.raw(stats)
        return np.clip(np.interp(s, *self.knots) if self.knots else s, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, value) of the pooled blocks of sorted x."""
    blocks_: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks_.append([a * c, b * c, c])
        while len(blocks_) > 1 and blocks_[-2][1] * blocks_[-1][2] >= blocks_[-1][1] * blocks_[-2][2]:
            last = blocks_.pop()
            blocks_[-1] = [p + q for p, q in zip(blocks_[-1], last)]
    t = np.array(blocks_)
    return t[:, 0] / t[:, 2], t[:, 1] / t[:, 2]


def _normal(shared):
    """Upper triangle of [features | y]' [features | y], summed over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FEATURES + 2
        total = np.zeros((m, m))
        for b in batches:
            z = np.hstack([shared.value.features(_from_lists(b.column("stats"))), b.column("y").to_numpy(zero_copy_only=False)[:, None]])
            total += z.T @ z
        if total.any():
            k = np.arange(m * m, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], ["k", "v"])

    return run


def _raw(shared):
    return lambda stats: pa.array(shared.value.raw(_from_lists(stats)))


def fit(labelled: DataFrame):
    """Broadcast scorer from (stats, y, calibrate); None if there is nothing to learn."""
    spark = labelled.sparkSession
    cols = [F.element_at("stats", k + 1) for k in range(len(STATS))]
    moments = labelled.agg(F.count(F.lit(1)), F.count_if(~F.col("calibrate")), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not moments[0]:
        return None
    mean, scale = (np.array(moments[2 + k * len(STATS) : 2 + (k + 1) * len(STATS)], float) for k in (0, 1))
    scorer = Scorer(mean, np.where(scale > 1e-9, scale, 1.0))
    use = labelled.where("not calibrate") if moments[1] else labelled
    sums = use.select("stats", "y").mapInArrow(_normal(spark.sparkContext.broadcast(scorer)), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    m = FEATURES + 2
    total = np.zeros(m * m)
    total[sums["k"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(m, m)
    n = total[m - 2, m - 2]
    scorer.beta = np.linalg.solve(total[:-1, :-1] + RIDGE * n * np.diag([1.0] * FEATURES + [1e-6]), total[:-1, -1])
    raw = F.arrow_udf(_raw(spark.sparkContext.broadcast(scorer)), "double")("stats")
    half = labelled.where("calibrate").select(F.least(F.greatest(raw, F.lit(-1.0)), F.lit(2.0)).alias("s"), "y")
    bins = half.groupBy(F.floor(F.col("s") * BINS / 3).alias("bin")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("s")
    if len(bins) and 0 < (bins["y"] * bins["n"]).sum() < bins["n"].sum():
        scorer.knots = isotonic(bins["s"].to_numpy(float), bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return spark.sparkContext.broadcast(scorer)


def with_labels(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 4, out_fold: int = 2, calibrate_fold: int = 3) -> DataFrame:
    """(stats, y, calibrate) of the labelled rows outside the held-out fold; rows whose
    id or label is null, or label other than 0 and 1, teach nothing.  Ids may be of any
    type that both tables share; repeated rows count as often as they occur."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("_id is not null and y in (0, 1)")
    j = stats.join(y, "_id").where(~held_out(F.col("_id"), folds, out_fold))
    return j.select("stats", "y", held_out(F.col("_id"), folds, calibrate_fold).alias("calibrate"))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, stats), written to the shared folder; null texts have the statistics of empty ones."""
    small_batches(docs.sparkSession)
    return written(docs.select(F.col(id_col).alias("_id"), F.arrow_udf(_stats, "array<double>")(F.col(text_col).cast("string")).alias("stats")), "statistics")


def _probability(shared, of):
    def run(arr: pa.Array) -> pa.Array:
        x = of(arr)
        return pa.array(np.round(shared.value.probability(x), 9) if shared is not None else np.ones(len(x)))

    return run


def scored(docs: DataFrame, fitted, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the score in column ``out``, straight from the texts; an input column
    of that name is replaced, others pass through under any name.

    Null texts score as empty ones do; repeated rows score equally; very long texts are
    read whole, a part at a time; an empty table gives an empty one.  Without any label
    nothing is held against a document, and the score is 1.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(_probability(fitted, all_statistics), "double")(F.col(text_col).cast("string")))


def accepted(docs: DataFrame, fitted, text_col: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows that score ``least`` or more, with their own columns, whatever those are called."""
    small_batches(docs.sparkSession)
    return docs.where(F.arrow_udf(_probability(fitted, all_statistics), "double")(F.col(text_col).cast("string")) >= least)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = document_statistics(docs)
    fitted = fit(with_labels(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = F.arrow_udf(_probability(fitted, _from_lists), "double")("stats")
    out = stats.select(F.col("_id").alias("doc_id"), held_out(F.col("_id"), 4, 2).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
