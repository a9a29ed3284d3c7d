"""What the operators share: word rules, the shared folder, numpy word blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary folder of
    this machine; on a cluster that would be another folder for each executor.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: if an executor is lost, later stages reread the table
    instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discarded(table: DataFrame) -> None:
    """Remove a table that ``written`` made, once nothing will read it again."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Hand at most ``rows`` rows and about ``size`` bytes to Python at a time, unless the
    session already asks for less: texts are long, and a worker holds a batch several
    times over.  Plans read these settings when they run, so they stay set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", spark.conf.get(key).lower()).groups()
        now = int(number) << 10 * "bkmgt".index(unit or "b")
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` beside one struct ``_row`` of all input columns, so that no input name
    can clash with one of an operator; ``unboxed`` undoes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *[c.alias(k) for k, c in columns.items()])


def unboxed(d: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The input columns of boxed rows, and ``columns``, which replace those of their names."""
    names = [c for c in d.schema["_row"].dataType.names if c not in without and c not in columns]
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[c.alias(k) for k, c in columns.items()])


def part_of(salts: int, *by: str) -> Column:
    """Number of the part, out of ``salts``, in which the rows of a hot key are dealt."""
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def parts_held(part: Column) -> Column:
    """Aggregate: the parts (at most 63) that a key has rows in, as bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part))


def each_part(held: str, salts: int) -> Column:
    """A row for each part in ``held``, so that a join on key and part spreads a hot key
    and copies the other side no further than its parts."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda p: F.getbit(held, p) == 1))


def ranged(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` stored in ranges of ``order``, with the number of the range as ``_block``.

    Spark draws the bounds from a sample of its own; as the number is written, whatever is
    worked out from it later agrees, also after tasks are lost.
    """
    return written(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), name)


def numbered(table: DataFrame, number: str, rows: str, *order: Column) -> DataFrame:
    """A ``ranged`` table with the running sum of ``rows`` in ``order``: rows are ordered in
    their ranges, and only a row for each range is ordered as a whole."""
    blocks = table.groupBy("_block").agg(F.sum(rows).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(rows).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return table.join(blocks.select("_block", before.alias("_before")), "_block").withColumn(number, F.col("_before") + inside).drop("_before")


def words(text: Column) -> Column:
    """Native array of the words of ``text``; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Native number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- numpy blocks -----------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: As separators: white space and ASCII punctuation, for comparison of bare words.
BARE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 18)
        for k, r in enumerate((_R, _RI)):
            t = np.full(n, r, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordBlock:
    """Words of consecutive rows: ``starts``/``ends`` in bytes, ``first[r]`` the
    number of the first word of row r, ``hashes`` one 64-bit value per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        space = between[data]
        edge = np.ones(n + 1, bool)
        edge[1:] = space
        inner = offsets[offsets < n]
        edge[inner] = True
        solid = ~space
        self.starts = np.flatnonzero(solid & edge[:-1])
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after[offsets[offsets > 0] - 1] = True
        self.ends = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        p, q = _power_tables(n)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=acc[1:])
        self.hashes = mix((acc[self.ends] - acc[self.starts]) * q[self.starts])


def overlapping(data: np.ndarray, overlap: int, most: int = 1 << 18, between: np.ndarray = _SPACE) -> Iterator[tuple[int, WordBlock, bool]]:
    """(number of the first word, words, whether it is the last part) of one text, in parts
    of about ``most`` bytes of which each repeats the last ``overlap`` words of the one
    before; so what is computed of a very long text needs no memory for all of it."""
    at = word = 0
    while True:
        end = at + most
        while end < len(data):
            cut = np.flatnonzero(between[data[end : end + most]])
            if len(cut):
                end += int(cut[0])
                break
            end += most  # one word longer than a part stays whole
        end = min(end, len(data))
        block = WordBlock(data[at:end], np.array([0, end - at]), between)
        n = len(block.starts)
        if end == len(data):
            yield word, block, True
            return
        if n <= overlap + 1:
            most *= 2  # too few words to go on from
            continue
        yield word, block, False
        word += n - overlap
        at = at + int(block.starts[n - overlap]) if overlap else end


LONG = 1 << 20  # bytes from which a text is worked on in parts


def row_spans(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of slices of about ``most`` bytes, a longer text by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), n)
        yield lo, hi
        lo = hi


def blocks(arr: pa.Array, most: int = 1 << 18, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, WordBlock]]:
    """(first row, row after the last, words) over slices of about ``most`` bytes; a longer
    text is a slice of its own."""
    data, offsets = string_buffers(arr)
    for lo, hi in row_spans(offsets, most):
        yield lo, hi, WordBlock(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], between)


_AFTER = re.compile(rb"[ \t\n\x0b\x0c\r]")


def normal(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words of a text joined by one space, and where each begins, with one more place
    after the last: word k is ``out[at[k] : at[k + 1] - 1]``.  A long text is split a part
    at a time, so that its words never exist as a list."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > LONG:
            stop = _AFTER.search(text, at + LONG)
            end = stop.end() if stop else end
        if words_ := text[at:end].split():
            parts.append(b" ".join(words_))
        at = end
    out = b" ".join(parts)
    if not out:
        return out, np.zeros(1, np.int64)
    return out, np.concatenate([[0], np.flatnonzero(np.frombuffer(out, np.uint8) == 32) + 1, [len(out) + 1]])
