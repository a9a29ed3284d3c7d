"""Median and median absolute deviation of the rows before each row, in long series."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .compress import _starts
from .ordered import running

CUT_ROWS = 50_000


class Sliding:
    """The last ``size`` values in order of size, to read a median and its deviation from.

    A value comes and goes by binary search; the deviations left and right of the median
    are two sorted sequences, whose middle is found by binary search as well, without
    sorting anything.
    """

    def __init__(self, size: int):
        self.size, self.rows, self.sorted, self.odd = size, deque(), [], 0

    def __len__(self) -> int:
        return len(self.sorted) + self.odd

    def push(self, x: float | None) -> None:
        self.rows.append(x)
        if x is not None:
            if math.isfinite(x):
                insort(self.sorted, x)
            else:
                self.odd += 1
        if len(self.rows) > self.size:
            old = self.rows.popleft()
            if old is not None:
                if math.isfinite(old):
                    del self.sorted[bisect_left(self.sorted, old)]
                else:
                    self.odd -= 1

    def middle(self) -> tuple[float, float]:
        """(median, median absolute deviation); NaN counts as the largest value."""
        if self.odd:
            return self._sorting()
        s, n = self.sorted, len(self.sorted)
        m = (s[(n - 1) // 2] + s[n // 2]) / 2.0
        left = bisect_left(s, m)
        k, right = (n - 1) // 2, n - left
        lo, hi = max(0, k + 1 - right), min(k + 1, left)
        while lo < hi:  # how many of the k + 1 smallest deviations lie left of the median
            mid = (lo + hi) // 2
            if m - s[left - 1 - mid] < s[left + k - mid] - m:
                lo = mid + 1
            else:
                hi = mid
        a, b = lo, k + 1 - lo
        low = max(m - s[left - a] if a else 0.0, s[left + b - 1] - m if b else 0.0)
        if n % 2:
            return m, (low + low) / 2.0
        high = min(m - s[left - 1 - a] if a < left else math.inf, s[left + b] - m if b < right else math.inf)
        return m, (low + high) / 2.0

    def _sorting(self) -> tuple[float, float]:
        with np.errstate(all="ignore"):
            v = np.sort(np.array([x for x in self.rows if x is not None]))
            n = len(v)
            m = float((v[(n - 1) // 2] + v[n // 2]) / 2.0)
            d = np.sort(np.abs(v - m))
            return m, float((d[(n - 1) // 2] + d[n // 2]) / 2.0)


def _slide(by: list[str], value: str, window: int, least: int):
    """Sorted batches with ``_n``, ``_m`` and ``_mad`` of the rows before each row of its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = Sliding(window), None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            starts = set(_starts(t, by).tolist())
            first = tuple(t.column(c)[0].as_py() for c in by)
            if first == last:
                starts.discard(0)
            last = tuple(t.column(c)[t.num_rows - 1].as_py() for c in by)
            ahead = t.column("_ahead").to_pylist()
            out = []
            for k, x in enumerate(t.column(value).to_pylist()):
                if k in starts:
                    state = Sliding(window)
                if not ahead[k]:
                    out.append((len(state), *(state.middle() if len(state) >= max(least, 1) else (None, None))))
                state.push(x)
            t = t.filter(pa.array([not a for a in ahead])).drop_columns(["_ahead", "_piece", "_k"])
            n, m, mad = zip(*out) if out else ((), (), ())
            for name, c, kind in (("_n", n, pa.int64()), ("_m", m, pa.float64()), ("_mad", mad, pa.float64())):
                t = t.append_column(name, pa.array(c, kind))
            yield from t.combine_chunks().to_batches()

    return run


def before_each(df: DataFrame, by: list[str], block: str, order: str, value: str, window: int, least: int, cut_rows: int = CUT_ROWS) -> DataFrame:
    """``df`` with the number (``_n``), median (``_m``) and median absolute deviation
    (``_mad``) of the known values in the ``window`` rows before each row, never itself;
    the last two are null where fewer than ``least`` values are known.

    A series in ``by`` is numbered in its blocks and cut every ``cut_rows`` rows; the last
    ``window`` rows of a piece go to the next one as well, to fill its window.  Pieces
    stream through in sorted Arrow batches, so a task holds a batch and one window.
    """
    cut = max(cut_rows, window)
    d = running(df.withColumn(value, F.col(value).cast("double")), by, block, [order], "_k", F.lit(1).cast("long"))
    piece, at = F.floor((F.col("_k") - 1) / cut), F.pmod(F.col("_k") - 1, F.lit(cut))
    own, more = F.struct(piece.alias("_piece"), F.lit(False).alias("_ahead")), F.struct((piece + 1).alias("_piece"), F.lit(True).alias("_ahead"))
    d = d.withColumn("_at", F.explode(F.when(at >= cut - window, F.array(own, more)).otherwise(F.array(own)))).select(*d.columns, "_at._piece", "_at._ahead")
    keys = [*by, "_piece"]
    schema = d.drop("_piece", "_ahead", "_k").schema.add("_n", LongType()).add("_m", DoubleType()).add("_mad", DoubleType())
    return d.repartition(*keys).sortWithinPartitions(*keys, "_k").mapInArrow(_slide(keys, value, window, least), schema)
