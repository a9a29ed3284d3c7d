"""Rollups of a stream by event time."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.operators.rollup import measures

BUCKETS = {"hour": ("1 hour", "bucket_start"), "day": ("1 day", "bucket_date")}


def rollup_stream(readings: DataFrame, bucket: str = "hour", lateness: str = "2 hours", time: str = "reading_ts") -> DataFrame:
    """A stream of readings as rows of ``rollup.rollup``, one for each sensor and bucket.

    A bucket is given out once, when the watermark (the newest time seen less ``lateness``)
    has passed its end; then its state goes, so state holds only open buckets and the keys
    of readings younger than the watermark.  A reading that repeats a sensor and time
    counts once.  Readings older than the watermark (that which the micro-batch before
    worked with) count in no bucket: ``LateRows`` says how many there were.  Nulls of
    ``time`` belong to no bucket.
    """
    length, name = BUCKETS[bucket]
    d = readings.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["sensor_id", time])
    d = d.groupBy("sensor_id", F.window(time, length).alias("_w")).agg(*measures(time))
    start = F.col("_w.start")
    rest = [c for c in d.columns if c not in ("sensor_id", "_w")]
    return d.select("sensor_id", (start.cast("date") if bucket == "day" else start).alias(name), *rest)


class LateRows(StreamingQueryListener):
    """Counts, for each query by name, the readings that came after the watermark.

    The first stateful operator of ``rollup_stream`` sees single readings, so its count of
    dropped rows is one of readings; later operators see sums.
    """

    def __init__(self) -> None:
        self.late: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.late.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.late[p.name] = self.late.get(p.name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators if s.operatorName == "dedupeWithinWatermark")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
