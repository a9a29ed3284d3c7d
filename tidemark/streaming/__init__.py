"""Streams: validation of scans as they arrive, rollups by event time, and loads.

The batch validator orders a whole file; ``validated_stream`` keeps, per machine, only
what the next scan is judged by: the newest accepted time, the scan before, the length
of the current freeze, and the scans of a freeze that is not yet long enough to be one.
Those wait in the state and leave with their true flag, so that the stream gives every
scan what the batch validator would, however it is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import constants as C

from .load import load_stream
from .rollups import LateRows, rollup_stream

__all__ = ["validated_stream", "rollup_stream", "LateRows", "load_stream", "STATE"]

STATE = "newest timestamp, last array<double>, run long, held binary"


_NEVER = np.iinfo(np.int64).min


def _packed(rows: pd.DataFrame | None) -> bytes | None:
    if rows is None or not len(rows):
        return None
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None) -> pd.DataFrame | None:
    return None if held is None else pa.ipc.open_stream(bytes(held)).read_pandas()


def freezes(same: np.ndarray, length: int, least: int) -> tuple[np.ndarray, np.ndarray, bool | None, int]:
    """What scans after a freeze of ``length`` scans are, given whether each repeats the one
    before: (held, still undecided, what the undecided scans before these are, length of the
    freeze at the end).

    A run of repeating scans is a freeze from ``least`` on.  Undecided are the scans of a
    last run that is shorter; those from before are held (True), good (False) or undecided
    yet (None).
    """
    if not len(same):
        return np.zeros(0, bool), np.zeros(0, bool), None, length
    run = np.cumsum(~same)
    sizes = np.bincount(run, weights=same, minlength=run[-1] + 1).astype(np.int64)
    sizes[0] += length
    long = sizes >= least
    last = run == run[-1]
    before = True if long[0] else False if run[-1] else None
    return same & long[run], same & last & ~long[run[-1]], before, int(sizes[-1])


def validated_stream(scans: DataFrame, key: str, time: str, signals: list[str], gap_seconds: float = C.GAP_SECONDS, samples: int = C.FLATLINE_SAMPLES, line: str | None = None, flush_after: float | None = None) -> DataFrame:
    """A stream of (key, time, signals) with ``reject``, ``gap_seconds`` and ``is_stale``.

    A shuffle keeps no order, so the rows of a key in a micro-batch are put in that of
    ``line`` (a line or sequence number of the source, returned as well), or of their
    time where the source has none; what one trigger admits of a key must fit in memory.
    State per key is one scan and at most ``samples`` - 2 waiting ones, however long the
    stream runs.  A null time is rejected as unparseable and takes no part in the order.

    Scans of a freeze that is still too short wait for the next scan; where none comes for
    ``flush_after`` seconds (of the clock, not of the scans) they leave as good, as at the
    end of a file.  A freeze that goes on after that counts them, but they are gone.
    """
    least = max(samples - 1, 1)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, last, length, held = state.get if state.exists else (None, None, 0, None)
        waiting = _unpacked(held)
        if state.hasTimedOut:
            if waiting is not None:
                yield waiting.assign(is_stale=False)
            state.update((newest, last, length, None))
            return
        g = pd.concat(list(batches), ignore_index=True).sort_values(line or time, kind="stable", ignore_index=True)
        t = g[time].to_numpy("datetime64[ns]").astype(np.int64)
        null = g[time].isna().to_numpy()
        t[null] = _NEVER
        before = np.maximum.accumulate(np.append(_NEVER if newest is None else pd.Timestamp(newest).value, t))[:-1]
        first = before == _NEVER
        late = ~first & (t <= before)
        reject = np.select([null, late & (t == before), late], ["UNPARSEABLE_TIMESTAMP", "DUPLICATE_TIMESTAMP", "NON_MONOTONIC_TIMESTAMP"], "").astype(object)
        reject[reject == ""] = None
        ok = ~late & ~null
        step = np.where(ok & ~first, (t - np.where(first, t, before)) / 1e9, np.nan)
        g = g.assign(reject=pd.Series(reject, dtype=object), gap_seconds=pd.array(np.where(step > gap_seconds, step, np.nan), "Float64"))
        values = g.loc[ok, signals].to_numpy(float, na_value=np.nan)
        was = np.full((1, len(signals)), np.nan) if last is None else np.array([[np.nan if x is None else x for x in last]], float)
        same = (values == np.vstack([was, values])[:-1]).all(axis=1)
        stale, wait = np.zeros(len(g), bool), np.zeros(len(g), bool)
        stale[ok], wait[ok], true, length = freezes(same, length, least)
        if len(values):
            newest, last = g.loc[ok, time].iloc[-1], [None if np.isnan(x) else float(x) for x in values[-1]]
        if waiting is not None and true is not None:
            yield waiting.assign(is_stale=true)
            waiting = None
        if not wait.all():
            yield g.assign(is_stale=stale)[~wait]
        if wait.any():
            waiting = g[wait] if waiting is None else pd.concat([waiting, g[wait]], ignore_index=True)
        state.update((newest, last, length, _packed(waiting)))
        if flush_after is not None and waiting is not None:
            state.setTimeoutDuration(int(flush_after * 1000))

    d = scans.select(key, *([line] if line else []), time, *signals)
    types = dict(d.dtypes)
    out = ", ".join(f"`{c}` {types[c]}" for c in d.columns) + ", reject string, gap_seconds double, is_stale boolean"
    timer = GroupStateTimeout.NoTimeout if flush_after is None else GroupStateTimeout.ProcessingTimeTimeout
    return d.groupBy(key).applyInPandasWithState(run, out, STATE, "append", timer)
