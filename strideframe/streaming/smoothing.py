"""Low-pass of sessions: a session is filtered once, when the watermark says that it is over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strideframe.functions.signal import low_pass
from strideframe.operators import series


def _schema(rows: DataFrame, key: str, at: str, values: list[str]) -> str:
    return f"{key} {rows.schema[key].dataType.simpleString()}, session_start timestamp, {at} timestamp, {', '.join(f'{v} double' for v in values)}"


def smoothed_sessions(rows: DataFrame, key: str, at: str, values: list[str], fps: float, cutoff_hz: float, gap_s: float) -> DataFrame:
    """key, session_start, at and the filtered values of a finished table: runs of rows with breaks of ``gap_s`` at most."""
    w = series.over([key], at)
    apart = F.coalesce(F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w) > int(gap_s * 1e6), F.lit(True))
    cut = rows.select(key, at, *[F.col(v).cast("double").alias(v) for v in values]).withColumn("_session", F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(at).over(Window.partitionBy(key, "_session"))
    out = series.filtered(cut.withColumn("session_start", start), [key, "_session"], at, values, F.lit(float(fps)), cutoff_hz)
    return out.select(key, "session_start", at, *values)


class SessionProcessor(StatefulProcessor):
    """Rows of one key that wait for their session to close: a list, and a timer where the next one may."""

    def __init__(self, key: str, at: str, values: list[str], fps: float, cutoff_hz: float, gap_s: float):
        self.key, self.at, self.values, self.fps, self.cutoff_hz, self.gap_us = key, at, values, fps, cutoff_hz, int(gap_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us bigint, v array<double>")

    def _closes(self, last_us: int) -> int:
        """The watermark (ms) behind which no row can join a session with this last row."""
        return -(-(last_us + self.gap_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found = []
        for pdf in rows:
            micros = pdf[self.at].astype("datetime64[us]").astype("int64").tolist()
            found += [(t, [None if x != x else float(x) for x in v]) for t, v in zip(micros, pdf[self.values].to_numpy(dtype=float).tolist(), strict=True)]
        if found:
            self.waiting.appendList(found)
            # A later row of the session moves its end; the timer then only looks and is set anew.
            self.handle.registerTimer(self._closes(min(t for t, _ in found)))
        yield pd.DataFrame([], columns=[self.key, "session_start", self.at, *self.values])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        out, open_ = [], []
        times = np.array([r[0] for r in rows], dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(times) > self.gap_us) + 1).tolist(), len(rows)] if rows else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if self._closes(int(times[b - 1])) <= mark:
                x = np.array([[np.nan if v is None else v for v in r[1]] for r in rows[a:b]], dtype=float)
                done = low_pass(x, self.fps, self.cutoff_hz)
                out.append(pd.DataFrame({self.key: [key[0]] * (b - a), "session_start": pd.to_datetime(np.repeat(times[a], b - a), unit="us"), self.at: pd.to_datetime(times[a:b], unit="us"), **{v: done[:, k] for k, v in enumerate(self.values)}}))
            else:
                open_ += rows[a:b]
        if out:
            if open_:
                self.waiting.put(open_)
            else:
                self.waiting.clear()
        if open_:
            ends = [int(times[b - 1]) for b in cuts[1:]]
            self.handle.registerTimer(min(c for c in map(self._closes, ends) if c > mark))
        yield pd.concat(out) if out else pd.DataFrame([], columns=[self.key, "session_start", self.at, *self.values])

    def close(self) -> None:
        pass


def stream_smoothed_sessions(rows: DataFrame, key: str, at: str, values: list[str], fps: float, cutoff_hz: float, gap_s: float, late: str = "1 minute") -> DataFrame:
    """``smoothed_sessions`` of a stream: each session once, when the watermark (``late`` behind the latest row) is a gap behind its last row.

    State is the rows of sessions that are open. The session must use the
    RocksDB store (``tracking.use_rocksdb``).
    """
    marked = rows.select(key, at, *values).withWatermark(at, late)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=SessionProcessor(key, at, values, fps, cutoff_hz, gap_s), outputStructType=_schema(rows, key, at, values), outputMode="Append", timeMode="EventTime")
