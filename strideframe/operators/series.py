"""Ordered-series operators: windows over a key and an order column.

All of them shuffle once on the key and sort by the order; chained ones share
that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strideframe.functions.signal import RunningMedian, low_pass


def over(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def number(keys: list[str], order: str) -> Column:
    """0-based position in the series."""
    return (F.row_number().over(over(keys, order)) - 1).cast("bigint")


def quotient(value: Column, before: Column, after: Column, at: Column, at_before: Column, at_after: Column) -> Column:
    """Second-order difference quotient over uneven steps, one-sided where a neighbour is absent; NULL without any."""
    hs, hd = at - at_before, at_after - at
    inner = (hs * hs * after + (hd * hd - hs * hs) * value - hd * hd * before) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (after - value) / hd).when(hd.isNull(), (value - before) / hs).otherwise(inner)


def central(value: Column, before: Column, after: Column, step: Column) -> Column:
    """Central differences over even steps, one-sided where a neighbour is absent; 0 without any."""
    return F.coalesce((after - before) / (2 * step), (after - value) / step, (value - before) / step, F.lit(0.0))


def gradient(value: Column, at: Column, w: WindowSpec) -> Column:
    """``quotient`` with the neighbours in a window's order."""
    beside = lambda c: (c, F.lag(c).over(w), F.lead(c).over(w))
    return quotient(*beside(value), *beside(at))


def uniform_gradient(value: Column, step: Column | float, w: WindowSpec) -> Column:
    """``central`` with the neighbours in a window's order."""
    return central(value, F.lag(value).over(w), F.lead(value).over(w), F.lit(step) if isinstance(step, float | int) else step)


def step_length(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance from the row before, 0 for the first."""
    return F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))


def between(value: Column, at: Column, a: Column, b: Column) -> Column:
    """A value, or else what lies on the line between the known ones (at, v) on both sides, or the only one, or 0."""
    line = a["v"] + (b["v"] - a["v"]) * (at - a["at"]) / (b["at"] - a["at"])
    return F.coalesce(value, line, a["v"], b["v"], F.lit(0.0))


def interpolated(value: Column, at: Column, keys: list[str], order: str) -> Column:
    """NULLs filled linearly by position and flat at the ends; 0 if the series has no value.

    Both neighbours come from running windows, one along the order and one against it.
    """
    so_far = (Window.unboundedPreceding, 0)
    back, ahead = over(keys, order).rowsBetween(*so_far), Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(*so_far)
    mark = F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("v")))
    return between(value, at, F.last(mark, ignorenulls=True).over(back), F.last(mark, ignorenulls=True).over(ahead))


def local_peak(value: Column, threshold: Column | float, w: WindowSpec) -> Column:
    """True where a value reaches the threshold, is not below the one before and above the next."""
    return F.coalesce((value >= threshold) & (value >= F.lag(value).over(w)) & (value > F.lead(value).over(w)), F.lit(False))


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """rows with ``island``, the number of the run of true flags a row is in (NULL outside)."""
    w = over(keys, order)
    begins = F.when(flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    counted = rows.withColumns({"_flag": flag, "_begins": begins})
    run = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("island", F.when(F.col("_flag"), run)).drop("_flag", "_begins")


def gap_fill(rows: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """One row for every whole step from the first to the last of a key; absent ones have NULL values."""
    span = rows.groupBy(*keys).agg(F.min(order).alias("a"), F.max(order).alias("b"))
    dense = span.select(*keys, F.explode(F.sequence("a", "b")).alias(order))
    return dense.join(rows.select(*keys, order, *values), [*keys, order], "left")


def refractory(events: DataFrame, keys: list[str], at: str, strength: str, gap: float, *more: str) -> DataFrame:
    """Of events closer than ``gap`` to the one kept last, the stronger stays and becomes the new anchor.

    After an event that is ``gap`` or more behind the one before it the rule
    starts anew, so a key's events are cut there and the pieces are worked on
    apart. Within a piece only the event kept last is remembered.
    """
    fields = [at, strength, *more]
    w = over(keys, at)
    apart = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    pieces = events.select(*keys, *fields).withColumn("_piece", F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the event kept last; all that the next batch needs to know
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            of = rows[[*keys, "_piece"]]
            begins = (of != of.shift()).any(axis=1).to_numpy()
            times, strengths, kept, last = rows[at].tolist(), rows[strength].tolist(), [], 0
            for i in range(1, len(rows)):
                if begins[i] or times[i] - times[last] >= gap:
                    kept.append(last)
                    last = i
                elif strengths[i] > strengths[last]:
                    last = i
            held = rows.iloc[[last]] if len(rows) else None
            yield rows.iloc[kept].drop(columns="_piece")
        if held is not None:
            yield held.drop(columns="_piece")

    ordered = pieces.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", *fields)
    return ordered.mapInPandas(run, pieces.drop("_piece").schema)


def latest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, fields: list[str]) -> DataFrame:
    """left with ``fields`` of the row of right that is the latest of its key at or before left_at (NULL without one).

    Both sides go through one ordered window on the key, so no row of one side
    is multiplied by the rows of the other. Of rows of right at one time the
    one with the largest fields counts.
    """
    kind = left.select(F.struct("*").alias("row")).schema["row"].dataType
    told = right.select(F.struct(*fields).alias("row")).schema["row"].dataType
    asked = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(told).alias("_seen"), F.struct("*").alias("_row"))
    known = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_turn"), F.struct(*fields).alias("_seen"), F.lit(None).cast(kind).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_turn", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.union(known).withColumn("_met", F.last("_seen", ignorenulls=True).over(w)).where("_turn = 1")
    return met.select("_row.*", *[F.col(f"_met.{c}").alias(c) for c in fields])


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, out: str) -> DataFrame:
    """left with ``out``, the latest right_at of its key at or before left_at (NULL without one)."""
    known = right.select(*keys, F.col(right_at).alias(out))
    return latest(left, known, keys, left_at, out, [out])


def strided(rows: DataFrame, keys: list[str], order: str, at: str, stride: int = 1, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows with start <= at < end, and of these every stride-th, counted inside the window."""
    if start is not None:
        rows = rows.where(F.col(at) >= start)
    if end is not None:
        rows = rows.where(F.col(at) < end)
    return rows.withColumn("_n", number(keys, order)).where(F.col("_n") % stride == 0).drop("_n")


def by_key(rows: DataFrame, keys: list[str], order: str, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """What ``run`` makes of whole keys, many at a time: it gets their rows in order and where each key begins (and the end).

    Rows come in large batches instead of one for each key, so that short keys
    cost no more than their rows. Of a key that goes on in the next batch the
    rows are held back, so memory is that of a batch and of the longest key.
    """

    def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(pdf):
                begins = _begins(pdf[keys])  # the last of them is the end of the keys that are whole
                held = pdf.iloc[begins[-1] :]
                if len(begins) > 1:
                    yield run(pdf.iloc[: begins[-1]], begins)
        if held is not None:
            held = held.reset_index(drop=True)
            yield run(held, np.array([0, len(held)]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(over_batches, schema)


def by_key_in_arrow(rows: DataFrame, keys: list[str], order: str, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``by_key`` for rows of which ``run`` reads few columns: it gets and gives Arrow tables, so that the others are handed on as they are."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                begins = _begins(table.select(keys).to_pandas())
                held = table.slice(int(begins[-1]))
                if len(begins) > 1:
                    yield from run(table.slice(0, int(begins[-1])), begins).to_batches()
        if held is not None:
            yield from run(held, np.array([0, held.num_rows])).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(over_batches, schema)


def _begins(keys: pd.DataFrame) -> np.ndarray:
    """Rows at which another key begins; nulls are one key."""
    other = np.zeros(len(keys), bool)
    other[0] = True
    for c in keys.columns:
        v = keys[c]
        before = v.shift()
        other[1:] |= ((v != before) & ~(v.isna() & before.isna())).to_numpy()[1:]
    return np.flatnonzero(other)


def filtered(rows: DataFrame, keys: list[str], order: str, values: list[str], fps: Column, cutoff_hz: float | None) -> DataFrame:
    """Zero-phase low-pass of the value columns within each key; both passes run through the whole series.

    Keys of one length are filtered side by side. ``long_series.filtered`` is for keys that one task can't hold.
    """
    if cutoff_hz is None:
        return rows
    narrow = rows.withColumn("_fps", fps.cast("double"))

    def run(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        x, rates = pdf[values].to_numpy(dtype=float), pdf["_fps"].to_numpy(dtype=float)
        alike: dict[tuple[int, float], list[int]] = {}
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            alike.setdefault((b - a, rates[a]), []).append(a)
        for (n, rate), starts in alike.items():
            at = np.array(starts)[None, :] + np.arange(n)[:, None]  # rows of each key as a column
            x[at] = low_pass(x[at].reshape(n, -1), rate, cutoff_hz).reshape(n, len(starts), -1)
        out = pdf.drop(columns="_fps")
        for k, v in enumerate(values):
            out[v] = x[:, k]
        return out

    return by_key(narrow, keys, order, run, rows.schema)


def running_median(rows: DataFrame, keys: list[str], order: str, value: str, out: str, here: bool = True) -> DataFrame:
    """rows with ``out``, the median of a key's known values up to each row (here: its own among them), in log n steps a row; NULL before the first."""

    def run(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        values, found = pdf[value].to_numpy(dtype=float).tolist(), []
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            seen = RunningMedian()
            for v in values[a:b]:
                if not here:
                    found.append(seen.value())
                if v == v:
                    seen.add(v)
                if here:
                    found.append(seen.value())
        return pdf.assign(**{out: np.array(found, dtype=float)})

    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])
    return by_key(rows, keys, order, run, schema)


def filtered_in_time(rows: DataFrame, keys: list[str], order: str, values: list[str], fps: str, cutoff_hz: float | None, stride: str | None = None) -> DataFrame:
    """``filtered`` by the clock instead of by rows: a step of the filter is a step of the order.

    Absent steps between the first and the last row of a key are filled along
    the line between their neighbours while the filter runs and are absent again
    afterwards. fps names the column with the steps per second; where rows come
    only every so many steps, the column ``stride`` says how many, and the filter
    runs at that rate. Rows off that grid are steps of their own.
    """
    if cutoff_hz is None:
        return rows
    every = F.lit(1) if stride is None else F.first(stride)
    span = rows.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b"), every.cast("bigint").alias("_every"), (F.first(fps) / every).alias("_rate"))
    steps = span.select(*keys, "_rate", F.explode(F.expr("sequence(_a, _b, _every)")).alias(order))
    dense = steps.join(rows.withColumn("_here", F.lit(True)), [*keys, order], "full")
    out = filtered(dense, keys, order, values, F.col("_rate"), cutoff_hz)
    return out.where("_here").select(*rows.columns)


def rates(clips: DataFrame) -> DataFrame:
    """clip_id, fps and the stride of the clip's frames (1 where the clips do not say)."""
    return clips.select("clip_id", "fps", (F.col("frame_stride") if "frame_stride" in clips.columns else F.lit(1)).alias("frame_stride"))


def smoothed(rows: DataFrame, keys: list[str], order: str, values: list[str], cutoff_hz: float | None, even_time: bool) -> DataFrame:
    """rows (with fps and frame_stride) low-passed by rows or by the clock; the stride has done its duty."""
    done = filtered_in_time(rows, keys, order, values, "fps", cutoff_hz, "frame_stride") if even_time else filtered(rows, keys, order, values, F.col("fps"), cutoff_hz)
    return done.drop("frame_stride")
