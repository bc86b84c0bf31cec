"""Ordered-series operators for keys that are too long for one task.

A key of more than ``slice_rows`` rows is cut into slices of even width along
its order. Windows work inside a slice; what a slice has to know of the ones
before and behind it (the rows at its edges, how much has been counted, the
last known value) is a row for each slice, computed by windows over that small
table and joined back. So the work of one key is shared by as many tasks as it
has slices, and results are those of ``operators.series``.

Orders are numbers that lie about evenly, as frames and clock ticks do; rows
where they are crowded share a slice. The order tells rows of a key apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideframe.functions.signal import PAD, low_pass_piece
from strideframe.operators import series

SLICE_ROWS = 1_000_000
#: What a low-pass may still remember of its start where a piece begins, as a share of the signal.
FORGOTTEN = 1e-15


def cut(rows: DataFrame, keys: list[str], order: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``_slice``, 0 for keys of up to ``slice_rows`` rows.

    Only longer keys have a row in what is broadcast, so it has no more rows
    than the table divided by ``slice_rows``.
    """
    long = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_a"), F.max(order).alias("_b")).where(F.col("_n") > slice_rows)
    width = (F.col("_b") - F.col("_a") + 1) / F.ceil(F.col("_n") / slice_rows)
    found = rows.join(F.broadcast(long.select(*keys, "_a", width.alias("_width"))), keys, "left")
    return found.withColumn("_slice", F.coalesce(F.floor((F.col(order) - F.col("_a")) / F.col("_width")), F.lit(0))).drop("_a", "_width")


@dataclass
class Cut:
    """A table cut into slices, and what its slices have to know of each other.

    ``told`` are aggregates of a slice; ``carried`` are Columns over them, by the
    windows ``before`` (the slices before one) and ``after`` (those behind it).
    """

    rows: DataFrame
    keys: list[str]
    order: str
    slice_rows: int = SLICE_ROWS
    told: dict[str, Column] = field(default_factory=dict)
    carried: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if "_slice" not in self.rows.columns:
            self.rows = cut(self.rows, self.keys, self.order, self.slice_rows)

    @property
    def own(self) -> WindowSpec:
        """A slice's rows in order."""
        return Window.partitionBy(*self.keys, "_slice").orderBy(self.order)

    @property
    def before(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)

    def met(self) -> DataFrame:
        """The rows beside what their slice has been told."""
        slices = self.rows.groupBy(*self.keys, "_slice").agg(*[c.alias(n) for n, c in self.told.items()])
        slices = slices.select(*self.keys, "_slice", *[c.alias(n) for n, c in self.carried.items()])
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*self.keys, "_slice")]
        return self.rows.alias("l").join(slices.alias("r"), same, "left").select("l.*", *[f"r.{n}" for n in self.carried])


def with_neighbours(rows: DataFrame, keys: list[str], order: str, values: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``before`` and ``after``: structs of the order and the values in the row before and behind (NULL at the ends)."""
    at = Cut(rows, keys, order, slice_rows)
    row = F.struct(order, *values)
    at.rows = at.rows.withColumns({"_back": F.lag(row).over(at.own), "_ahead": F.lead(row).over(at.own)})
    at.told = {"first": F.min_by(row, order), "last": F.max_by(row, order)}
    at.carried = {"_last": F.last("last", ignorenulls=True).over(at.before), "_first": F.first("first", ignorenulls=True).over(at.after)}
    return at.met().withColumns({"before": F.coalesce("_back", "_last"), "after": F.coalesce("_ahead", "_first")}).drop("_back", "_ahead", "_last", "_first", "_slice")


def _beside(value: str) -> tuple[Column, Column, Column]:
    return F.col(value), F.col(f"before.{value}"), F.col(f"after.{value}")


def gradient(rows: DataFrame, keys: list[str], order: str, value: str, at: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``: ``series.gradient`` of a value over the column ``at``."""
    met = with_neighbours(rows, keys, order, [c for c in dict.fromkeys((value, at)) if c != order], slice_rows)
    return met.withColumn(out, series.quotient(*_beside(value), *_beside(at))).drop("before", "after")


def uniform_gradient(rows: DataFrame, keys: list[str], order: str, value: str, step: float, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``: ``series.uniform_gradient`` of a value."""
    return with_neighbours(rows, keys, order, [value], slice_rows).withColumn(out, series.central(*_beside(value), F.lit(float(step)))).drop("before", "after")


def step_length(rows: DataFrame, keys: list[str], order: str, x: str, y: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``: ``series.step_length`` of a point."""
    met = with_neighbours(rows, keys, order, [x, y], slice_rows)
    return met.withColumn(out, F.coalesce(F.hypot(F.col(x) - F.col(f"before.{x}"), F.col(y) - F.col(f"before.{y}")), F.lit(0.0))).drop("before", "after")


def local_peaks(rows: DataFrame, keys: list[str], order: str, value: str, threshold: float, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``: ``series.local_peak`` of a value."""
    v, back, ahead = _beside(value)
    return with_neighbours(rows, keys, order, [value], slice_rows).withColumn(out, F.coalesce((v >= threshold) & (v >= back) & (v > ahead), F.lit(False))).drop("before", "after")


def counted(rows: DataFrame, keys: list[str], order: str, amount: Column, out: str, slice_rows: int = SLICE_ROWS, ties: bool = False) -> DataFrame:
    """rows with ``out``, the sum of a whole amount over a key's rows up to each one (ties: up to the last one of its order)."""
    at = Cut(rows.withColumn("_amount", amount), keys, order, slice_rows)
    until = at.own.rangeBetween(Window.unboundedPreceding, 0) if ties else at.own.rowsBetween(Window.unboundedPreceding, 0)
    at.rows = at.rows.withColumn("_sum", F.sum("_amount").over(until))
    at.told, at.carried = {"sum": F.sum("_amount")}, {"_offset": F.sum("sum").over(at.before)}
    return at.met().withColumn(out, F.coalesce("_sum", F.lit(0)) + F.coalesce("_offset", F.lit(0))).drop("_amount", "_sum", "_offset", "_slice")


def numbered(rows: DataFrame, keys: list[str], order: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``, their place in the key from 0."""
    return counted(rows, keys, order, F.lit(1), out, slice_rows).withColumn(out, F.col(out) - 1)


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``island``: ``series.islands`` of a flag; a run may go through any number of slices."""
    met = with_neighbours(rows.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, order, ["_flag"], slice_rows)
    begins = F.when(F.col("_flag") & ~F.coalesce("before._flag", F.lit(False)), 1).otherwise(0)
    out = counted(met.withColumn("_begins", begins).drop("before", "after"), keys, order, F.col("_begins"), "_run", slice_rows)
    return out.withColumn("island", F.when(F.col("_flag"), F.col("_run"))).drop("_flag", "_begins", "_run")


def with_known(rows: DataFrame, keys: list[str], order: str, value: Column, at: Column, slice_rows: int = SLICE_ROWS, here: bool = True) -> DataFrame:
    """rows with ``back`` and ``ahead``: structs (at, v) of the nearest known values at or before a row and at or behind it.

    here: whether the row's own value counts.
    """
    cut_rows = Cut(rows.withColumn("_mark", F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("v")))), keys, order, slice_rows)
    along, against = cut_rows.own, Window.partitionBy(*keys, "_slice").orderBy(F.desc(order))
    end = 0 if here else -1
    nearest = lambda w: F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    cut_rows.rows = cut_rows.rows.withColumns({"_back": nearest(along), "_ahead": nearest(against)})
    known = F.col("_mark").isNotNull()
    cut_rows.told = {"first": F.min_by("_mark", F.when(known, F.col(order))), "last": F.max_by("_mark", F.when(known, F.col(order)))}
    cut_rows.carried = {"_last": F.last("last", ignorenulls=True).over(cut_rows.before), "_first": F.first("first", ignorenulls=True).over(cut_rows.after)}
    return cut_rows.met().withColumns({"back": F.coalesce("_back", "_last"), "ahead": F.coalesce("_ahead", "_first")}).drop("_mark", "_back", "_ahead", "_last", "_first", "_slice")


def interpolated(rows: DataFrame, keys: list[str], order: str, value: str, at: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with ``out``: ``series.interpolated`` of a value over the column ``at``; a gap may go through any number of slices."""
    met = with_known(rows, keys, order, F.col(value), F.col(at), slice_rows)
    return met.withColumn(out, series.between(F.col(value), F.col(at), F.col("back"), F.col("ahead"))).drop("back", "ahead")


def memory(fps: Column, cutoff_hz: float, forgotten: float = FORGOTTEN) -> Column:
    """Rows after which the low-pass has forgotten its start.

    What is left of it shrinks in each row by the size of the pole that is
    nearest to the unit circle: of the analogue poles the one nearest to the
    imaginary axis, brought over by the bilinear transform.
    """
    warped = 4 * F.tan(math.pi * cutoff_hz / fps)
    real, imaginary = -warped * math.cos(3 * math.pi / 8), warped * math.sin(3 * math.pi / 8)
    size = F.sqrt(((4 + real) * (4 + real) + imaginary * imaginary) / ((4 - real) * (4 - real) + imaginary * imaginary))
    return F.ceil(F.log(F.lit(forgotten)) / F.log(size)).cast("bigint")


def filtered(rows: DataFrame, keys: list[str], order: str, values: list[str], fps: Column, cutoff_hz: float | None, piece_rows: int = 200_000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows after ``series.filtered``, the zero-phase low-pass, a piece of a key at a time.

    A piece comes with as many rows of its neighbours as the filter remembers
    (``memory``); forward and backward pass run through all of them and only the
    piece's own rows are kept. What the pieces differ by from one pass over the
    whole key is some FORGOTTEN of the signal and the rounding of a sum of as
    many terms as the filter remembers. Gaps are filled beforehand, over the
    whole key, and are gaps again afterwards. A series too short for the
    filter, or a cutoff too high, leaves the values as they are.
    """
    if cutoff_hz is None:
        return rows
    full = numbered(rows.withColumn("_fps", fps.cast("double")), keys, order, "_i", slice_rows)
    for v in values:
        full = interpolated(full, keys, order, v, "_i", f"_full_{v}", slice_rows)
    # Rows of a key are counted by its slices, so a key is never one task.
    at = Cut(full, keys, order, slice_rows, {"n": F.count("*")}, {"_n": F.sum("n").over(Window.partitionBy(*keys))})
    full = at.met().drop("_slice")
    works = (F.col("_n") > PAD) & (F.col("_fps") > 2 * cutoff_hz)
    remembered = F.when(works, memory(F.col("_fps"), cutoff_hz) + PAD).otherwise(0)
    full = full.withColumn("_m", remembered).withColumn("_long", F.greatest(F.lit(piece_rows), "_m"))
    home, place = F.expr("_i div _long"), F.expr("_i % _long")
    goes = F.array(home, F.when((place < F.col("_m")) & (home > 0), home - 1), F.when(place >= F.col("_long") - F.col("_m"), home + 1))
    pieces = full.withColumn("_home", home).withColumn("_piece", F.explode(F.array_compact(goes)))
    schema, needed = rows.schema, [*rows.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = (pdf["_home"] == pdf["_piece"]).to_numpy()
        if own.any() and pdf["_m"].iloc[0] > 0:
            x = pdf[[f"_full_{v}" for v in values]].to_numpy(dtype=float)
            starts, ends = pdf["_i"].iloc[0] == 0, pdf["_i"].iloc[-1] == pdf["_n"].iloc[0] - 1
            done = low_pass_piece(x, float(pdf["_fps"].iloc[0]), cutoff_hz, bool(starts), bool(ends))
            for k, v in enumerate(values):
                pdf[v] = pd.Series(done[:, k], index=pdf.index).where(pdf[v].notna())
        return pdf.loc[own, needed]

    return pieces.groupBy(*keys, "_piece").applyInPandas(run, schema)
