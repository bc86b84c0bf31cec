"""Dives: bursts of the centre of mass with a leaning trunk, measured and cut into phases."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions.signal import RunningMedian
from strideframe.operators import series
from strideframe.operators.features import usable_columns
from strideframe.schema import FRAME, TRACK

SPEED, MIN_ROWS, LEAN, CUTOFF, FOOT_LIFT, QUIET = 1.2, 4, 25.0, 8.0, 0.04, 1.5


def dive_signals(features: DataFrame, clips: DataFrame, cutoff_hz: float | None = CUTOFF, even_time: bool = False) -> DataFrame:
    """Series that dives are found in: one row per usable frame of tracks with five or more.

    even_time: the low-pass goes by the clock, over gaps and at the rate that the clips' ``frame_stride`` leaves.
    """
    rows = usable_columns(features, "lean_deg", "midhip_y", "min_wrist_y", "ankle_y", "mean_conf").withColumn("raw_com_y", F.col("com_y")).join(series.rates(clips), "clip_id")
    whole, w = Window.partitionBy(*TRACK), series.over(TRACK, FRAME)
    path = series.smoothed(rows, TRACK, FRAME, ["com_x", "com_y"], cutoff_hz, even_time)
    path = path.withColumns({"n": F.count("*").over(whole), "i": series.number(TRACK, FRAME), "reference_px": F.expr("percentile(height_px, 0.5)").over(whole), "time_s": F.col(FRAME) / F.col("fps")}).where("n >= 5")
    speed = {a: series.gradient(F.col(f"com_{a}"), F.col("time_s"), w) / F.col("reference_px") for a in "xy"}
    return path.withColumns({"vx": speed["x"], "vy": speed["y"]}).withColumns({
        "speed": F.hypot("vx", "vy"),
        "reach_bh": (F.col("midhip_y") - F.col("min_wrist_y")) / F.col("reference_px"),
        "com_h_bh": (F.col("ankle_y") - F.col("raw_com_y")) / F.col("reference_px"),
        "ankle_bh": F.col("ankle_y") / F.col("reference_px"),
    })


def direction(lateral: Column) -> Column:
    return F.when(lateral.isNull() | (F.abs(lateral) < 0.15), "centre").when(lateral > 0, "right").otherwise("left")


def height_class(lowest: Column, reach: Column) -> Column:
    """low, mid or high by the lowest centre of mass, or by the reach alone if that is unknown."""
    known = F.when(lowest < 0.20, "low").when((lowest > 0.40) & (reach.isNull() | (reach > 0.35)), "high").otherwise("mid")
    return F.when(lowest.isNotNull(), known).when(reach > 0.40, "high").when(reach < 0.10, "low").otherwise("mid")


DIVE = "{track}, fps double, reference_px double, start_frame bigint, end_frame bigint, peak_frame bigint, peak_speed_bh_s double, lateral_bh double, max_lean_deg double, peak_reach_bh double, lowest_bh double, confidence double, set_frame bigint, preparatory_start bigint, flight_start bigint"


def detect_dives(signals: DataFrame, goals: DataFrame | None = None, shots: DataFrame | None = None, speed: float = SPEED, min_rows: int = MIN_ROWS, min_lean: float = LEAN, size: tuple[float, float] = g.REGULAR) -> DataFrame:
    """One row per dive: span, peak, displacement, lean, reach, classes, phases, reaction time and notes.

    Signals are read once, tracks side by side: one pass over the rows of a
    track finds its dives and their phases in n log n steps, however many there are.
    """

    def run(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        columns = [rows[c].to_numpy(dtype=float) for c in _READ]
        frames, found = rows[FRAME].to_numpy(dtype=np.int64), []
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            dives = track_dives(*(c[a:b] for c in columns), frames[a:b], speed, min_rows, min_lean)
            found += [(rows[TRACK[0]].iloc[a], rows[TRACK[1]].iloc[a], *d) for d in dives]
        return pd.DataFrame(found, columns=names)

    schema = DIVE.format(track=", ".join(f"{c} {signals.schema[c].dataType.simpleString()}" for c in TRACK))
    names = [part.split()[0] for part in schema.split(", ")]
    out = series.by_key(signals.where("n >= 5").select(*TRACK, "i", FRAME, *_READ), TRACK, "i", run, schema)
    out = out.withColumns({"takeoff": F.col("start_frame"), "peak": F.col("peak_frame"), "landing": F.col("end_frame")})
    out = out.withColumns({"direction": direction(F.col("lateral_bh")), "height": height_class(F.col("lowest_bh"), F.col("peak_reach_bh")), "duration_s": (F.col("end_frame") - F.col("start_frame")) / F.col("fps"), "time_to_peak_s": (F.col("peak_frame") - F.col("start_frame")) / F.col("fps")})
    if goals is not None:
        out = out.join(goals.select("clip_id", "lx", "ly", "rx", "ry", "crossbar_y"), "clip_id", "left").withColumn("lateral_m", F.col("lateral_bh") * F.col("reference_px") / g.Goal.of(size=size).px_per_m).drop("lx", "ly", "rx", "ry", "crossbar_y")
    else:
        out = out.withColumn("lateral_m", F.lit(None).cast("double"))
    out = reaction_times(out, shots) if shots is not None else out.withColumn("reaction_time_s", F.lit(None).cast("double"))
    notes = [F.when(F.col("reaction_time_s") < 0.10, F.lit("early_reaction")), F.when(F.col("max_lean_deg").isNull(), F.lit("trunk_unseen")), F.when(F.col("confidence") < 0.5, F.lit("unsure_pose"))]
    return out.withColumn("notes", F.array_compact(F.array(*notes))).drop("lowest_bh")


_READ = ("fps", "reference_px", "speed", "com_x", "lean_deg", "reach_bh", "com_h_bh", "ankle_bh", "mean_conf")


def track_dives(fps: np.ndarray, reference: np.ndarray, v: np.ndarray, x: np.ndarray, lean: np.ndarray, reach: np.ndarray, lowest: np.ndarray, ankle: np.ndarray, conf: np.ndarray, frames: np.ndarray, speed: float, min_rows: int, min_lean: float) -> list[tuple]:
    """The dives of one track, whose rows are in order; columns of DIVE behind the track's."""
    fast = np.concatenate([[False], v >= speed, [False]])
    turns = np.flatnonzero(fast[1:] != fast[:-1])
    spans = turns.reshape(-1, 2)  # rows a..b - 1
    spans = spans[spans[:, 1] - spans[:, 0] >= min_rows]
    most_lean = _within(np.fmax, np.abs(lean), spans)
    spans, most_lean = spans[~(most_lean < min_lean)], most_lean[~(most_lean < min_lean)]
    known = ~np.isnan(conf)
    with np.errstate(invalid="ignore"):  # where no confidence is known
        sure = _within(np.add, np.where(known, conf, 0.0), spans) / _within(np.add, known.astype(float), spans)
    measures = [[None if x != x else x for x in column.tolist()] for column in (most_lean, _within(np.fmax, reach, spans), _within(np.fmin, lowest, spans), sure)]
    before, out = Before(len(v)), []
    for (a, b), top, *measured in zip(spans.tolist(), _within(np.maximum, v, spans).tolist(), *measures, strict=True):
        before.read(v, ankle, a)
        lifted = np.flatnonzero(ankle[a:b] < before.ground() - FOOT_LIFT)
        still, quiet = before.slowest(), before.last_quiet()
        row = (
            fps[a], reference[a], frames[a], frames[b - 1], frames[a + int(np.argmax(v[a:b]))], top, (x[b - 1] - x[a]) / reference[a], *measured,
            None if still is None else frames[still], frames[0 if quiet is None else quiet + 1], frames[a + lifted[0]] if len(lifted) else None,
        )
        out.append(row)
    return out


def _within(of: np.ufunc, values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """``of`` over the rows of each span, all spans in one pass; fmax and fmin pass over NaN."""
    return of.reduceat(np.append(values, np.nan), spans.ravel())[::2] if len(spans) else np.zeros(0)


class Before:
    """What a dive asks of the rows before it, each row read once.

    Rows slower than all behind them form a stack with rising speeds; the
    slowest row since some row and the last one that is slow enough are found
    in it by bisection.
    """

    def __init__(self, rows: int):
        self.tenth, self.at = round(rows * 0.1) + 1, 0
        self.speeds, self.ankles = RunningMedian(), RunningMedian()
        self.slow: list[float] = []
        self.rows: list[int] = []

    def read(self, speed: np.ndarray, ankle: np.ndarray, end: int) -> None:
        for i, v, height in zip(range(self.at, end), speed[self.at : end].tolist(), ankle[self.at : end].tolist(), strict=True):
            if v == v:
                self.speeds.add(v)
                while self.slow and self.slow[-1] > v:
                    self.slow.pop()
                    self.rows.pop()
                self.slow.append(v)
                self.rows.append(i)
            if height == height:
                self.ankles.add(height)
        self.at = end

    def ground(self) -> float:
        """Median height of the ankles until now."""
        return self.ankles.value()

    def slowest(self) -> int | None:
        """The slowest row (the first of equal ones) of the tenth of the track before now."""
        k = bisect.bisect_left(self.rows, self.at - self.tenth)
        return self.rows[k] if k < len(self.rows) else None

    def last_quiet(self) -> int | None:
        """The last row that is no faster than QUIET times the median speed until now."""
        middle = self.speeds.value()
        k = bisect.bisect_right(self.slow, QUIET * middle if middle == middle else 0.0)
        return self.rows[k - 1] if k else None


def reaction_times(dives: DataFrame, shots: DataFrame) -> DataFrame:
    """Seconds since the clip's latest shot at or before the dive's start."""
    timed = series.asof(dives.withColumn("_start", F.col("start_frame") / F.col("fps")), shots, ["clip_id"], "_start", "shot_time_s", "_shot")
    return timed.withColumn("reaction_time_s", F.col("_start") - F.col("_shot")).drop("_start", "_shot")


def phase_of(frame: Column) -> Column:
    """The phase a frame of a dive is in: the latest boundary it has reached."""
    out = F.lit("dive")
    for name, boundary in (("set", "set_frame"), ("preparatory", "preparatory_start"), ("takeoff", "takeoff"), ("flight", "flight_start"), ("landing", "landing")):
        out = F.when(frame >= F.col(boundary), F.lit(name)).otherwise(out)
    return out


def frames_in_dives(frames: DataFrame, dives: DataFrame) -> DataFrame:
    """Frames of a track that fall into one of its dives, with the phase.

    Dives of a track do not overlap, so the one that began last is the only one
    a frame can be in: both meet in one ordered window, and no frame is
    multiplied by the dives of its track.
    """
    at = dives.select(*TRACK, *_PHASES, "end_frame", "start_frame")
    met = series.latest(frames, at, TRACK, FRAME, "start_frame", [*_PHASES, "start_frame", "end_frame"])
    return met.where(F.col(FRAME) <= F.col("end_frame")).withColumn("phase", phase_of(F.col(FRAME)))


_PHASES = ("set_frame", "preparatory_start", "takeoff", "flight_start", "landing")


def dive_table(dives: DataFrame) -> DataFrame:
    """Rounded rows for display (halves go to the even digit)."""
    r = lambda c, n: F.bround(c, n).alias(c)
    return dives.select(*TRACK, F.bround(F.col("start_frame") / F.col("fps"), 3).alias("start_s"), r("duration_s", 3), "direction", "height", r("peak_speed_bh_s", 2), F.bround("lateral_bh", 2).alias("lateral_bh"), r("max_lean_deg", 1), r("confidence", 2))
