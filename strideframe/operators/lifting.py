"""Smoothing of 3D keypoints along a track."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strideframe.functions.signal import low_pass
from strideframe.schema import FRAME, TRACK, BackendNotAvailable

MIN_ROWS = 10


def smooth(tracked: DataFrame, clips: DataFrame, cutoff_hz: float | None = 6.0) -> DataFrame:
    """tracked with low-passed kp3d where a track has ten or more frames of it; others stay as they are."""
    if cutoff_hz is None:
        return tracked

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(FRAME, ignore_index=True)
        have = [i for i, k in enumerate(pdf["kp3d"]) if k is not None and len(k)]
        if len(have) >= MIN_ROWS and len({len(pdf["kp3d"][i]) for i in have}) == 1:
            flat = np.array([[np.nan if k[c] is None else k[c] for k in pdf["kp3d"][i] for c in "xyz"] for i in have], dtype=float)
            out = low_pass(flat, float(pdf["fps"].iloc[0]), cutoff_hz).reshape(len(have), -1, 3)
            column = list(pdf["kp3d"])
            for i, joints in zip(have, out, strict=True):
                column[i] = [{c: None if np.isnan(v) else float(v) for c, v in zip("xyz", j, strict=True)} for j in joints]
            pdf["kp3d"] = column
        return pdf.drop(columns="fps")

    return tracked.where("track_id is not null").join(clips.select("clip_id", "fps"), "clip_id").groupBy(*TRACK).applyInPandas(run, tracked.schema)


def monocular(tracked: DataFrame, clips: DataFrame, cutoff_hz: float | None = 6.0) -> DataFrame:
    raise BackendNotAvailable("lifting 2D poses needs a learned model, which is not part of the engine")


#: Lifters by name: they take tracked rows, clips and a cutoff.
LIFTERS: dict[str, Callable[[DataFrame, DataFrame, float | None], DataFrame]] = {"passthrough": smooth, "monocular": monocular}


def lifter(name: str = "passthrough") -> Callable[[DataFrame, DataFrame, float | None], DataFrame]:
    if name not in LIFTERS:
        raise KeyError(f"no lifter {name!r}; there are {', '.join(sorted(LIFTERS))}")
    return LIFTERS[name]
