"""The per-frame feature row: everything later stages need, computed in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions import skeleton as sk
from strideframe.schema import FRAME, TRACK


def _at(kp: Column, i: int) -> g.Point:
    return g.joint(kp, i, g.USABLE)


def pose_features(detections: DataFrame) -> DataFrame:
    """clip_id, track_id, frame_index and the features of each detection with a track."""
    kp = F.col("kp")
    ls, rs, lw, rw, lh, rh, lk, rk, la, ra = (_at(kp, i) for i in (sk.L_SHOULDER, sk.R_SHOULDER, sk.L_WRIST, sk.R_WRIST, sk.L_HIP, sk.R_HIP, sk.L_KNEE, sk.R_KNEE, sk.L_ANKLE, sk.R_ANKLE))
    trunk = ls.there & rs.there & lh.there & rh.there
    shoulders, hips = g.midpoint(ls, rs, both=True), g.midpoint(lh, rh, both=True)
    com, feet = g.centre_of_mass(kp), g.feet(kp)
    keep = lambda c: F.when(trunk, c)
    return detections.where("track_id is not null").select(
        *TRACK,
        FRAME,
        "kp",
        com.x.alias("com_x"),
        com.y.alias("com_y"),
        g.stature(kp).alias("height_px"),
        keep(g.lean(hips, shoulders)).alias("lean_deg"),
        keep(hips.y).alias("midhip_y"),
        F.least(lw.y, rw.y).alias("min_wrist_y"),
        F.coalesce((lw.y + rw.y) / 2, lw.y, rw.y).alias("mean_wrist_y"),
        feet.y.alias("ankle_y"),
        feet.x.alias("feet_x"),
        feet.y.alias("feet_y"),
        g.mean_confidence(kp).alias("mean_conf"),
        F.when(ls.there & rs.there, ls.distance(rs)).alias("shoulder_px"),
        la.distance(ra).alias("ankle_gap_px"),
        keep(lw.distance(rw)).alias("wrist_gap_px"),
        g.angle(lh, lk, la).alias("left_knee_deg"),
        g.angle(rh, rk, ra).alias("right_knee_deg"),
        g.angle(ls, lh, lk).alias("left_hip_deg"),
        g.angle(rs, rh, rk).alias("right_hip_deg"),
    )


def usable(features: DataFrame) -> DataFrame:
    """Rows with a centre of mass and a height."""
    return features.where("com_x is not null and com_y is not null and height_px > 0")


def usable_columns(features: DataFrame, *columns: str) -> DataFrame:
    """Track, frame and some columns of the rows with a centre of mass and a height.

    A generator stands between, or else the optimiser would test the rows by
    writing the formulas of what it tests out a second time.
    """
    named = dict.fromkeys(("com_x", "com_y", "height_px", *columns))
    return usable(features.select(*TRACK, FRAME, F.inline(F.array(F.struct(*named)))))


def with_reference(rows: DataFrame, height: str = "height_px", by: list[str] | None = None) -> DataFrame:
    """Adds ``reference_px``, the median height of each track."""
    by = by or TRACK
    return rows.join(rows.groupBy(*by).agg(F.median(height).alias("reference_px")), by)


def canonical(detections: DataFrame, layout: str) -> DataFrame:
    """Detections of another layout as canonical ones."""
    return detections.withColumn("kp", sk.to_canonical(F.col("kp"), layout))
