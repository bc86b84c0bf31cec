"""The ready position: measures of one frame and the frame to measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.operators import series
from strideframe.operators.features import usable
from strideframe.schema import FRAME, TRACK

# Customary ranges of a ready position.
KNEE, WIDTH, FLEXION, HANDS = (130.0, 165.0), (0.9, 1.7), (5.0, 30.0), -0.02
#: Short names of what can be said about a stance.
FLAGS = {"no_height": "height unknown", "legs_straight": "knees too straight", "legs_deep": "knees too bent", "feet_narrow": "feet too close", "feet_wide": "feet too far apart", "trunk_upright": "trunk too upright", "trunk_folded": "trunk too far forward", "hands_low": "hands below the hips"}


def stance(features: DataFrame) -> DataFrame:
    """Stance measures of every feature row."""
    by_shoulders = lambda c: F.when(F.col("shoulder_px") > 0, F.col(c) / F.col("shoulder_px"))
    tall = F.col("height_px")
    ok = F.coalesce(tall > 0, F.lit(False))
    left, right = F.col("left_knee_deg"), F.col("right_knee_deg")
    measures = {
        "stance_width_ratio": by_shoulders("ankle_gap_px"),
        "hand_width_ratio": by_shoulders("wrist_gap_px"),
        "mean_knee_deg": F.coalesce((left + right) / 2, left, right),
        "trunk_lean_deg": F.col("lean_deg"),
        "trunk_flexion_deg": F.abs("lean_deg"),
        "hand_height_ratio": g.by_height(F.col("midhip_y") - F.col("mean_wrist_y"), tall),
        "com_height_ratio": g.by_height(F.col("ankle_y") - F.col("com_y"), tall),
    }
    angles = ["left_knee_deg", "right_knee_deg", "left_hip_deg", "right_hip_deg"]
    out = features.select(*TRACK, FRAME, "height_px", *[F.when(ok, c).alias(n) for n, c in measures.items()], *[F.when(ok, F.col(c)).alias(c) for c in angles])
    return out.withColumn("is_valid", ok & F.col("stance_width_ratio").isNotNull())


def with_flags(stances: DataFrame) -> DataFrame:
    """Adds ``flags``, the names of what is outside the customary ranges."""
    outside = lambda c, low, high, bounds: [F.when(F.col(c) > bounds[1], F.lit(high)), F.when(F.col(c) < bounds[0], F.lit(low))]
    checks = [F.when(F.col("height_px").isNull(), F.lit("no_height")), *outside("mean_knee_deg", "legs_deep", "legs_straight", KNEE), *outside("stance_width_ratio", "feet_narrow", "feet_wide", WIDTH), *outside("trunk_flexion_deg", "trunk_upright", "trunk_folded", FLEXION), F.when(F.col("hand_height_ratio") < HANDS, F.lit("hands_low"))]
    return stances.withColumn("flags", F.array_compact(F.array(*checks)))


def set_positions(features: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """clip_id, track_id, frame_index of the stillest low frame before the fastest step of each track.

    Without an explicit window only frames before the fastest step count, if at
    least three precede it. Tracks with under three usable rows give none.
    """
    rows = usable(features)
    if window is not None:
        rows = rows.where(F.col(FRAME).between(*window))
    w, whole = series.over(TRACK, FRAME), Window.partitionBy(*TRACK)
    rows = rows.withColumns({"n": F.count("*").over(whole), "i": series.number(TRACK, FRAME), "reference_px": F.expr("percentile(height_px, 0.5)").over(whole)}).where("n >= 3")
    rows = rows.withColumns({"step": series.step_length(F.col("com_x"), F.col("com_y"), w) / F.col("reference_px"), "depth": F.col("com_y") / F.col("reference_px")})
    rows = rows.withColumn("cost", F.col("step") - 0.05 * (F.col("depth") - F.avg("depth").over(whole)))
    fastest = F.max_by("i", F.struct("step", -F.col("i"))).over(whole)
    if window is None:
        rows = rows.withColumn("fastest", fastest).where("fastest < 3 or i < fastest")
    return rows.groupBy(*TRACK).agg(F.min_by(F.struct(FRAME, "cost"), F.struct("cost", "i")).alias("b")).select(*TRACK, "b.*")
