"""Image to pitch: landmark lookup, homography fit and projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions.signal import fit_homography, fit_robust_homography

RELIABLE_PX = 5.0


# Named points of the pitch in metres from the centre spot.
LANDMARKS = (
    ("centre_spot", 0.0, 0.0),
    ("centre_circle_top", 0.0, 9.15),
    ("centre_circle_bottom", 0.0, -9.15),
    ("halfway_top", 0.0, 34.0),
    ("halfway_bottom", 0.0, -34.0),
    ("left_goal_centre", -52.5, 0.0),
    ("left_post_top", -52.5, 3.66),
    ("left_post_bottom", -52.5, -3.66),
    ("left_penalty_spot", -41.5, 0.0),
    ("left_box_top_corner", -52.5, 20.16),
    ("left_box_bottom_corner", -52.5, -20.16),
    ("left_box_top_edge", -36.0, 20.16),
    ("left_box_bottom_edge", -36.0, -20.16),
    ("left_six_top_corner", -52.5, 9.16),
    ("left_six_bottom_corner", -52.5, -9.16),
    ("left_six_top_edge", -47.0, 9.16),
    ("left_six_bottom_edge", -47.0, -9.16),
    ("corner_top_left", -52.5, 34.0),
    ("corner_bottom_left", -52.5, -34.0),
    ("corner_top_right", 52.5, 34.0),
    ("corner_bottom_right", 52.5, -34.0),
)


def landmarks(spark: SparkSession) -> DataFrame:
    """The fixed points as a small dimension."""
    return spark.createDataFrame(list(LANDMARKS), "landmark string, pitch_x double, pitch_y double")


def located(clicks: DataFrame, points: DataFrame) -> DataFrame:
    """clicks (clip_id, landmark, image_x, image_y) with their pitch points; unknown names are left out."""
    return clicks.join(F.broadcast(points), "landmark")  # a fixed table of 21 rows


def unknown(clicks: DataFrame, points: DataFrame) -> DataFrame:
    """Names that no landmark has."""
    return clicks.join(F.broadcast(points), "landmark", "left_anti").select("clip_id", "landmark").distinct()


def fit(pairs: DataFrame, robust_px: float | None = None) -> DataFrame:
    """Homography of each clip from (image_x, image_y, pitch_x, pitch_y): h, reproj_err_px, n_points, reliable.

    Clips with under four points or a singular fit have a NULL h. The few points of a clip are one group.
    With ``robust_px`` points that a fit of most others misses by more than that are left out; n_points counts those used.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, pitch = pdf[["image_x", "image_y"]].to_numpy(float), pdf[["pitch_x", "pitch_y"]].to_numpy(float)
        if robust_px is not None:
            image, pitch = fit_robust_homography(image, pitch, robust_px)
        h = fit_homography(image, pitch)
        err = None
        if h is not None:
            back = np.column_stack([pitch, np.ones(len(pitch))]) @ np.linalg.inv(h).T
            err = float(np.nanmean(np.linalg.norm(back[:, :2] / back[:, 2:] - image, axis=1)))
        return pd.DataFrame({"clip_id": pdf["clip_id"].iloc[:1], "h": [None if h is None else h.ravel().tolist()], "reproj_err_px": [err], "n_points": [len(image)]})

    found = pairs.where("image_x is not null and image_y is not null and pitch_x is not null and pitch_y is not null").groupBy("clip_id").applyInPandas(run, "clip_id bigint, h array<double>, reproj_err_px double, n_points bigint")
    return found.withColumn("reliable", F.coalesce(F.col("reproj_err_px") < RELIABLE_PX, F.lit(False)))


def to_pitch(rows: DataFrame, calibrations: DataFrame, x: str = "feet_x", y: str = "feet_y") -> DataFrame:
    """rows with pitch_x and pitch_y of a point; NULL without a calibration (one row a clip)."""
    joined = rows.join(calibrations.select("clip_id", "h"), "clip_id", "left")
    h = [F.get("h", F.lit(i)) for i in range(9)]
    p = g.project(h, g.columns(x, y))
    return joined.withColumns({"pitch_x": p.x, "pitch_y": p.y}).drop("h")


def ground_distance(rows: DataFrame, calibrations: DataFrame, a: tuple[str, str], b: tuple[str, str], out: str = "distance_m") -> DataFrame:
    """rows with the distance on the ground, in metres, of two image points; NULL without a calibration or at its horizon."""
    joined = rows.join(calibrations.select("clip_id", "h"), "clip_id", "left")
    h = [F.get("h", F.lit(i)) for i in range(9)]
    return joined.withColumn(out, g.project(h, g.columns(*a)).distance(g.project(h, g.columns(*b)))).drop("h")


def records(calibrations: DataFrame) -> DataFrame:
    """clip_id and one JSON record of each calibration: homography by rows, error, reliable, number of points."""
    rows = F.array(*[F.slice("h", 3 * i + 1, 3) for i in range(3)])
    fields = F.struct(F.when(F.col("h").isNotNull(), rows).alias("homography"), F.col("reproj_err_px").alias("reprojection_error_px"), F.col("reliable").alias("is_reliable"), F.col("n_points").alias("num_points"))
    return calibrations.select("clip_id", F.to_json(fields).alias("value"))


def goal_records(goals: DataFrame, size: tuple[float, float] = g.REGULAR) -> DataFrame:
    """clip_id and one JSON record of each goal: posts, crossbar, size and scale."""
    goal = g.Goal.of(size=size)
    fields = F.struct(F.array(goal.lx, goal.ly).alias("left_post"), F.array(goal.rx, goal.ry).alias("right_post"), F.col("crossbar_y"), F.lit(size[0]).alias("width_m"), F.lit(size[1]).alias("height_m"), goal.px_per_m.alias("px_per_m"), goal.consistency.alias("scale_consistency"))
    return goals.select("clip_id", F.to_json(fields).alias("value"))
