"""Skeleton layouts and the gather from one layout to the canonical joints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Joint names in their public orders.
COCO17 = ("nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
MEDIAPIPE33 = ("nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye", "right_eye_outer", "left_ear", "right_ear", "mouth_left", "mouth_right", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_pinky", "right_pinky", "left_index", "right_index", "left_thumb", "right_thumb", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle", "left_heel", "right_heel", "left_foot_index", "right_foot_index")
HALPE26 = (*COCO17, "head", "neck", "hip", "left_big_toe", "right_big_toe", "left_small_toe", "right_small_toe", "left_heel", "right_heel")
EDGES17 = ((0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16))

NOSE, L_SHOULDER, R_SHOULDER, L_WRIST, R_WRIST, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE = 0, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16


@dataclass(frozen=True)
class Layout:
    """A named order of joints."""

    name: str
    joints: tuple[str, ...]

    def gather(self) -> list[int]:
        """Index of each canonical joint in this layout, -1 where it has none."""
        return [self.joints.index(j) if j in self.joints else -1 for j in COCO17]


LAYOUTS = {layout.name: layout for layout in (Layout("coco17", COCO17), Layout("mediapipe33", MEDIAPIPE33), Layout("halpe26", HALPE26))}


def layout(name: str) -> Layout:
    if name not in LAYOUTS:
        raise KeyError(f"no layout {name!r}; there are {', '.join(sorted(LAYOUTS))}")
    return LAYOUTS[name]


def to_canonical(kp: Column, name: str) -> Column:
    """Canonical keypoints of an array in another layout; a joint it lacks has no place and confidence 0."""
    missing = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("conf"))
    return F.array(*[F.coalesce(F.get(kp, F.lit(i)), missing) if i >= 0 else missing for i in layout(name).gather()])


def joints_table(spark):  # noqa: ANN001, ANN201
    """The joints of all layouts as a small dimension: layout, idx, joint, canonical_idx."""
    rows = [(n, i, j, COCO17.index(j) if j in COCO17 else None) for n, one in LAYOUTS.items() for i, j in enumerate(one.joints)]
    return spark.createDataFrame(rows, "layout string, idx int, joint string, canonical_idx int")
