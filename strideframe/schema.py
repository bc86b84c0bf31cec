"""Schemas of the engine's tables; NaN never enters them, absence is NULL."""

from __future__ import annotations

KEYPOINT = "struct<x: double, y: double, conf: double>"
BOX = "struct<x1: double, y1: double, x2: double, y2: double, score: double>"
CLIPS = "clip_id bigint, path string, width int, height int, fps double, frame_count bigint, rotation int, codec string, duration_s double"
DETECTIONS = f"clip_id bigint, frame_index bigint, ts double, det_id int, kp array<{KEYPOINT}>, bbox {BOX}"
GOALS = "clip_id bigint, lx double, ly double, rx double, ry double, crossbar_y double"
CALIBRATIONS = "clip_id bigint, h array<double>, reproj_err_px double, n_points bigint"
SHOTS = "clip_id bigint, shot_time_s double"

#: What a track is keyed by, and the order of its rows.
TRACK = ["clip_id", "track_id"]
FRAME = "frame_index"


class StrideframeError(Exception):
    """What the engine itself refuses to do."""


class BackendNotAvailable(StrideframeError, RuntimeError):
    """The backend cannot run here."""


class ConfigError(StrideframeError, ValueError):
    """A setting that does not exist or does not fit."""
