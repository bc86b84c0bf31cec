"""Clip metadata: derived columns, device guess, processing profile and capture advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, longest edge (none: native), stride, model complexity, several people, smoothing frames.
PROFILES = (("fast", 640, 2, 0, False, 3), ("balanced", 1280, 1, 1, True, 5), ("accurate", None, 1, 2, True, 3))
# Key, system, codec, field of view, rolling shutter, profile.
DEVICES = (
    ("iphone_recent", "ios", "hevc", 69.0, "low", "balanced"),
    ("iphone_older", "ios", "h264", 65.0, "moderate", "balanced"),
    ("android_flagship", "android", "h264", 70.0, "low", "balanced"),
    ("android_midrange", "android", "h264", 72.0, "high", "fast"),
    ("action_cam", "other", "hevc", 118.0, "moderate", "balanced"),
    ("generic", "unknown", "h264", 70.0, "moderate", "balanced"),
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "profile string, target_long_edge int, frame_stride int, model_complexity int, multi_person boolean, smoothing_window int")


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEVICES), "device string, os string, device_codec string, fov_deg double, rolling_shutter string, profile string")


def with_display(clips: DataFrame) -> DataFrame:
    """Adds the size as shown, portrait and high-speed marks; quarter turns swap the sides."""
    turned = F.pmod("rotation", F.lit(360)).isin(90, 270)
    shown = clips.withColumns({"display_width": F.when(turned, F.col("height")).otherwise(F.col("width")), "display_height": F.when(turned, F.col("width")).otherwise(F.col("height"))})
    return shown.withColumns({"is_portrait": F.col("display_height") > F.col("display_width"), "is_high_speed": F.col("fps") >= 100})


def device_of() -> Column:
    """The device class that codec, size and frame rate suggest."""
    codec, long, short = F.lower("codec"), F.greatest("width", "height"), F.least("width", "height")
    hevc = codec.contains("hevc") | codec.contains("h265")
    return F.when(hevc & (long / F.greatest(F.lit(1), short) > 1.9), "action_cam").when(hevc, "iphone_recent").when(long >= 3000, "android_flagship").when((F.col("fps") <= 30.5) & (long <= 1920), "android_midrange").otherwise("generic")


def with_profile(clips: DataFrame, override: str | None = None, preset: str | None = None) -> DataFrame:
    """Adds device, profile, frame_stride and target_long_edge; fast clips are strided, long ones made smaller.

    preset names the device of all clips (an unknown one is generic); without it each clip's own is inferred.
    """
    spark = clips.sparkSession
    if override is not None and override not in {p[0] for p in PROFILES}:
        raise KeyError(f"no profile {override!r}")
    known = with_display(clips).withColumn("device", device_of() if preset is None else F.lit(device(preset)[0])).join(F.broadcast(devices(spark).drop("device_codec")), "device")  # six rows
    if override is not None:
        known = known.withColumn("profile", F.lit(override))
    known = known.join(F.broadcast(profiles(spark)), "profile")  # three rows
    if override is not None:
        return known
    stride = F.when(F.col("is_high_speed") & (F.col("frame_stride") == 1), F.lit(2)).otherwise(F.col("frame_stride"))
    edge = F.when(F.col("duration_s") > 120, F.least(F.coalesce("target_long_edge", F.lit(1920)), F.lit(1280))).otherwise(F.col("target_long_edge"))
    return known.withColumns({"frame_stride": stride, "target_long_edge": edge})


def with_advice(profiled: DataFrame) -> DataFrame:
    """Adds the names of capture warnings and tips."""
    checks = [F.when(F.col("rolling_shutter") == "high", F.lit("rolling_shutter")), F.when(F.col("fov_deg") > 100, F.lit("wide_angle")), F.when(F.col("is_portrait"), F.lit("portrait")), F.when(F.col("fps") < 29, F.lit("low_frame_rate"))]
    tips = [F.when(F.col("os") == "ios", F.lit("no_action_mode")), F.lit("landscape"), F.lit("still_camera"), F.lit("whole_body"), F.lit("frame_rate")]
    return profiled.withColumns({"warnings": F.array_compact(F.array(*checks)), "tips": F.array_compact(F.array(*tips))})


def expected_frames(start: str = "start_s", end: str = "end_s") -> Column:
    """Frames to process: of the trim window if there is one, after the stride, at least one."""
    window = ((F.col(end) - F.coalesce(F.col(start), F.lit(0.0))) * F.col("fps")).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.coalesce(window, F.col("frame_count")) / F.col("frame_stride")))


def scale_to(edge: str = "target_long_edge") -> Column:
    """Factor that brings the longer side to the edge, never above 1."""
    return F.least(F.lit(1.0), F.coalesce(F.col(edge) / F.greatest("width", "height"), F.lit(1.0)))


def device(name: str) -> tuple:
    """The fixed values of a device; an unknown name has those of a generic one."""
    known = {d[0]: d for d in DEVICES}
    return known.get(name, known["generic"])


def frame_time(pts: Column, time_base: Column, frame: Column, fps: Column) -> Column:
    """Seconds of a frame: from its own stamp, else from its number."""
    return F.coalesce(pts * time_base, frame / fps)
