"""The keeper's report: positioning, set position, dives and what to be careful about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.operators import dives as dv
from strideframe.operators import positioning as pos
from strideframe.operators import stance as st
from strideframe.operators.tracks import spans
from strideframe.schema import FRAME, TRACK
from strideframe.sources.store import stored


def goalkeeper_report(features: DataFrame, clips: DataFrame, goals: DataFrame, shots: DataFrame | None = None, cutoff_hz: float | None = 6.0, size: tuple[float, float] = g.REGULAR, dive_cutoff_hz: float | None = -1.0, kept: bool = False, even_time: bool = False) -> DataFrame:
    """One row per track of features: measures, nested dives and warnings.

    Dives move faster, so their cutoff is 2 Hz above the other unless ``dive_cutoff_hz`` says what it is.
    Five measures read the features, so these are written once to the shared folder, unless the caller has ``kept`` them.
    """
    if not kept:
        features = stored(features.drop("kp"), "features")
    faster = (cutoff_hz or 6.0) + 2.0 if dive_cutoff_hz == -1.0 else dive_cutoff_hz
    dives = dv.detect_dives(dv.dive_signals(features, clips, faster, even_time), goals, shots, size=size)
    where = pos.positioning(features, goals, clips, cutoff_hz, size, even_time)
    ready = st.set_positions(features).select(*TRACK, FRAME)
    stance = st.with_flags(st.stance(features).join(ready, [*TRACK, FRAME])).select(*TRACK, F.struct(F.col(FRAME), "stance_width_ratio", "mean_knee_deg", "trunk_lean_deg", "trunk_flexion_deg", "hand_height_ratio", "com_height_ratio", "is_valid", "flags").alias("set_position"))
    listed = dives.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "peak_frame", "direction", "height", "peak_speed_bh_s", "lateral_bh", "lateral_m", "max_lean_deg", "reaction_time_s", "confidence", "notes"))).alias("dives"))
    out = spans(features).join(where, TRACK, "left").join(stance, TRACK, "left").join(listed, TRACK, "left").join(clips.select("clip_id", "fps"), "clip_id")
    out = pos.with_goal(out, goals)
    goal = g.Goal.of(size=size)
    out = out.withColumns({"duration_s": F.col("n") / F.col("fps"), "dive_count": F.coalesce(F.size("dives"), F.lit(0)), "mouth": pos.mouth_position(F.col("median_coverage")), "calibrated": goal.px_per_m.isNotNull()})
    return out.withColumn("dive_count", F.greatest("dive_count", F.lit(0))).withColumn("warnings", warnings(shots is not None, size)).drop("lx", "ly", "rx", "ry", "crossbar_y")


def warnings(shots_given: bool, size: tuple[float, float] = g.REGULAR):  # noqa: ANN201
    """Names of the caveats that hold for a report row."""
    goal = g.Goal.of(size=size)
    dived = F.col("dive_count") > 0
    off = F.abs(F.col("median_coverage") - 0.5) * size[0]
    checks = {
        "no_goal": ~F.col("calibrated"),
        "goal_scales_disagree": ~goal.consistency.between(0.8, 1.25),
        "scale_holds_at_line": F.col("calibrated"),
        "low_frame_rate": (F.col("fps") < 50) & dived,
        "no_shot_times": F.lit(not shots_given) & dived,
        "gaps": F.col("coverage") < 0.8,
        "few_frames": F.coalesce(F.col("frames_analysed"), F.lit(0)) < 15,
        "set_position_unsure": ~F.col("set_position.is_valid"),
        "off_centre": off > 1.5,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def summary_line() -> object:
    """One line of text for a report row."""
    return F.concat_ws(" | ", F.format_string("track %d", "track_id"), F.format_string("%d frames", "n"), F.format_string("%d dives", "dive_count"), F.when(F.col("median_depth_m").isNotNull(), F.format_string("%.2f m off the line", "median_depth_m")), F.col("mouth"))


def text_report():  # noqa: ANN201
    """The whole of a report row as lines of text; what is not known has no line."""
    line = lambda label, form, *c: F.when(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c]), F.format_string(f"  {label:<25}: {form}", *c))
    at = "set_position"
    dive = F.transform("dives", lambda d, i: F.concat(F.format_string("  %d. %s %s, peak %.2f body heights/s, %+.2f body heights sideways", i + 1, d["direction"], d["height"], d["peak_speed_bh_s"], d["lateral_bh"]), F.concat_ws("", F.transform(d["notes"], lambda n: F.concat(F.lit("\n     ! "), n)))))
    ready = F.concat_ws(
        "\n",
        F.format_string("Set position (frame %d)", f"{at}.{FRAME}"),
        line("Stance width", "%.2f x shoulders", f"{at}.stance_width_ratio"),
        line("Knee angle", "%.0f deg", f"{at}.mean_knee_deg"),
        line("Trunk flexion", "%.0f deg", f"{at}.trunk_flexion_deg"),
        line("Hand height", "%+.2f body heights above hips", f"{at}.hand_height_ratio"),
        F.array_join(F.transform(f"{at}.flags", lambda f: F.concat(F.lit("  ! "), f)), "\n"),
    )
    parts = [
        F.format_string("Goalkeeper: track %d", "track_id"),
        F.format_string("Clip: %.1f s at %.1f fps", "duration_s", "fps"),
        F.lit("Positioning"),
        line("Median distance off line", "%.2f m", "median_depth_m"),
        line("Depth range", "%.2f m", "depth_range_m"),
        line("Median mouth position", "%.2f (%s)", "median_coverage", "mouth"),
        F.when(F.col("time_in_goal_area").isNotNull(), F.format_string(f"  {'Time in goal area':<25}: %.0f%%", F.col("time_in_goal_area") * 100)),
        F.coalesce(line("Distance covered", "%.1f m", "distance_covered_m"), line("Distance covered", "%.1f body heights", "distance_covered_bh")),
        line("Peak speed", "%.2f body heights/s", "peak_speed_bh_s"),
        F.when(F.col(at).isNotNull(), ready),
        F.format_string("Dives detected: %d", "dive_count"),
        F.array_join(dive, "\n"),
        F.when(F.size("warnings") > 0, F.concat(F.lit("Caveats\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("  - "), w)), "\n"))),
    ]
    return F.concat_ws("\n", *parts)
