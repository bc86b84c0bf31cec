"""The clip pipeline: detections through tracking, calibration and analysis as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.operators import calibration, clips, dives, events, features, lifting, positioning, report, tracks
from strideframe.plans.config import Config
from strideframe.schema import FRAME, TRACK
from strideframe.sources.store import stored


@dataclass
class Result:
    """Tables of a run; what was not asked for is None."""

    clips: DataFrame
    tracked: DataFrame
    features: DataFrame
    pitch: DataFrame | None = None
    kicks: DataFrame | None = None
    contacts: DataFrame | None = None
    keepers: DataFrame | None = None
    dives: DataFrame | None = None
    report: DataFrame | None = None
    uncertain: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give up what the run keeps in executors; call it when the tables are stored."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def summary(self) -> DataFrame:
        """clip_id and text: a few lines on each clip and what was found in it."""
        frames = self.tracked.groupBy("clip_id").agg(F.count_distinct(FRAME).alias("frames"), F.count_distinct("track_id").alias("people"))
        out = self.clips.join(frames, "clip_id", "left")
        lines = [
            F.format_string("Clip       : %d", "clip_id"),
            F.format_string("Resolution : %dx%d  (%s)", "display_width", "display_height", F.when(F.col("is_portrait"), "portrait").otherwise("landscape")),
            F.format_string("Frame rate : %.2f fps", "fps"),
            F.format_string("Frames     : %d processed", F.coalesce("frames", F.lit(0))),
            F.format_string("People     : %d track(s)", F.coalesce("people", F.lit(0))),
        ]
        for name, table in (("Kicks", self.kicks), ("Contacts", self.contacts), ("Dives", self.dives)):
            if table is not None:
                out = out.join(table.groupBy("clip_id").agg(F.count("*").alias(f"_{name}")), "clip_id", "left")
                lines.append(F.format_string(f"{name:<11}: %d", F.coalesce(f"_{name}", F.lit(0))))
        lines.append(F.when(F.size("warnings") > 0, F.concat(F.lit("Warnings\n  - "), F.array_join("warnings", "\n  - "))))
        if self.report is not None:
            text = self.report.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_list(report.text_report())), "\n\n").alias("_report"))  # the keepers of a clip
            out, lines = out.join(text, "clip_id", "left"), [*lines, F.col("_report")]
        return out.select("clip_id", F.concat_ws("\n", *lines).alias("text"))


def track(detections: DataFrame, config: Config) -> DataFrame:
    """Sure detections without duplicates, with tracks (or positions in the frame, if tracking is off)."""
    rows = detections.withColumn("mean_conf", g.mean_confidence(F.col("kp")))
    rows = rows.withColumn("bbox", F.coalesce("bbox", g.box_of(F.col("kp")))).where(F.col("mean_conf") >= config.pose.min_person_confidence)
    one = tracks.suppress_duplicates(rows, ["clip_id", FRAME], config.tracking.duplicate_iou)
    if not config.tracking.enabled:
        return one.withColumn("track_id", F.col("rank"))
    # The order of confidence is the order in which boxes are offered to the tracker.
    offered = one.withColumn("det_id", F.col("rank")).drop("rank")
    t = config.tracking
    return tracks.track_boxes(offered, tracks.Tracker(min_iou=t.iou_threshold, max_age=t.max_age, min_hits=t.min_hits), config.pose.min_person_confidence)


def with_rates(detections: DataFrame, known: DataFrame) -> DataFrame:
    """detections with their clip's ``_fps`` and ``_stride``, NULL if the clip is unknown.

    Spark may take made-up frames to be as few as the keys they are made from, and would then send
    all of them through the driver to join them. Of a left join only the clips can be broadcast, and
    the generator keeps the optimiser from making an inner one of it.
    """
    of = known.select("clip_id", F.struct(F.col("fps").alias("_fps"), F.col("frame_stride").alias("_stride")).alias("_of"))
    return detections.join(of, "clip_id", "left").select(*detections.columns, F.inline(F.array("_of")))


def run(clip_rows: DataFrame, detections: DataFrame, config: Config, shots: DataFrame | None = None, colours: DataFrame | None = None) -> Result:
    """All stages that the settings ask for; nothing is collected.

    What several stages read is written once to the shared folder (the tracked rows, and with a
    keeper the keepers, their features and their dives), so that no plan holds another one many
    times over; the rest is declared lazily.

    Of the trimmed frames every ``frame_stride``-th of the clip's profile counts.
    colours: kit colour samples (clip_id, track_id, frame_index, r, g, b). The
    features are kept in executors until ``release``.
    """
    config.checked()
    preset = None if config.video.device_preset in ("auto", "") else config.video.device_preset
    known = clips.with_advice(clips.with_profile(clip_rows, config.video.profile, preset))
    timed = with_rates(detections, known)
    at = F.col(FRAME) / F.col("_fps")
    if config.video.start_s is not None:
        timed = timed.where(at >= config.video.start_s)
    if config.video.end_s is not None:
        timed = timed.where(at < config.video.end_s)
    first = F.ceil(F.lit(config.video.start_s or 0.0) * F.col("_fps"))
    tracked = track(timed.where(F.pmod(F.col(FRAME) - first, F.col("_stride")) == 0).drop("_fps", "_stride"), config)
    if "kp3d" in tracked.columns:
        tracked = lifting.lifter()(tracked, clip_rows, config.analysis.filter_cutoff_hz)
    tracked = stored(tracked, "tracked")
    rows = features.pose_features(tracked).persist(StorageLevel.MEMORY_AND_DISK)
    out = Result(known, tracked, rows, cached=[rows])
    if config.calibration.enabled and config.calibration.image_points:
        pairs = [(float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(config.calibration.image_points, config.calibration.pitch_points, strict=True)]
        points = clip_rows.sparkSession.createDataFrame(pairs, "image_x double, image_y double, pitch_x double, pitch_y double")
        fitted = calibration.fit(clip_rows.select("clip_id").join(F.broadcast(points), how="cross"), calibration.RELIABLE_PX)  # the clicked points
        out.pitch = calibration.to_pitch(rows.select(*TRACK, FRAME, "feet_x", "feet_y"), fitted)
    if config.goalkeeper.enabled:
        keeper(out, clip_rows, config, shots, colours)
    elif config.analysis.events:
        longest = rows.join(tracks.longest_track(rows).select(*TRACK), TRACK, "left_semi")
        out.kicks, out.contacts = events.detect_kicks(longest, clip_rows), events.foot_contacts(longest, clip_rows)
    return out


def keeper(out: Result, clip_rows: DataFrame, config: Config, shots: DataFrame | None, colours: DataFrame | None = None) -> None:
    """Identification, dives and the report of the keeper's track of each clip."""
    gk, goals = config.goalkeeper, None
    size = (gk.goal_width_m, gk.goal_height_m)
    if gk.goal_posts:
        (lx, ly), (rx, ry) = gk.goal_posts
        goals = clip_rows.select("clip_id", *[F.lit(float(v)).alias(n) for n, v in (("lx", lx), ("ly", ly), ("rx", rx), ("ry", ry))], F.lit(None).cast("double").alias("crossbar_y"))
        if (lx, ly) == (rx, ry):
            out.warnings.append("the goal posts coincide")
            goals = None
    if gk.track_id is not None and gk.identification in ("auto", "manual"):
        out.keepers = out.features.where(F.col("track_id") == gk.track_id).select(*TRACK).distinct().withColumns({"method": F.lit("manual"), "score": F.lit(1.0)})
    else:
        by_goal = goals if gk.identification in ("auto", "geometry") else None
        by_colour = colours if gk.identification in ("auto", "colour") else None
        if by_goal is None and by_colour is None and gk.identification != "auto":
            out.warnings.append(f"nothing to identify the keeper by {gk.identification} with; the longest track is taken")
        out.keepers = positioning.identify(out.features, by_goal, colours=by_colour, size=size)
        # Kept by clip: more than one candidate and no good one.
        out.uncertain = positioning.uncertain(positioning.score_geometry(out.features, by_goal, size=size) if by_goal is not None else positioning.score_colour(by_colour)) if by_goal is not None or by_colour is not None else None
    out.keepers = stored(out.keepers, "keepers")
    own = stored(out.features.join(out.keepers.select(*TRACK), TRACK, "left_semi").drop("kp"), "own")
    none = clip_rows.select("clip_id", *[F.lit(None).cast("double").alias(n) for n in ("lx", "ly", "rx", "ry", "crossbar_y")])
    cutoff = config.analysis.filter_cutoff_hz
    even = config.analysis.even_time
    rated = out.clips if even else clip_rows
    signals = dives.dive_signals(own, rated, (cutoff or 6.0) + 2.0, even)
    out.dives = stored(dives.detect_dives(signals, goals, shots, gk.dive_speed_threshold, gk.min_dive_frames, gk.dive_lean_threshold_deg, size), "dives")
    out.report = report.goalkeeper_report(own, rated, none if goals is None else goals, shots, cutoff, size, kept=True, even_time=even)
