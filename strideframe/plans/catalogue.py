"""Every query of the engine over the test tables, keyed by name; numbers are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions import skeleton as sk
from strideframe.operators import calibration, clips, dives, events, kit, lifting, long_series, positioning, report, series, stance, tracks
from strideframe.operators import features as feat
from strideframe.plans import pipeline
from strideframe.plans.config import Config
from strideframe.schema import FRAME, TRACK
from strideframe.sources import adapters, readers, sinks, store
from strideframe.streaming import smoothing, tracking, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A homography that has a horizon outside the picture.
H = (0.1, 0.02, -60.0, 0.01, 0.15, -50.0, 0.0001, 0.0002, 1.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.pose_features(adapters.poses(spark, sf_dir))


def dive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.pose_features(adapters.dive_tracks(spark, sf_dir))


def pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one frame (a few boxes each)."""
    a, b = (boxes.select(FRAME, F.col("det_id").alias(f"{n}_id"), F.col("bbox").alias(n)) for n in "ab")
    return a.join(b, FRAME).where("a_id < b_id")


@query
def positioning_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return positioning.positioning(f, adapters.fixed_goals(adapters.pose_clips(spark)), adapters.pose_clips(spark), None)


@query
def bbox_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = F.col("bbox"), g.centre(F.col("bbox"))
    return adapters.boxes(spark, sf_dir).select(FRAME, "det_id", g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("area"), c.x.alias("cx"), c.y.alias("cy"))


@query
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(adapters.boxes(spark, sf_dir)).select(FRAME, "a_id", "b_id", g.iou(F.col("a"), F.col("b")).alias("iou"))


@query
def bbox_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(adapters.boxes(spark, sf_dir)).select(FRAME, "a_id", "b_id", g.containment(F.col("a"), F.col("b")).alias("containment"), g.affinity(F.col("a"), F.col("b")).alias("affinity"))


@query
def dedup_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.suppress_duplicates(adapters.boxes(spark, sf_dir), [FRAME]).select(FRAME, "det_id", "rank", "mean_conf")


@query
def canonical_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kp = sk.to_canonical(F.col("kp"), "mediapipe33")
    return adapters.landmarks33(spark, sf_dir).select("vec_id", F.posexplode(kp).alias("joint", "k")).select("vec_id", F.col("joint").cast("bigint").alias("joint"), "k.x", "k.y", "k.conf")


@query
def visible_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = g.visible(F.col("kp"))
    return adapters.poses(spark, sf_dir).select("det_id", F.size(F.filter(seen, lambda v: v)).cast("bigint").alias("n_visible"), F.array_join(F.transform(seen, lambda v: v.cast("int").cast("string")), "").alias("mask"))


@query
def mean_conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.poses(spark, sf_dir).select("det_id", g.mean_confidence(F.col("kp")).alias("mean_conf")).where("mean_conf >= 0.4D")


@query
def joint_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = g.joint(F.col("kp"), sk.NOSE, 0.3), g.joint(F.col("kp"), 40, 0.3)
    return adapters.poses(spark, sf_dir).select("det_id", p.x.alias("nose_x"), p.y.alias("nose_y"), q.x.alias("absent_x"))


@query
def keypoint_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.poses(spark, sf_dir).select("det_id", g.box_of(F.col("kp"), 0.1).alias("b")).select("det_id", "b.x1", "b.y1", "b.x2", "b.y2", "b.score")


@query
def crop_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = g.crop(g.box_of(F.col("kp")), F.lit(1280), F.lit(720))
    return adapters.poses(spark, sf_dir).select("det_id", box.alias("b")).select("det_id", *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def com_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("track_id", FRAME, "com_x", "com_y")


@query
def body_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("track_id", FRAME, "height_px", g.metres_per_pixel(F.col("height_px")).alias("m_per_px"))


@query
def feet_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("track_id", FRAME, "feet_x", "feet_y")


@query
def root_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.poses3d(spark, sf_dir).select("vec_id", F.posexplode(g.root_relative(F.col("kp3d"))).alias("joint", "k"))
    return rows.select("vec_id", F.col("joint").cast("bigint").alias("joint"), "k.x", "k.y", "k.z")


@query
def joint_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("track_id", FRAME, "left_knee_deg", "right_knee_deg", "left_hip_deg", "right_hip_deg")


@query
def trunk_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("track_id", FRAME, "lean_deg")


@query
def stance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.stance(features(spark, sf_dir)).select("track_id", FRAME, "stance_width_ratio", "hand_width_ratio", "mean_knee_deg", "trunk_flexion_deg", "hand_height_ratio", "com_height_ratio", "is_valid")


@query
def stance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.with_flags(stance.stance(features(spark, sf_dir))).select("track_id", FRAME, F.concat_ws(",", "flags").alias("flags"))


@query
def set_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.set_positions(features(spark, sf_dir)).select("track_id", FRAME, "cost")


@query
def reference_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.reference_heights(features(spark, sf_dir)).select("track_id", "reference_px", "n_heights")


@query
def track_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.spans(features(spark, sf_dir).where("mean_conf >= 0.55D")).select("track_id", "n", "first_frame", "last_frame", "coverage")


@query
def longest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.longest_track(features(spark, sf_dir))


@query
def goal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("com_x is not null")
    return positioning.offsets(f, adapters.fixed_goals(adapters.pose_clips(spark))).select("track_id", FRAME, "lateral_m", "depth_m", "coverage", "in_area", positioning.mouth_position(F.col("coverage")).alias("mouth"))


@query
def goal_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.table(spark, sf_dir, "supplier").select("s_suppkey", (852 - F.col("s_suppkey") % 1500).cast("double").alias("lx"), F.lit(300.0).alias("ly"), F.lit(120.0).alias("rx"), (300 + F.col("s_suppkey") % 7).cast("double").alias("ry"), F.when(F.col("s_suppkey") % 3 > 0, F.lit(56.0)).alias("crossbar_y"))
    goal = g.Goal.of()
    return s.select("s_suppkey", goal.width_px.alias("width_px"), goal.px_per_m.alias("px_per_m"), goal.height_px.alias("height_px"), goal.consistency.alias("consistency"), goal.normal.x.alias("normal_x"), goal.normal.y.alias("normal_y"))


@query
def identify_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return positioning.ranked(positioning.score_geometry(f, adapters.fixed_goals(adapters.pose_clips(spark)))).select("track_id", "frames", "median_depth_m", "within_mouth", "distance_m", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def kit_colour_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda a, b, n: F.pmod(F.col("det_id") * a + F.col("track_id") * b, F.lit(256)).cast("double").alias(n)
    samples = adapters.poses(spark, sf_dir).select(*TRACK, FRAME, c(37, 91, "r"), c(11, 53, "g"), c(5, 17, "b"))
    return positioning.ranked(positioning.score_colour(samples)).select("track_id", "n", "distance", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def identify_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return positioning.identify(f, adapters.fixed_goals(adapters.pose_clips(spark)))


@query
def pitch_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    h = adapters.pose_clips(spark).withColumn("h", F.array(*[F.lit(v) for v in H]))
    back = g.project([F.get("hi", F.lit(i)) for i in range(9)], g.columns("pitch_x", "pitch_y"))
    out = calibration.to_pitch(f.select("clip_id", "track_id", FRAME, "feet_x", "feet_y"), h)
    return out.withColumn("hi", g.inverse([F.lit(v) for v in H])).select("track_id", FRAME, "pitch_x", "pitch_y", back.x.alias("image_x"), back.y.alias("image_y"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four or more clicks on landmarks for each supplier's clip, one name in seven unknown."""
    names = [n for n, _, _ in calibration.LANDMARKS]
    s = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("clip_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    at = F.pmod(F.col("clip_id") + F.col("j") * 5, F.lit(len(names))).cast("int")
    return s.select("clip_id", F.when(F.col("j") == 6, F.lit("nowhere")).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)).alias("landmark"))


@query
def landmark_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.located(clicks(spark, sf_dir), calibration.landmarks(spark)).select("clip_id", "landmark", "pitch_x", "pitch_y")


@query
def landmark_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.unknown(clicks(spark, sf_dir), calibration.landmarks(spark))


@query
def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks made by the inverse of H give H back."""
    known = calibration.located(clicks(spark, sf_dir), calibration.landmarks(spark)).withColumn("hi", g.inverse([F.lit(v) for v in H]))
    image = g.project([F.get("hi", F.lit(i)) for i in range(9)], g.columns("pitch_x", "pitch_y"))
    fitted = calibration.fit(known.select("clip_id", image.x.alias("image_x"), image.y.alias("image_y"), "pitch_x", "pitch_y"))
    return fitted.select("clip_id", *[F.round(F.get("h", F.lit(i)), 4).alias(f"h{i}") for i in range(9)], "n_points", "reliable")


@query
def ground_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = adapters.pose_clips(spark).withColumn("h", F.array(*[F.lit(v) for v in H]))
    out = calibration.ground_distance(features(spark, sf_dir), h, ("feet_x", "feet_y"), ("com_x", "com_y"))
    return out.select("track_id", FRAME, "distance_m")


@query
def detector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.tall_boxes(adapters.boxes(spark, sf_dir), 720.0).select(FRAME, "det_id", "rank")


@query
def identity_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return positioning.uncertain(positioning.score_geometry(f, adapters.fixed_goals(adapters.pose_clips(spark))))


@query
def report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report without any low-pass, as SQL can follow it."""
    f = dive_features(spark, sf_dir)
    out = report.goalkeeper_report(f, adapters.dive_clips(spark, sf_dir), adapters.fixed_goals(adapters.dive_clips(spark, sf_dir)), cutoff_hz=None, dive_cutoff_hz=None)
    return out.select("clip_id", "track_id", "n", "duration_s", F.col("dive_count").cast("bigint").alias("dive_count"), "frames_analysed", "median_depth_m", "median_coverage", "time_in_goal_area", "distance_covered_m", "mouth", report.summary_line().alias("summary"))


@query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dive_features(spark, sf_dir)
    out = report.goalkeeper_report(f, adapters.dive_clips(spark, sf_dir), adapters.fixed_goals(adapters.dive_clips(spark, sf_dir)))
    return out.select("clip_id", report.text_report().alias("text"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.signals(spark, sf_dir)


KEY = ["user_id"]


@query
def gradient_nonuniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.over(KEY, "idx")
    return moves(spark, sf_dir).withColumn("minutes", F.col("t") / 60).select("user_id", "idx", F.round(series.gradient(F.col("v"), F.col("minutes"), w), 4).alias("dv"))


@query
def gradient_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.over(KEY, "idx")
    return moves(spark, sf_dir).select("user_id", "idx", series.uniform_gradient(F.col("v"), 1 / 60, w).alias("dv"))


@query
def acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.over(KEY, "idx")
    first = moves(spark, sf_dir).withColumn("dv", series.uniform_gradient(F.col("v"), 1.0, w))
    return first.select("user_id", "idx", F.abs("dv").alias("speed"), series.uniform_gradient(F.abs("dv"), 1.0, w).alias("acc"))


@query
def step_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feat.usable(features(spark, sf_dir))
    return f.select("track_id", FRAME, series.step_length(F.col("com_x"), F.col("com_y"), series.over(TRACK, FRAME)).alias("step_px"))


@query
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("mean_conf >= 0.55D").select(*TRACK, FRAME, "com_x")
    return series.gap_fill(f, TRACK, FRAME, "com_x").select("track_id", FRAME, "com_x")


@query
def gap_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).withColumn("g", F.when(F.col("event_type") != "error", F.col("v")))
    return rows.select("user_id", "idx", series.interpolated(F.col("g"), F.col("idx"), KEY, "idx").alias("filled"))


@query
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).withColumn("peak", series.local_peak(F.col("v"), 20.0, series.over(KEY, "idx"))).where("peak").select("user_id", "idx", "v")


@query
def kick_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = series.over(KEY, "idx").rowsBetween(0, 2)
    return moves(spark, sf_dir).select("user_id", "idx", F.min("v").over(ahead).alias("least"), F.avg("v").over(ahead).alias("mean"))


@query
def refractory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).where("v >= 5").select("user_id", "idx", "v")
    return series.refractory(rows, KEY, "idx", "v", 4)


@query
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = series.islands(moves(spark, sf_dir), KEY, "idx", F.coalesce(F.col("v") >= 30, F.lit(False))).where("island is not null")
    return runs.groupBy("user_id", "island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("n"), F.max_by("idx", F.struct("v", -F.col("idx"))).alias("peak")).where("n >= 2")


@query
def prefix_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the values before each user's largest one."""
    rows = moves(spark, sf_dir).withColumn("top", F.max_by("idx", F.struct("v", -F.col("idx"))).over(Window.partitionBy("user_id"))).select("user_id", "idx", "v", "top")
    return series.running_median(rows, KEY, "idx", "v", "baseline", here=False).where("idx = top").select("user_id", "top", "baseline")


@query
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).select("user_id", "idx", F.when(F.col("event_type") != "error", F.col("v")).alias("v"))
    return series.running_median(rows, KEY, "idx", "v", "median").select("user_id", "idx", "median")


@query
def asof_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = moves(spark, sf_dir)
    out = series.asof(s.where("event_type = 'error'").select("user_id", "event_id", "t"), s.where("event_type = 'purchase'").select("user_id", F.col("t").alias("shot")), KEY, "t", "shot", "last_shot")
    return out.select("user_id", "event_id", F.round(F.col("t") - F.col("last_shot"), 3).alias("reaction_s"))


#: So few that the test tables are cut as well.
SLICE = 3000
ONE = ["k"]


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series in the order of their numbers: a key that a cluster has to share."""
    e = adapters.table(spark, sf_dir, "events")
    return e.select(F.lit(0).alias("k"), "event_id", "event_type", F.col("value").alias("v"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1.7e9).alias("t"))


@query
def long_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_series.gradient(one_series(spark, sf_dir), ONE, "event_id", "v", "event_id", "dv", SLICE).select("event_id", "dv")


@query
def long_uniform_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_series.uniform_gradient(one_series(spark, sf_dir), ONE, "event_id", "v", 0.5, "dv", SLICE).select("event_id", "dv")


@query
def long_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_series(spark, sf_dir).withColumn("w", F.pmod(F.col("event_id"), F.lit(97)).cast("double"))
    return long_series.step_length(rows, ONE, "event_id", "v", "w", "step", SLICE).select("event_id", "step")


@query
def long_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_series.local_peaks(one_series(spark, sf_dir), ONE, "event_id", "v", 20.0, "peak", SLICE).where("peak").select("event_id", "v")


@query
def long_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = long_series.islands(one_series(spark, sf_dir), ONE, "event_id", F.coalesce(F.col("v") >= 10, F.lit(False)), SLICE).where("island is not null")
    return runs.groupBy("island").agg(F.min("event_id").alias("start"), F.max("event_id").alias("end"), F.count("*").alias("n")).where("n >= 2")


@query
def long_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_series(spark, sf_dir).withColumn("g", F.when(F.col("event_type") == "purchase", F.col("v")))
    return long_series.interpolated(rows, ONE, "event_id", "g", "event_id", "filled", SLICE).select("event_id", "filled")


@query
def long_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, filtered in pieces of 2,000 rows."""
    rows = one_series(spark, sf_dir).withColumn("smooth", F.col("v"))
    return long_series.filtered(rows, ONE, "event_id", ["smooth"], F.lit(60.0), 8.0, 2000, SLICE).select("event_id", "v", "smooth")


@query
def stride_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.strided(moves(spark, sf_dir), KEY, "idx", "idx", 3, 2, 40).select("user_id", "idx", "v")


@query
def foot_contacts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return events.foot_contacts(f, adapters.pose_clips(spark), None).select("track_id", FRAME, "foot", "time_s", "confidence")


@query
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return events.cadence(events.foot_contacts(f, adapters.pose_clips(spark, 5.0), None)).select("track_id", "contacts", "cadence_spm")


@query
def kicks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return events.detect_kicks(f, adapters.pose_clips(spark), cutoff_hz=None).select("track_id", FRAME, "foot", "time_s", "peak_speed_bh_s", "deceleration_bh_s2", "confidence")


def raw_dives(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dive_features(spark, sf_dir)
    shots = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("clip_id")).select("clip_id", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.5))).alias("shot_time_s"))
    return dives.detect_dives(dives.dive_signals(f, adapters.dive_clips(spark, sf_dir), None), adapters.fixed_goals(adapters.dive_clips(spark, sf_dir)), shots)


@query
def dives_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_dives(spark, sf_dir).select("clip_id", "start_frame", "end_frame", "peak_frame", "peak_speed_bh_s", "lateral_bh", "lateral_m", "max_lean_deg", "peak_reach_bh", "direction", "height", "reaction_time_s", "confidence")


@query
def dive_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_dives(spark, sf_dir).select("clip_id", "set_frame", "preparatory_start", "takeoff", "flight_start", "peak", "landing")


@query
def phase_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.dive_tracks(spark, sf_dir).select(*TRACK, FRAME)
    return dives.frames_in_dives(frames, raw_dives(spark, sf_dir)).select("clip_id", FRAME, "phase")


@query
def dive_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dives.dive_table(raw_dives(spark, sf_dir)).drop("track_id")


@query
def dive_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dives with what to be careful about; shots 0.05 s before some of them make reactions too early to be true."""
    clips_, f = adapters.dive_clips(spark, sf_dir), dive_features(spark, sf_dir).withColumn("lean_deg", F.when(F.col("clip_id") % 3 > 0, F.col("lean_deg")))
    shots = clips_.select("clip_id", F.when(F.col("clip_id") % 4 == 0, 0.7).otherwise(0.2).alias("shot_time_s"))
    found = dives.detect_dives(dives.dive_signals(f, clips_, None), None, shots)
    return found.select("clip_id", "start_frame", "reaction_time_s", F.concat_ws(",", "notes").alias("notes"))


@query
def dives_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dive_features(spark, sf_dir)
    return dives.detect_dives(dives.dive_signals(f, adapters.dive_clips(spark, sf_dir))).select("clip_id", "start_frame", "end_frame", "peak_frame", "peak_speed_bh_s", "lateral_bh", "direction", "height")


@query
def kicks_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return events.detect_kicks(f, adapters.pose_clips(spark)).select("track_id", FRAME, "foot", "peak_speed_bh_s")


@query
def goalkeeper_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dive_features(spark, sf_dir)
    out = report.goalkeeper_report(f, adapters.dive_clips(spark, sf_dir), adapters.fixed_goals(adapters.dive_clips(spark, sf_dir)))
    return out.select("clip_id", "track_id", "n", "duration_s", F.col("dive_count").cast("bigint").alias("dive_count"), "median_depth_m", "mouth", F.concat_ws(",", "warnings").alias("warnings"), report.summary_line().alias("summary"))


def beside(boxes: DataFrame) -> DataFrame:
    """boxes, and a second person 900 pixels beside each; a box is made once for both."""
    b, rest = F.col("bbox"), [c for c in boxes.columns if c not in ("det_id", "bbox")]
    moved = b.withField("x1", b["x1"] + 900).withField("x2", b["x2"] + 900)
    two = F.array(F.struct(F.col("det_id"), b.alias("bbox")), F.struct(F.lit(1).cast("bigint").alias("det_id"), moved.alias("bbox")))
    return boxes.select(*rest, F.inline(two)).select(*boxes.columns)


@query
def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.dive_tracks(spark, sf_dir)
    one = d.select("clip_id", FRAME, "det_id", g.box_of(F.col("kp")).alias("bbox"), g.mean_confidence(F.col("kp")).alias("mean_conf"))
    return tracks.track_boxes(beside(one)).select("clip_id", FRAME, "det_id", "track_id", "confirmed")


@query
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keepers one after another in one long clip, 80 frames apart, each beside a second person."""
    d = adapters.dive_tracks(spark, sf_dir)
    rows = d.select(F.lit(0).cast("bigint").alias("clip_id"), (F.col("clip_id") * 200 + F.col(FRAME)).alias(FRAME), "det_id", g.box_of(F.col("kp")).alias("bbox"), g.mean_confidence(F.col("kp")).alias("mean_conf"))
    return tracks.track_long_clips(beside(rows), slice_rows=SLICE).select(FRAME, "det_id", "track_id", "confirmed")


@query
def streamed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keepers' boxes through the stateful stream; one more frame without a box lets the last ones go."""
    keys = spark.readStream.schema("s_suppkey bigint").parquet(f"{sf_dir}/supplier.parque[t]")  # a pattern, as a stream takes no single file
    rows = adapters.keeper_boxes(keys.select(F.col("s_suppkey").alias("k")), adapters.DIVE_FRAMES + 1)
    last = F.col(FRAME) == adapters.DIVE_FRAMES
    rows = rows.withColumns({"bbox": F.when(~last, F.col("bbox")), "at": F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.round(F.col(FRAME) / adapters.FPS * 1e6).cast("bigint"))})
    return tracking.run_to_end(tracking.stream_tracks(rows, late="0 seconds"), "tracks")


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Poses at a tenth of their size, and a picture of 128 x 72 for each frame, whose colours follow a formula.

    Generators stand between: the optimiser would test the size of a picture before the frames are
    made distinct, that is, draw one for each pose, and would write out a pose wherever a joint is read.
    """
    p = adapters.poses(spark, sf_dir)
    small = F.transform("kp", lambda k: F.struct((k["x"] * 0.1).alias("x"), (k["y"] * 0.1).alias("y"), k["conf"].alias("conf")))
    value = "pmod(i div 3 % 128 * 3 + i div 3 div 128 * 5 + frame_index * 7 + i % 3 * 11, 256)"
    pixels = F.expr(f"unhex(array_join(transform(sequence(0, {3 * 128 * 72 - 1}), i -> lpad(hex({value}), 2, '0')), ''))")
    made = lambda name, c: F.inline(F.array(F.struct(c.alias(name))))
    frames = p.select("clip_id", FRAME).distinct()
    return p.select("clip_id", "track_id", FRAME, made("kp", small)), frames.select("clip_id", FRAME, F.lit(128).alias("width"), F.lit(72).alias("height"), made("pixels", pixels))


@query
def kit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kit.samples(*_drawn(spark, sf_dir)).select("track_id", FRAME, "r", "g", "b")


@query
def kit_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track whose kit, seen in pictures, is farthest from the clip's."""
    found = positioning.ranked(positioning.score_colour(kit.samples(*_drawn(spark, sf_dir))))
    return found.select("track_id", F.col("n").cast("bigint").alias("n"), "distance", "score", "rank")


@query
def torso_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = g.torso_patch(F.col("kp"), F.lit(1280), F.lit(720))
    return adapters.poses(spark, sf_dir).select("det_id", patch.alias("p")).where("p is not null").select("det_id", *[F.col(f"p.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def pixel_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks in shares of a turned, downscaled image, in the pixels of the original."""
    kp = readers.from_normalised(F.col("kp"), F.lit(640.0), F.lit(360.0))
    kp = readers.from_pixels(readers.rotate(kp, F.pmod(F.col("vec_id"), F.lit(4)) * 90, F.lit(640), F.lit(360)), F.lit(0.5))
    return adapters.landmarks33(spark, sf_dir).select("vec_id", F.posexplode(kp).alias("joint", "k")).select("vec_id", F.col("joint").cast("bigint").alias("joint"), "k.x", "k.y", "k.conf")


@query
def smoothed_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-passed 3D places of each track, summed over the joints of a frame (the filter is linear)."""
    p = adapters.poses3d(spark, sf_dir).select(F.lit(0).cast("bigint").alias("clip_id"), F.expr("vec_id div 50").alias("track_id"), F.expr("vec_id % 50").alias(FRAME), "kp3d")
    sums = [F.aggregate(F.transform("kp3d", lambda k: k[c]), F.lit(0.0), lambda a, v: a + v).alias(c) for c in "xyz"]  # noqa: B023
    return lifting.smooth(p, adapters.pose_clips(spark)).select("track_id", FRAME, *sums)


@query
def session_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = smoothing.smoothed_sessions(moves(spark, sf_dir), "user_id", "ts", ["v"], 60.0, 8.0, 4 * 86400.0)
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("ts").alias("at_us"), "v")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on each clip of a run of the whole pipeline."""
    rows = adapters.dive_clips(spark, sf_dir).selectExpr("clip_id", "cast(null as string) path", "1280 width", "720 height", "fps", "120L frame_count", "0 rotation", "'h264' codec", "2.0D duration_s")
    seen = adapters.dive_tracks(spark, sf_dir).select("clip_id", FRAME, (F.col(FRAME) / 60.0).alias("ts"), F.col("det_id").cast("int").alias("det_id"), "kp", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double, score: double>").alias("bbox"))
    posts = {"goalkeeper": {"enabled": True, "goal_posts": [[120, 300], [852, 300]]}, "analysis": {"filter_cutoff_hz": None}}
    out = pipeline.run(rows, seen, Config.from_dict(posts))
    text = store.stored(out.summary(), "summary")
    out.release()
    return text.select("clip_id", F.substring_index(F.substring_index("text", "\nWarnings", 1), "\nGoalkeeper:", 1).alias("text"))


@query
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each clip's last frame: by its own stamp where the container has one, else by its number."""
    c = adapters.clips(spark, sf_dir)
    stamp = F.when(F.col("clip_id") % 3 > 0, F.col("frame_count") * 1001)
    return c.select("clip_id", clips.frame_time(stamp, F.lit(1 / 30000), F.col("frame_count") - 1, F.col("fps")).alias("time_s"))


@query
def parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as text; what is not two numbers is none."""
    p, k = adapters.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat_ws(",", k, "p_size")).when(k % 4 == 1, F.concat(F.lit(" "), k, F.lit(".5 ,  "), "p_size", F.lit(" "))).when(k % 4 == 2, F.col("p_name")).otherwise(F.concat_ws(",", k, k, k))
    point = readers.parse_point(text)
    return p.select("p_partkey", point[0].alias("x"), point[1].alias("y"))


@query
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals of which some values are NaN or infinite."""
    k, odd = F.col("p_partkey"), lambda v, bad: F.when(F.col("p_partkey") % 5 == bad[0], F.lit(float(bad[1]))).otherwise(v)
    rows = adapters.table(spark, sf_dir, "part").select(k.alias("clip_id"), *[odd((k + i).cast("double"), bad).alias(c) for i, (c, bad) in enumerate({"lx": (0, "nan"), "ly": (1, "inf"), "rx": (2, "-inf"), "ry": (0, "inf"), "crossbar_y": (4, "nan")}.items())])
    return readers.clean(rows)


@query
def untracked_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections without a track have no features."""
    p = adapters.poses(spark, sf_dir).withColumn("track_id", F.when(F.col("det_id") % 3 > 0, F.col("track_id")))
    return feat.pose_features(p).groupBy("track_id").agg(F.count("*").alias("n"), F.count("com_x").alias("placed"))


@query
def set_position_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set position between two frames, both included."""
    return stance.set_positions(features(spark, sf_dir), (10, 30)).select("track_id", FRAME, "cost")


@query
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that were clicked exactly have no error; those with three points have no calibration."""
    known = calibration.located(clicks(spark, sf_dir), calibration.landmarks(spark)).withColumn("hi", g.inverse([F.lit(v) for v in H]))
    first = F.row_number().over(Window.partitionBy("clip_id").orderBy("landmark"))
    known = known.withColumn("j", first).where("clip_id % 2 = 0 or j <= 3")
    image = g.project([F.get("hi", F.lit(i)) for i in range(9)], g.columns("pitch_x", "pitch_y"))
    fitted = calibration.fit(known.select("clip_id", image.x.alias("image_x"), image.y.alias("image_y"), "pitch_x", "pitch_y"))
    return fitted.select("clip_id", F.abs("reproj_err_px").alias("reproj_err_px"), "n_points", "reliable")


@query
def display_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.with_display(adapters.clips(spark, sf_dir)).select("clip_id", "display_width", "display_height", "is_portrait", "is_high_speed")


@query
def device_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.clips(spark, sf_dir).select("clip_id", clips.device_of().alias("device"))


@query
def resolve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clips.with_profile(adapters.clips(spark, sf_dir)).withColumns({"start_s": F.lit(None).cast("double"), "end_s": F.when(F.col("clip_id") % 2 == 0, F.lit(3.5))})
    return out.select("clip_id", "device", "profile", "frame_stride", "target_long_edge", clips.expected_frames().alias("expected"), clips.scale_to().alias("scale"))


@query
def capture_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clips.with_advice(clips.with_profile(adapters.clips(spark, sf_dir)))
    return out.select("clip_id", F.concat_ws(",", "warnings").alias("warnings"), F.concat_ws(",", "tips").alias("tips"))


@query
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.poses(spark, sf_dir)
    return sinks.wide(f, adapters.pose_clips(spark)).drop("clip_id")


@query
def long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.long(adapters.poses(spark, sf_dir)).drop("clip_id")


@query
def trc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.trc_rows(adapters.poses3d(spark, sf_dir), "vec_id", adapters.FPS)


@query
def tumbling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(moves(spark, sf_dir), "event_type", "v", width="1 day")
    return out.select("event_type", F.unix_micros("window_start").alias("start_us"), "n", "mean_value", "max_value")


@query
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(moves(spark, sf_dir), "user_id", gap="6 hours")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")
