"""Where a keeper stood, how far they went, and which track is the keeper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.operators import series
from strideframe.operators.features import usable_columns
from strideframe.schema import FRAME, TRACK


def with_goal(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows beside their clip's goal (one row a clip; without one the goal's columns are NULL)."""
    return rows.join(goals.select("clip_id", "lx", "ly", "rx", "ry", "crossbar_y"), "clip_id", "left")


def offsets(rows: DataFrame, goals: DataFrame, x: str = "com_x", y: str = "com_y", size: tuple[float, float] = g.REGULAR) -> DataFrame:
    """lateral_m, depth_m, coverage, in_area, in_mouth and px_per_m of a point of each row."""
    goal, p = g.Goal.of(size=size), g.columns(x, y)
    out = with_goal(rows, goals)
    return out.withColumns({"px_per_m": goal.px_per_m, "lateral_m": goal.lateral_m(p), "depth_m": goal.depth_m(p), "coverage": goal.coverage(p), "in_area": goal.in_area(p), "in_mouth": goal.in_mouth(p)})


def positioning(features: DataFrame, goals: DataFrame, clips: DataFrame, cutoff_hz: float | None = 6.0, size: tuple[float, float] = g.REGULAR, even_time: bool = False) -> DataFrame:
    """One row per track: frames, distance, peak speed and, with a goal, depth, coverage and time in the area.

    Tracks with fewer than two usable rows have counts only. even_time: the low-pass goes by the clock (``series.filtered_in_time``).
    """
    rows = usable_columns(features).join(series.rates(clips), "clip_id")
    path = series.smoothed(rows, TRACK, FRAME, ["com_x", "com_y"], cutoff_hz, even_time)
    w = series.over(TRACK, FRAME)
    ref = F.expr("percentile(height_px, 0.5)").over(Window.partitionBy(*TRACK))
    path = path.withColumn("reference_px", ref).withColumns({"step_px": series.step_length(F.col("com_x"), F.col("com_y"), w), "speed": F.hypot(*[series.uniform_gradient(F.col(c), 1.0, w) for c in ("com_x", "com_y")]) * F.col("fps") / F.col("reference_px")})
    placed = offsets(path, goals, size=size)
    many = F.count("*") >= 2
    of = lambda c: F.when(many, c)
    fraction = lambda c: F.avg(F.col(c).cast("double"))
    return placed.groupBy(*TRACK).agg(
        F.count("*").alias("frames_analysed"),
        of(F.sum(F.col("step_px") / F.col("reference_px"))).alias("distance_covered_bh"),
        of(F.max("speed")).alias("peak_speed_bh_s"),
        of(F.median("depth_m")).alias("median_depth_m"),
        of(F.percentile("depth_m", 0.95) - F.percentile("depth_m", 0.05)).alias("depth_range_m"),
        of(F.median("coverage")).alias("median_coverage"),
        of(fraction("in_area")).alias("time_in_goal_area"),
        of(F.sum("step_px") / F.first("px_per_m")).alias("distance_covered_m"),
    )


def mouth_position(coverage) -> object:  # noqa: ANN001
    """Third of the mouth that a median coverage falls into."""
    return F.when(coverage < 0.35, "left").when(coverage > 0.65, "right").when(coverage.isNotNull(), "central")


def score_geometry(features: DataFrame, goals: DataFrame, min_frames: int = 10, size: tuple[float, float] = g.REGULAR) -> DataFrame:
    """Scores of tracks by closeness to the line, stay within the mouth and stillness, best first."""
    path = features.where("com_x is not null and com_y is not null").select(*TRACK, FRAME, "com_x", "com_y")
    w = series.over(TRACK, FRAME)
    placed = offsets(path.withColumn("step_px", series.step_length(F.col("com_x"), F.col("com_y"), w)), goals, size=size).where("px_per_m is not null")
    by = placed.groupBy(*TRACK).agg(F.count("*").alias("frames"), F.min(FRAME).alias("first_frame"), F.median("depth_m").alias("median_depth_m"), F.avg(F.col("in_mouth").cast("double")).alias("within_mouth"), (F.sum("step_px") / F.first("px_per_m")).alias("distance_m")).where(F.col("frames") >= min_frames)
    proximity = F.exp(-F.greatest(F.lit(0.0), F.col("median_depth_m")) / 8.0)
    stillness = F.exp(-(F.col("distance_m") / F.col("frames")) / 0.05)
    return by.withColumn("score", 0.55 * proximity + 0.25 * F.col("within_mouth") + 0.20 * stillness)


def ranked(candidates: DataFrame, score: str = "score") -> DataFrame:
    """candidates of each clip with ``rank`` from 1: by score, then by first appearance, then by id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc(score), "first_frame", "track_id")))


def uncertain(candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """clip_id, candidates, score and uncertain: more than one candidate and the best one scores under ``least``."""
    by = candidates.groupBy("clip_id").agg(F.count("*").alias("candidates"), F.max("score").alias("score"))
    return by.withColumn("uncertain", (F.col("candidates") > 1) & (F.col("score") < least))


def score_colour(samples: DataFrame, min_samples: int = 5) -> DataFrame:
    """Scores of tracks by how far their kit's colour is from the clip's median; samples have r, g, b.

    Clips with fewer than two tracks of enough samples give no rows.
    """
    channels = ("r", "g", "b")
    by = samples.groupBy(*TRACK).agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in channels], F.min(FRAME).alias("first_frame")).where(F.col("n") >= min_samples)
    clip = Window.partitionBy("clip_id")
    middle = by.withColumns({f"m{c}": F.expr(f"percentile({c}, 0.5)").over(clip) for c in channels}).withColumn("_tracks", F.count("*").over(clip)).where("_tracks >= 2")
    far = middle.withColumn("distance", F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in channels), F.lit(0.0))))
    return far.withColumn("score", F.col("distance") / F.coalesce(F.nullif(F.max("distance").over(clip), F.lit(0.0)), F.lit(1.0))).select(*TRACK, "n", "first_frame", "distance", "score")


def identify(features: DataFrame, goals: DataFrame | None = None, manual: dict[int, int] | None = None, colours: DataFrame | None = None, size: tuple[float, float] = g.REGULAR) -> DataFrame:
    """The keeper's track of each clip and how it was found: manual, geometry, colour or longest."""
    from strideframe.operators.tracks import longest_track

    found = []
    if manual:
        pairs = F.create_map(*[F.lit(x) for kv in manual.items() for x in kv])
        known = features.select(*TRACK).distinct()
        found.append(known.where(F.element_at(pairs, F.col("clip_id")) == F.col("track_id")).select(*TRACK, F.lit("manual").alias("method"), F.lit(1.0).alias("score"), F.lit(0).alias("_order")))
    if goals is not None:
        found.append(ranked(score_geometry(features, goals, size=size)).where("rank = 1").select(*TRACK, F.lit("geometry").alias("method"), "score", F.lit(1).alias("_order")))
    if colours is not None:
        found.append(ranked(score_colour(colours)).where("rank = 1").select(*TRACK, F.lit("colour").alias("method"), "score", F.lit(2).alias("_order")))
    found.append(longest_track(features).select(*TRACK, F.lit("longest").alias("method"), F.lit(0.3).alias("score"), F.lit(3).alias("_order")))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    first = F.min_by(F.struct("track_id", "method", "score"), "_order")
    return every.groupBy("clip_id").agg(first.alias("b")).select("clip_id", "b.*")
