"""The public star-schema tables read as pose data, signals, boxes and clips.

There is no pose data among the test tables; these closed forms give every
operator rows to work on, at any scale factor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.functions.geometry import box_of

FPS = 60.0
#: Frames of a track of ``poses``; their number grows with the table, a track does not.
TRACK_ROWS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kp(x: list[Column], y: list[Column], conf: list[Column]) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y"), c.alias("conf")) for a, b, c in zip(x, y, conf, strict=True)])


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one clip with a track for every TRACK_ROWS of them: 17 keypoints from the first 51 numbers."""
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    kp = _kp([640 + 600 * v(2 * j) for j in range(17)], [360 + 600 * v(2 * j + 1) for j in range(17)], [F.least(F.lit(1.0), 6 * F.abs(v(34 + j))) for j in range(17)])
    return e.select(F.lit(0).cast("bigint").alias("clip_id"), F.expr(f"vec_id div {TRACK_ROWS}").alias("track_id"), F.expr(f"vec_id % {TRACK_ROWS} + 1").alias("frame_index"), F.col("vec_id").alias("det_id"), kp.alias("kp"))


def landmarks33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 33-landmark detections (x and y overlap, as there are 64 numbers)."""
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select("vec_id", _kp([v(k) for k in range(33)], [v(k + 31) for k in range(33)], [F.abs(v(k)) for k in range(33)]).alias("kp"))


def poses3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select("vec_id", F.array(*[F.struct(v(3 * j).alias("x"), v(3 * j + 1).alias("y"), v(3 * j + 2).alias("z")) for j in range(17)]).alias("kp3d"))


DIVE_FRAMES = 120


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows of which each makes much work, shared out to as many tasks as a shuffle has: their bytes would put them into one."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def with_dive_pose(rows: DataFrame) -> DataFrame:
    """rows with ``kp``: the k-th keeper, who dives once, at frame f."""
    k, f = F.col("k"), F.col("f")
    name = lambda x: F.col(f"_{x}")
    side, h, p, x, y, tilt, bend, sx, sy, kx, ky, ax, ay, wy = map(name, "side h p x y tilt bend sx sy kx ky ax ay wy".split())
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f - (40.0 + k % 7)) / 20.0))
    along = lambda d, a: (d * h * F.sin(a), -d * h * F.cos(a))
    steps = [
        {"side": F.when(k % 2 == 0, 1.0).otherwise(-1.0), "u": u, "h": 300.0 + k % 5},
        {"p": name("u") * name("u") * (3 - 2 * name("u"))},
        {"x": 320.0 + 10.0 * (k % 20) + side * (220.0 + 5.0 * (k % 9)) * p + 1.5 * F.sin(0.9 * f + k), "y": 340.0 - 40.0 * F.sin(np.pi * p) + 0.35 * h * p * p + 0.06 * h, "tilt": F.radians(55.0 * side * p), "bend": F.radians(12.5 * (1 - p))},
        {"sx": x + along(0.35, tilt)[0], "sy": y + along(0.35, tilt)[1], "nx": x + along(0.47, tilt)[0], "ny": y + along(0.47, tilt)[1], "kx": x - along(0.22, tilt - bend)[0], "ky": y - along(0.22, tilt - bend)[1]},
        {"ax": kx - along(0.22, tilt + bend)[0], "ay": ky - along(0.22, tilt + bend)[1], "wy": sy + 0.31 * h * (1 - 2 * F.least(F.lit(1.0), 1.4 * p))},
    ]
    out = rows
    for step in steps:
        out = out.withColumns({f"_{n}": c for n, c in step.items()})
    pair = lambda px, py, w: [(px - w * h, py), (px + w * h, py)]
    points = [(name("nx"), name("ny"))] * 5 + pair(sx, sy, 0.1) + pair(sx, (sy + wy) / 2, 0.12) + pair(sx, wy, 0.14) + pair(x, y, 0.06) + pair(kx, ky, 0.07) + pair(ax, ay, 0.12)
    conf = 0.95 - 0.001 * (f % 7)
    made = _kp([a for a, _ in points], [b for _, b in points], [conf] * 17)
    # A generator stands between, or else the optimiser writes these formulas out wherever a joint is read.
    return out.select(*rows.columns, F.inline(F.array(F.struct(made.alias("kp")))).alias("kp"))


def dive_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as clips of one keeper each who dives once, to the right for even keys."""
    return keepers(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k")))


def keepers(keys: DataFrame, frames: int = DIVE_FRAMES) -> DataFrame:
    """The keepers of keys k, frame by frame."""
    rows = dealt(keys, "k").select("k", F.explode(F.expr(f"sequence(0L, {frames - 1}L)")).alias("f"))
    none = F.lit(0).cast("bigint")
    return with_dive_pose(rows).select(F.col("k").alias("clip_id"), none.alias("track_id"), F.col("f").alias("frame_index"), none.alias("det_id"), "kp")


def keeper_boxes(keys: DataFrame, frames: int = DIVE_FRAMES) -> DataFrame:
    """The boxes of the keepers of keys k."""
    return keepers(keys, frames).select("clip_id", "frame_index", "det_id", box_of(F.col("kp")).alias("bbox"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a series for each user: idx, t (seconds) and v."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", "event_type", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), (t - 1.7e9).alias("t"), F.col("value").alias("v"), F.col("ts").cast("timestamp").alias("ts"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the boxes of a frame for each order."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey") % 53
    w, h = F.col("l_quantity") * 2, F.col("l_extendedprice") % 100
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + w).cast("double").alias("x2"), (y + h).cast("double").alias("y2"), F.lit(1.0).alias("score"))
    det = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")
    return li.select(F.col("l_orderkey").cast("bigint").alias("frame_index"), det.alias("det_id"), box.alias("bbox"), (1 - F.col("l_discount")).alias("mean_conf"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as clip metadata."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        k.cast("bigint").alias("clip_id"),
        F.when(k % 3 == 0, 3840).when(k % 3 == 1, 1920).otherwise(1280).cast("int").alias("width"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, 1600).otherwise(2160)).when(k % 3 == 1, 1080).otherwise(720).cast("int").alias("height"),
        F.when(k % 5 == 0, 120.0).when(k % 5 == 1, 24.0).when(k % 5 == 2, 60.0).otherwise(30.0).alias("fps"),
        (F.col("p_size") * 60).cast("bigint").alias("frame_count"),
        (F.pmod(k, F.lit(4)) * 90).cast("int").alias("rotation"),
        F.when(k % 7 < 3, "HEVC").otherwise("h264").alias("codec"),
        (F.col("p_size") * 4).cast("double").alias("duration_s"),
    )


def pose_clips(spark: SparkSession, fps: float = FPS) -> DataFrame:
    """The one clip of ``poses``."""
    return spark.range(1).select(F.col("id").alias("clip_id"), F.lit(fps).alias("fps"))


def dive_clips(spark: SparkSession, sf_dir: str, fps: float = FPS) -> DataFrame:
    """The clips of ``dive_tracks``."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("clip_id"), F.lit(fps).alias("fps"))


def fixed_goals(clips: DataFrame) -> DataFrame:
    """The same goal of 732 pixels for every clip."""
    return clips.select("clip_id", F.lit(120.0).alias("lx"), F.lit(300.0).alias("ly"), F.lit(852.0).alias("rx"), F.lit(300.0).alias("ry"), F.lit(56.0).alias("crossbar_y"))
