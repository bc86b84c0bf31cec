"""Readers of clips and detections with fixed schemas; NaN and infinities become NULL here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.schema import CALIBRATIONS, CLIPS, DETECTIONS, GOALS, SHOTS

SCHEMAS = {"clips": CLIPS, "detections": DETECTIONS, "goals": GOALS, "calibrations": CALIBRATIONS, "shots": SHOTS}


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clean_keypoints(kp: Column) -> Column:
    return F.transform(kp, lambda k: F.struct(*[finite(k[n]).alias(n) for n in ("x", "y", "conf")]))


def clean(df: DataFrame) -> DataFrame:
    """Doubles, keypoints and boxes without NaN or infinities."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[name] = finite(F.col(name))
    if "kp" in df.columns:
        out["kp"] = clean_keypoints(F.col("kp"))
    if "bbox" in df.columns:
        b = F.col("bbox")
        out["bbox"] = F.when(b.isNotNull(), F.struct(*[finite(b[n]).alias(n) for n in ("x1", "y1", "x2", "y2", "score")]))
    return df.withColumns(out) if out else df


def read(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of the engine from Parquet, JSON or (flat ones) CSV."""
    return clean(spark.read.format(fmt).options(**options).schema(SCHEMAS[kind]).load(path))


def read_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Detections as they arrive in a folder."""
    return clean(spark.readStream.format(fmt).options(**options).schema(DETECTIONS).load(path))


def parse_point(text: Column) -> Column:
    """'410,520' as array(x, y); NULL if it is anything else."""
    parts = F.split(F.trim(text), r"\s*,\s*")
    both = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 2) & F.forall(both, lambda v: v.isNotNull()), both)


def from_pixels(kp: Column, scale: Column) -> Column:
    """Keypoints of a downscaled image in the pixels of the original."""
    return F.transform(kp, lambda k: F.struct((k["x"] / scale).alias("x"), (k["y"] / scale).alias("y"), k["conf"].alias("conf")))


def from_normalised(kp: Column, width: Column, height: Column) -> Column:
    """Landmarks in shares of the image as pixels; places outside the image are kept."""
    return F.transform(kp, lambda k: F.struct((k["x"] * width).alias("x"), (k["y"] * height).alias("y"), F.coalesce(k["conf"], F.lit(0.0)).alias("conf")))


def rotate(kp: Column, rotation: Column, width: Column, height: Column) -> Column:
    """Keypoints of a frame turned clockwise by quarter turns."""

    def one(k: Column) -> Column:
        x, y, turn = k["x"], k["y"], F.pmod(rotation, F.lit(360))
        return F.struct(F.when(turn == 90, height - 1 - y).when(turn == 180, width - 1 - x).when(turn == 270, y).otherwise(x).alias("x"), F.when(turn == 90, x).when(turn == 180, height - 1 - y).when(turn == 270, width - 1 - x).otherwise(y).alias("y"), k["conf"].alias("conf"))

    return F.transform(kp, one)
