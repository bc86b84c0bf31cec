"""Writers: wide tables, nested JSON and report files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.skeleton import COCO17
from strideframe.schema import FRAME

SCHEMA_VERSION = 1


def wide(detections: DataFrame, fps: DataFrame | None = None) -> DataFrame:
    """One row per detection: frame, time_s, track_id and three columns for each joint."""
    rows = detections if fps is None else detections.join(fps.select("clip_id", "fps"), "clip_id")
    time = F.col("ts") if fps is None else F.col(FRAME) / F.col("fps")
    joints = [F.get("kp", F.lit(i))[c].alias(f"{j}_{n}") for i, j in enumerate(COCO17) for c, n in (("x", "x"), ("y", "y"), ("conf", "conf"))]
    return rows.select("clip_id", F.col(FRAME).alias("frame"), time.alias("time_s"), "track_id", *joints)


def long(detections: DataFrame) -> DataFrame:
    """One row per joint."""
    named = F.arrays_zip(F.array(*[F.lit(j) for j in COCO17]).alias("joint"), F.col("kp").alias("k"))
    return detections.select("clip_id", FRAME, "track_id", F.explode(named).alias("z")).select("clip_id", FRAME, "track_id", "z.joint", "z.k.x", "z.k.y", "z.k.conf")


def nested(detections: DataFrame, clips: DataFrame, reports: DataFrame | None = None, frames_each: int = 10_000) -> DataFrame:
    """JSON documents of each clip: video, skeleton, frames of people and the reports.

    A document holds ``frames_each`` frames at most, so that it stays bounded:
    ``part`` numbers the documents of a clip, and the first carries the reports.
    """
    people = F.sort_array(F.collect_list(F.struct("det_id", "track_id", "kp")))
    frames = detections.groupBy("clip_id", FRAME).agg(people.alias("people"))
    listed = frames.groupBy("clip_id", F.expr(f"{FRAME} div {frames_each}").alias("part")).agg(F.sort_array(F.collect_list(F.struct(FRAME, "people"))).alias("frames"))
    video = F.struct(*[c for c in clips.columns if c != "clip_id"])
    out = clips.select("clip_id", video.alias("video")).join(listed, "clip_id")
    fields = ["video", "frames"]
    if reports is not None:
        found = reports.groupBy("clip_id").agg(F.collect_list(F.struct(*[c for c in reports.columns if c != "clip_id"])).alias("goalkeeper"))
        out, fields = out.join(found, "clip_id", "left"), [*fields, F.when(F.col("part") == F.min("part").over(Window.partitionBy("clip_id")), F.col("goalkeeper")).alias("goalkeeper")]
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_utc"), F.array(*[F.lit(j) for j in COCO17]).alias("skeleton"), F.col("part"), *fields)
    return out.select("clip_id", "part", F.to_json(body).alias("value"))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", by: list[str] | None = None) -> None:
    """Parquet, JSON, CSV (flat tables) or text (one string column)."""
    out = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        out = out.option("header", True)
    (out.partitionBy(*by) if by else out).save(path)


def _six(value: Column) -> Column:
    """A number with six digits, rounded by its exact binary value and ties to even, as printf does; format_string rounds ties up."""
    return F.call_function("format_number", value, F.lit("0.000000"))


def _marker_line(order: str, fps: float, scale: float) -> Column:
    cell = lambda c: F.coalesce(_six(c * F.lit(scale)), F.lit(""))
    places = F.transform("kp3d", lambda k: F.concat_ws("\t", *[F.when(k[c].isNull(), F.lit("")).otherwise(cell(k[c])) for c in "xyz"]))
    return F.concat_ws("\t", F.col(order).cast("string"), _six(F.col(order) / F.lit(fps)), F.array_join(places, "\t"))


def trc_rows(rows: DataFrame, order: str, fps: float, scale: float = 1.0) -> DataFrame:
    """order and line: number, seconds and the 3D places of a track's joints, tab-separated, blank where absent."""
    return rows.where("kp3d is not null").select(order, _marker_line(order, fps, scale).alias("line"))


def write_trc(rows: DataFrame, path: str, order: str, fps: float, units: str = "m") -> None:
    """Marker text of one track with 3D places; refused if there are none."""
    lines = trc_rows(rows, order, fps, {"m": 1.0, "mm": 1000.0}[units])
    n = lines.count()
    if not n:
        raise ValueError("the track has no 3D places")
    joints = "\t".join(f"{j}\t\t" for j in COCO17)
    axes = "\t".join(f"X{i}\tY{i}\tZ{i}" for i in range(1, len(COCO17) + 1))
    head = ["PathFileType\t4\t(X/Y/Z)\tmarkers.trc", "DataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames", f"{fps:g}\t{fps:g}\t{n}\t{len(COCO17)}\t{units}\t{fps:g}\t1\t{n}", f"Frame#\tTime\t{joints}", f"\t\t{axes}"]
    top = rows.sparkSession.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "n long, line string")
    # One marker file is one track of one clip, so it is written as one sorted part.
    top.union(lines.select(F.col(order).cast("long").alias("n"), "line")).coalesce(1).sortWithinPartitions("n").select("line").write.text(path)


def marker_rows(rows: DataFrame, fps: float, units: str = "m") -> DataFrame:
    """clip_id, track_id, n and line of tracks with 3D places, each track together and in order: what ``files.Markers`` writes."""
    known = rows.where("kp3d is not null")
    n = F.count("*").over(Window.partitionBy("clip_id", "track_id"))
    scale = {"m": 1.0, "mm": 1000.0}[units]
    lines = known.select("clip_id", "track_id", FRAME, n.alias("n"), _marker_line(FRAME, fps, scale).alias("line"))
    return lines.repartition("clip_id", "track_id").sortWithinPartitions("clip_id", "track_id", FRAME)


def run_name(stem: str, at: datetime | None = None) -> str:
    """A folder name for a run: the stem and the time."""
    return f"{stem}_{(at or datetime.now()):%Y%m%d_%H%M%S}"


def write_all(tables: dict[str, DataFrame], directory: str, formats: list[str]) -> list[str]:
    """Every table in every format; an unknown format or one that fails is named in the result, the others are written."""
    problems = []
    for fmt in formats:
        if fmt not in ("parquet", "json", "csv"):
            problems.append(f"no writer for {fmt}")
            continue
        for name, df in tables.items():
            try:
                write(df, f"{directory}/{fmt}/{name}", fmt)
            except Exception as e:  # noqa: BLE001  each sink stands alone
                problems.append(f"{fmt}/{name}: {type(e).__name__}")
    return problems
