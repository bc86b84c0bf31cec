"""Progress, sessions of a stream, data sources, backends as table functions and colours of pictures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import kit
from strideframe.plans import catalogue
from strideframe.sources import adapters, backends, files, sinks
from strideframe.streaming import progress, smoothing, tracking


@pytest.fixture
def detections(spark, sf):
    d = adapters.keeper_boxes(adapters.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k")).where("k between 1 and 3"))
    return d.union(d.where("frame_index % 2 = 0").withColumn("det_id", F.lit(1).cast("bigint")))


def test_a_stream_reports_its_frames_and_people(spark, detections, tmp_path):
    for low in range(0, 120, 40):
        detections.where(f"frame_index between {low} and {low + 39}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = progress.StreamProgress(lambda share, text: told.append((share, text)), expected=360)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(detections.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = progress.watched(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    assert told == [(1 / 3, "frame 120/360, 180 people"), (2 / 3, "frame 240/360, 360 people"), (1.0, "frame 360/360, 540 people")]


def test_a_batch_reports_counts_and_tasks(spark, detections):
    rows, seen = progress.observed(detections)
    told = []
    out = progress.reported(spark, lambda: rows.repartition(40).groupBy("clip_id").count().collect(), lambda share, text: told.append((share, text)), "count", interval_s=0.01)
    assert len(out) == 3 and seen.get == {"frames": 360, "people": 540, "without_box": 0}
    assert told[-1] == (1.0, "count: done") and all(0 <= s <= 1 for s, _ in told)


def test_sessions_of_a_stream_are_those_of_the_batch(spark, sf, tmp_path):
    e = adapters.table(spark, sf, "events").where("user_id < 12").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    for k in range(4):  # every file has rows of all times, some of them late for their session but not for the watermark
        e.where(F.pmod(F.xxhash64("ts", "user_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = e.limit(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit("2099-01-01").cast("timestamp").alias("ts"), "v")
    e.unionByName(last).where("user_id = -1").coalesce(1).write.parquet(str(tmp_path / "end"))
    settings = {"key": "user_id", "at": "ts", "values": ["v"], "fps": 60.0, "cutoff_hz": 8.0, "gap_s": 3 * 86400.0}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tracking.use_rocksdb(spark)
    try:
        def run():
            stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = smoothing.stream_smoothed_sessions(stream, **settings, late="400 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(240)

        run()
        for part in (tmp_path / "end").glob("part-*.parquet"):
            part.rename(tmp_path / "in" / f"end-{part.name}")
        run()  # goes on from the checkpoint; the last row closes every session
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = smoothing.smoothed_sessions(e, **settings)
    of = lambda d: sorted((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in d.collect())
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out"))
    assert of(got) == of(want) and want.select("user_id", "session_start").distinct().count() > want.select("user_id").distinct().count()
    assert want.join(e.withColumnRenamed("v", "raw"), ["user_id", "ts"]).where("abs(v - raw) > 0.01").count() > 10


def test_clip_documents_come_back(spark, sf, tmp_path):
    d = adapters.poses(spark, sf).where("track_id < 3")
    spark.dataSource.register(files.ClipJson)
    sinks.nested(d, adapters.pose_clips(spark), frames_each=20).write.format("clip_json").mode("append").save(str(tmp_path / "docs"))
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == [f"clip-0-{k}.json" for k in range(3)]
    assert json.loads((tmp_path / "docs" / "clip-0-0.json").read_text())["schema_version"] == 1
    back = spark.read.format("clip_json").load(str(tmp_path / "docs"))
    of = lambda x: sorted(map(str, x.select("clip_id", "frame_index", "det_id", "track_id", "kp").collect()))
    assert of(back) == of(d) and len(of(d)) > 100


def test_marker_files_come_back_and_failures_leave_none(spark, sf, tmp_path):
    p = adapters.poses3d(spark, sf).where("vec_id < 90").selectExpr("0L as clip_id", "vec_id div 50 as track_id", "vec_id % 50 as frame_index", "if(vec_id % 9 = 4, null, kp3d) as kp3d")
    spark.dataSource.register(files.Markers)
    for units in ("m", "mm"):
        to = str(tmp_path / units)
        sinks.marker_rows(p, 60.0, units).write.format("trc").option("fps", 60).option("units", units).mode("append").save(to)
        assert sorted(x.name for x in (tmp_path / units).iterdir()) == ["clip-0-track-0.trc", "clip-0-track-1.trc"]
        lines = (tmp_path / units / "clip-0-track-1.trc").read_text().split("\n")
        n = p.where("track_id = 1 and kp3d is not null").count()
        assert lines[2].split("\t")[2] == str(n) and len(lines) == 5 + n + 1 and all(x.count("\t") == 52 for x in lines[5:-1])
        back = {(r.track_id, r.frame_index): np.array(r.kp3d) for r in spark.read.format("trc").load(to).collect()}
        want = {(r.track_id, r.frame_index): np.array(r.kp3d) for r in p.where("kp3d is not null").collect()}
        assert back.keys() == want.keys() and all(np.allclose(back[k], want[k], atol=1e-6) for k in want)
    bad = sinks.marker_rows(p, 60.0).withColumn("line", F.when((F.col("track_id") == 1) & (F.col("frame_index") == 30), F.raise_error("broken").cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("trc").option("fps", 60).mode("append").save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())


def test_a_backend_is_a_table_function(spark, tmp_path):
    log = str(tmp_path / "log")

    class Fake(backends.Backend):
        def note(self, what):
            with open(self.options["log"], "a") as f:
                f.write(what + "\n")

        def setup(self):
            self.note("setup")

        def close(self):
            self.note("close")

        def estimate(self, image):
            if image == b"\xff":
                raise ValueError("no picture")
            return [{"kp": [{"x": float(image[0]), "y": 1.0, "conf": 0.5}], "bbox": {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "score": 1.0}}] * (len(image) - 1)

    backends.BACKENDS["fake"] = Fake
    try:
        spark.udtf.register("pose", backends.table_function("fake", log=log))
    finally:
        del backends.BACKENDS["fake"]
    spark.createDataFrame([(1, f, f / 30, bytes([f] * (1 + f % 3))) for f in range(50)], "clip_id long, frame_index long, ts double, image binary").repartition(3).createOrReplaceTempView("frames")
    got = sorted((r.frame_index, r.det_id, r.kp[0].x, r.bbox.x2) for r in spark.sql("SELECT * FROM pose(TABLE(frames))").collect())
    assert got == [(f, d, float(f), 1.0) for f in range(50) for d in range(f % 3)]
    notes = open(log).read().split()
    assert notes.count("setup") == notes.count("close") >= 1
    spark.createDataFrame([(1, 0, 0.0, b"\xff")], "clip_id long, frame_index long, ts double, image binary").createOrReplaceTempView("frames")
    with pytest.raises(Exception, match="no picture"):
        spark.sql("SELECT * FROM pose(TABLE(frames))").collect()
    notes = open(log).read().split()
    assert notes.count("setup") == notes.count("close")


def test_a_picture_gives_its_colour(spark):
    rng = np.random.default_rng(0)
    for shape in ((3, 5, 3), (4, 6, 3), (1, 1, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert kit.patch_median(pixels) == tuple(np.median(pixels.reshape(-1, 3), axis=0))
    image = np.zeros((40, 60, 3), np.uint8)
    image[10:30, 20:40] = (200, 30, 90)
    kp = [(0.0, 0.0, 0.9)] * 5 + [(18.0, 8.0, 0.9), (42.0, 8.0, 0.9)] + [(0.0, 0.0, 0.9)] * 4 + [(18.0, 32.0, 0.9), (42.0, 32.0, 0.9)] + [(0.0, 0.0, 0.9)] * 4
    unsure = [(x, y, 0.1) for x, y, _ in kp]
    poses = spark.createDataFrame([(1, 7, 0, kp), (1, 8, 0, unsure), (1, 9, 1, kp), (1, 9, 2, kp)], "clip_id long, track_id long, frame_index long, kp array<struct<x: double, y: double, conf: double>>")
    images = spark.createDataFrame([(1, 0, 60, 40, image.tobytes()), (1, 1, 60, 40, b"short")], "clip_id long, frame_index long, width int, height int, pixels binary")
    assert [tuple(r) for r in kit.samples(poses, images).collect()] == [(1, 7, 0, 200.0, 30.0, 90.0)]


@pytest.mark.parametrize("name", ["kit_samples", "kit_keeper"])
def test_a_picture_is_drawn_once_for_its_frame(spark, sf, name):
    """Its size was tested, and so the picture drawn, for every pose, before the frames were made distinct."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length(pixels" in plan and "octet_length(unhex" not in plan
    assert plan.count("unhex(") == 1 and plan.index("Aggregate [", plan.index("unhex(")) > 0  # above the distinct frames


def test_marker_lines_round_as_printf_does(spark):
    """Ties go to the even digit and the exact binary value decides, as in C and in SQL."""
    values = [0.0078125, 0.0234375, -0.0078125, 3.0000005, -4e-7, 0.0, 1234.5, 1e-6, None]
    place = lambda v: {"x": v, "y": v, "z": v}
    rows = spark.createDataFrame([(1, [place(v) for v in values])], "n long, kp3d array<struct<x: double, y: double, z: double>>")
    line = sinks.trc_rows(rows, "n", 60.0).first()["line"]
    assert line.split("\t") == ["1", "0.016667", *["" if v is None else "%.6f" % v for v in values for _ in "xyz"]]


def test_keepers_are_dealt_to_tasks(spark, sf):
    """A small table of keys is one file and one task; the frames made of it are not."""
    keys = spark.range(0, 40, 1, 1).withColumnRenamed("id", "k")
    parts = adapters.keepers(keys, 2).select("clip_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in parts}) == 4 and len(parts) == 40
