"""Kernels, tracking and dives on closed-form inputs, and the streaming operators."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions import signal
from strideframe.operators import calibration, clips, dives, series, tracks
from strideframe.operators import features as feat
from strideframe.sources import adapters, readers, sinks
from strideframe.streaming import tracking, windows


def test_butterworth_coefficients():
    b, a = signal.butterworth(6, 60)
    assert np.allclose(b, [0.00482434, 0.01929737, 0.02894606, 0.01929737, 0.00482434], atol=1e-8)
    assert np.allclose(a, [1, -2.36951301, 2.31398841, -1.05466541, 0.18737949], atol=1e-7)
    b, a = signal.butterworth(8, 60)
    assert np.isclose(b[0], 0.01263428, atol=1e-8) and np.allclose(a[1:], [-1.83542169, 1.56975407, -0.63572338, 0.1035395], atol=1e-7)


def test_low_pass_keeps_slow_moves_and_gaps():
    t = np.arange(120) / 60
    line = np.column_stack([600 * t, np.full(120, 5.0)])
    out = signal.low_pass(line, 60, 6)
    assert np.allclose(out, line, atol=0.5) and np.allclose(out[30:-30], line[30:-30], atol=0.01)
    ramp = np.arange(100.0)[:, None].copy()
    ramp[50] = np.nan
    out = signal.low_pass(ramp, 60, 6)
    assert np.isnan(out[50, 0]) and abs(out[49, 0] - 49) < 0.1 and np.isnan(out).sum() == 1
    noise = np.random.default_rng(0).normal(size=(100, 2))
    assert np.array_equal(signal.low_pass(noise, 30, 20), noise) and np.array_equal(signal.low_pass(noise[:15], 60, 6), noise[:15])
    smooth = signal.low_pass(noise, 60, 4)
    assert smooth.std() < 0.6 * noise.std()


def test_homography_of_four_points():
    image = np.array([[100, 500], [900, 500], [950, 300], [50, 300]], float)
    pitch = np.array([[-20, -30], [20, -30], [20, 10], [-20, 10]], float)
    h = signal.fit_homography(image, pitch)
    out = np.column_stack([image, np.ones(4)]) @ h.T
    assert np.allclose(out[:, :2] / out[:, 2:], pitch, atol=1e-8)
    # One bad click among ten is left out, whatever it is off by.
    rng = np.random.default_rng(3)
    seen = rng.uniform(0, 900, (10, 2))
    ground = np.column_stack([seen, np.ones(10)]) @ h.T
    ground = ground[:, :2] / ground[:, 2:]
    ground[4] += (9.0, -4.0)
    good = signal.fit_robust_homography(seen, ground, 5.0)
    assert len(good[0]) == 9 and np.allclose(signal.fit_homography(*good), h, atol=1e-6) and len(signal.fit_robust_homography(image, pitch, 5.0)[0]) == 4
    assert signal.fit_homography(image[:3], pitch[:3]) is None and signal.fit_homography(np.ones((4, 2)), pitch) is None


def boxes(*frames):
    return [np.array(f, float).reshape(-1, 4) for f in frames]


@pytest.mark.parametrize(("frames", "want"), [
    (boxes(*[[[100 + 4 * i, 100, 200 + 4 * i, 400]] for i in range(20)]), {0}),
    (boxes(*[[[300, 100, 400, 400]]] * 10, *[[[250, 300, 500, 400]]] * 10), {0}),
    (boxes(*[[[0, 0, 100, 300], [600, 0, 700, 300]]] * 15), {0, 1}),
    (boxes([[0, 0, 100, 300]], [[1500, 600, 1600, 900]]), {0, 1}),
])
def test_tracker_links(frames, want):
    tracker = tracks.Tracker(min_hits=1)
    found = [[i for i, _ in tracker.step(f)] for f in frames]
    assert {i for f in found for i in f} == want
    assert all(f == found[0] for f in found) or len(frames) == 2


def test_few_and_many_pairs_link_alike(monkeypatch):
    rng = np.random.default_rng(3)
    frames = []
    for _ in range(60):
        at = rng.uniform(0, 900, (rng.integers(0, 14), 2)).round(-1)
        frames.append(np.hstack([at, at + rng.integers(20, 200, at.shape)]))
    found = []
    for few in (0, 10_000):
        monkeypatch.setattr(tracks, "FEW_PAIRS", few)
        tracker = tracks.Tracker(max_age=4)
        found.append([tracker.step(f) for f in frames])
    assert found[0] == found[1] and max(t for f in found[0] for t, _ in f) > 30


def test_tracker_forgets_after_max_age():
    tracker = tracks.Tracker(max_age=3)
    tracker.step(boxes([[0, 0, 10, 10]])[0])
    for _ in range(7):
        tracker.step(np.zeros((0, 4)))
    assert not tracker.trails
    again = tracks.Tracker().load(*tracks.Tracker().dump())
    assert again.next_id == 0


def detection(i, box, conf=0.9, clip=0, frame=0):
    return Row(clip_id=clip, frame_index=frame, det_id=i, bbox=None if box is None else Row(x1=float(box[0]), y1=float(box[1]), x2=float(box[2]), y2=float(box[3]), score=1.0), mean_conf=conf)


KIND = "clip_id long, frame_index long, det_id long, bbox struct<x1: double, y1: double, x2: double, y2: double, score: double>, mean_conf double"


def test_duplicates_of_a_frame(spark):
    rows = [detection(0, (747, 470, 905, 691), 0.9, frame=0), detection(1, (760, 516, 862, 616), 0.6, frame=0), detection(0, (0, 0, 100, 300), frame=1), detection(1, (400, 0, 500, 300), frame=1), detection(0, (0, 0, 100, 100), 0.4, frame=2), detection(1, (2, 2, 102, 102), 0.95, frame=2), detection(2, None, 0.1, frame=2)]
    out = tracks.suppress_duplicates(spark.createDataFrame(rows, KIND), ["clip_id", "frame_index"])
    assert sorted((r.frame_index, r.det_id) for r in out.collect()) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]


@pytest.fixture
def clip_stream(spark, sf, tmp_path):
    """Boxes of clips with event times, a folder that a stream reads one file at a time, and the stream's rows so far."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    keepers = adapters.dive_tracks(spark, sf).where("clip_id < 4").select("clip_id", "frame_index", "det_id", g.box_of(F.col("kp")).alias("bbox"))
    # A second person far to the right who is away for 50 frames.
    other = keepers.where("clip_id < 3 and not frame_index between 40 and 89").withColumns({"det_id": F.lit(1).cast("bigint"), "bbox": F.struct(*[(F.col(f"bbox.{c}") + (1500 if c in ("x1", "x2") else 0)).alias(c) for c in ("x1", "y1", "x2", "y2", "score")])})
    told = spark.createDataFrame([(k, start, 60.0) for k in range(10)], "clip_id long, started timestamp, fps double")
    boxes = tracking.frame_times(keepers.union(other), told).cache()
    tracking.use_rocksdb(spark)
    n = [0]

    def arrives(rows):
        rows.coalesce(1).write.json(str(tmp_path / f"one{n[0]}"))
        (part,) = (tmp_path / f"one{n[0]}").glob("part-*.json")
        (tmp_path / "in").mkdir(exist_ok=True)
        to = tmp_path / "in" / f"{n[0]:03}.json"
        part.rename(to)
        os.utime(to, (1_700_000_000 + n[0],) * 2)
        n[0] += 1

    def beat(seconds):
        """A row without a box, so much later."""
        arrives(boxes.limit(1).select(F.lit(99).cast("bigint").alias("clip_id"), "frame_index", "det_id", F.lit(None).cast(boxes.schema["bbox"].dataType).alias("bbox"), (F.lit(start) + F.expr(f"interval {seconds} seconds")).alias("at")))

    def run(late="2 seconds", idle_s=600.0, table="out"):
        stream = spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = tracking.stream_tracks(stream, late=late, idle_s=idle_s).writeStream.format("parquet").option("path", str(tmp_path / table)).option("checkpointLocation", str(tmp_path / f"{table}-ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        return sorted(tuple(r) for r in spark.read.schema(tracking.OUT).parquet(str(tmp_path / table)).collect())

    want = sorted((r.clip_id, r.frame_index, r.det_id, r.track_id, r.confirmed) for r in tracks.track_boxes(boxes.withColumn("mean_conf", F.lit(1.0))).collect())
    yield boxes, arrives, beat, run, want
    boxes.unpersist()


def test_stream_of_shuffled_batches_tracks_like_the_batch(clip_stream):
    boxes, arrives, beat, run, want = clip_stream
    for k in range(5):  # every file has frames from everywhere in the clips
        arrives(boxes.where(F.pmod(F.xxhash64("clip_id", "frame_index", "det_id"), F.lit(5)) == k).orderBy(F.desc("frame_index")))
    beat(60)
    assert run() == want and len({r[3] for r in want if r[0] == 1}) == 3


def test_stream_goes_on_from_its_checkpoint(clip_stream):
    boxes, arrives, beat, run, want = clip_stream
    seen = []
    for low, high in ((0, 29), (30, 64), (65, 119)):
        arrives(boxes.where(F.col("frame_index").between(low, high)))
        seen.append(len(run(late="100 milliseconds")))  # a query of its own each time
    beat(60)
    assert run(late="100 milliseconds") == want and 0 < seen[0] < seen[1] < seen[2] < len(want)


def test_stream_ids_survive_a_silent_clip(spark, clip_stream):
    """A clip that is silent for longer than idle_s starts new tracks, with ids that it has not had."""
    boxes, arrives, beat, run, want = clip_stream
    arrives(boxes)
    beat(10)
    beat(30)
    later = boxes.where("clip_id = 1").withColumns({"frame_index": F.col("frame_index") + 3600, "at": F.col("at") + F.expr("interval 60 seconds")})
    arrives(later)
    beat(120)
    got = run(idle_s=5.0)
    whole = tracks.track_boxes(boxes.unionByName(later).withColumn("mean_conf", F.lit(1.0))).collect()
    assert got == sorted((r.clip_id, r.frame_index, r.det_id, r.track_id, r.confirmed) for r in whole)
    early, late = ({r[3] for r in got if r[0] == 1 and (r[1] >= 3600) == x} for x in (False, True))
    assert early and late and not early & late


def test_stream_leaves_rows_behind_the_watermark_out(clip_stream):
    boxes, arrives, beat, run, want = clip_stream
    arrives(boxes.where("frame_index < 30 or frame_index between 60 and 69"))
    beat(1.3)  # the watermark is behind frame 77 less the wait
    arrives(boxes.where("frame_index between 30 and 49 or frame_index >= 80"))
    beat(60)
    got = run(late="100 milliseconds")
    assert {r[1] for r in got} == {f for f in range(120) if f < 30 or 60 <= f < 70 or f >= 80}


def test_windows_on_a_stream_drop_nothing_in_time(spark, sf, tmp_path):
    rows = adapters.signals(spark, sf).select("event_type", "v", "ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "event_type", "v", width="1 day").writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.tumbling(rows, "event_type", "v", width="1 day")
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, batch.collect()))


def test_every_keeper_dives_once(spark, sf):
    f = feat.pose_features(adapters.dive_tracks(spark, sf))
    out = dives.detect_dives(dives.dive_signals(f, adapters.dive_clips(spark, sf))).collect()
    assert len(out) == 10
    for r in out:
        assert r.direction == ("right" if r.clip_id % 2 == 0 else "left") and 1 < r.peak_speed_bh_s < 15
        assert r.set_frame <= r.takeoff <= r.peak_frame <= r.landing and r.set_frame < 47 and r.preparatory_start <= r.takeoff


def test_a_side_step_is_no_dive(spark):
    still = adapters.with_dive_pose(spark.range(90).select("id", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("f")))
    moved = F.transform("kp", lambda k: F.struct((k["x"] + 6 * F.col("id")).alias("x"), k["y"].alias("y"), k["conf"].alias("conf")))
    d = still.select(F.lit(0).cast("bigint").alias("clip_id"), F.lit(0).cast("bigint").alias("track_id"), F.col("id").alias("frame_index"), moved.alias("kp"))
    assert dives.detect_dives(dives.dive_signals(feat.pose_features(d), adapters.pose_clips(spark))).count() == 0


def test_features_of_absent_joints(spark):
    d = spark.createDataFrame([(0, 1, 1, [(1.0, 2.0, 0.9)] * 3), (0, 1, 2, []), (0, 1, 3, None), (0, None, 4, [])], "clip_id long, track_id long, frame_index long, kp array<struct<x: double, y: double, conf: double>>")
    out = feat.pose_features(d).collect()
    assert len(out) == 3 and all(r.com_x is None and r.height_px is None for r in out)


def test_gaps_and_interpolation(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 4, 4.0), ("b", 2, None)], "k string, i long, v double")
    dense = series.gap_fill(d, ["k"], "i", "v")
    full = dense.select("k", "i", series.interpolated(F.col("v"), F.col("i"), ["k"], "i").alias("v"))
    assert sorted(map(tuple, full.collect())) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 4.0), ("b", 2, 0.0)]


def test_refractory_keeps_the_stronger(spark):
    d = spark.createDataFrame([(0, 0.0, 5.0), (0, 0.3, 9.0), (0, 0.6, 1.0), (0, 1.2, 2.0)], "k int, t double, v double")
    assert sorted((r.t, r.v) for r in series.refractory(d, ["k"], "t", "v", 0.4).collect()) == [(0.3, 9.0), (1.2, 2.0)]


def plain_refractory(rows, gap):
    kept = []
    for t, v in sorted(rows):
        if not kept or t - kept[-1][0] >= gap:
            kept.append((t, v))
        elif v > kept[-1][1]:
            kept[-1] = (t, v)
    return kept


def test_refractory_is_the_plain_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(t), float(v)) for k, t, v in zip(rng.integers(0, 5, 4000), rng.integers(0, 3000, 4000) / 4, rng.integers(0, 6, 4000), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # state passes from batch to batch
    try:
        out = series.refractory(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v", 0.6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(5):
        assert sorted((r.t, r.v) for r in out if r.k == k) == plain_refractory([(t, v) for i, t, v in rows if i == k], 0.6)


def test_a_long_key_takes_time_in_proportion(spark):
    import time

    n = 200_000
    rows = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 977 == 5, F.col("id").cast("double")).alias("v"), (F.col("id") / 50).alias("t"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("s"))
    began = time.perf_counter()
    out = rows.select("i", series.interpolated(F.col("v"), F.col("i"), ["k"], "i").alias("v")).where("i between 5 and 199000").agg(F.max(F.abs(F.col("v") - F.col("i")))).first()[0]
    assert out < 1e-6
    kept = series.refractory(rows, ["k"], "t", "s", 0.5).agg(F.count("*"), F.min(F.col("s"))).first()
    assert 0 < kept[0] <= n / 25 + 1
    assert time.perf_counter() - began < 60


def test_phases_of_many_dives_of_a_long_track(spark):
    n = 60_000
    speed = F.when(F.col("id") % 600 >= 580, 3.0).otherwise(0.5 + F.pmod(F.col("id"), F.lit(7)) / 100)
    lift = F.when(F.col("id") % 600 >= 585, 0.2).otherwise(1.0)
    rows = spark.range(n).select(F.lit(0).cast("bigint").alias("clip_id"), F.lit(0).cast("bigint").alias("track_id"), (F.col("id") + 10).alias("frame_index"), F.col("id").alias("i"), F.lit(n).cast("bigint").alias("n"), F.lit(60.0).alias("fps"), F.lit(300.0).alias("reference_px"), speed.alias("speed"), lift.alias("ankle_bh"), F.lit(0.0).alias("com_x"), F.lit(40.0).alias("lean_deg"), F.lit(0.3).alias("reach_bh"), F.lit(0.3).alias("com_h_bh"), F.lit(0.9).alias("mean_conf"))
    out = {r.start_frame: r for r in dives.detect_dives(rows).collect()}
    assert len(out) == 100 and all(r.takeoff == s and r.preparatory_start == s and r.flight_start == s + 5 and r.landing == s + 19 for s, r in out.items())
    plain = np.array([3.0 if i % 600 >= 580 else 0.5 + i % 7 / 100 for i in range(n)])
    for start in (580, 1180, 30_580):
        begin = max(0, start - 6001)
        assert out[start + 10].set_frame == begin + int(np.argmin(plain[begin:start])) + 10


def test_many_dives_cost_little_more_than_few():
    """What a dive asks of the rows before it: 10,000 dives of a track of 200,000 rows within twice the time of 100."""
    import time

    n, took = 200_000, {}
    for dives_each in (100, 10_000):
        gap = n // dives_each
        v = np.where(np.arange(n) % gap >= gap - 6, 3.0, 0.5 + np.arange(n) % 7 / 100)
        ones = np.ones(n)
        began = time.perf_counter()
        out = dives.track_dives(60 * ones, 300 * ones, v, 0 * ones, 40 * ones, 0.3 * ones, 0.3 * ones, np.where(np.arange(n) % gap >= gap - 2, 0.2, 1.0), 0.9 * ones, np.arange(n), 1.2, 4, 25.0)
        took[dives_each] = time.perf_counter() - began
        assert len(out) == dives_each and all(r[-1] == r[2] + 4 and r[-2] == r[2] for r in out[:50])
    assert took[10_000] < 2 * took[100] + 0.5


def test_running_medians_are_medians():
    rng, seen = np.random.default_rng(1), signal.RunningMedian()
    assert np.isnan(seen.value())
    values = rng.integers(0, 20, 300) / 4
    for k, v in enumerate(values, 1):
        seen.add(float(v))
        assert seen.value() == np.median(values[:k])


def test_dives_read_their_signals_once(spark, sf):
    rows = feat.pose_features(adapters.dive_tracks(spark, sf))
    plan = dives.detect_dives(dives.dive_signals(rows, adapters.dive_clips(spark, sf)))._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :]
    assert plan.count("Generate explode") == 1 and plan.count("FileScan") == 2  # the tracks and the clips


def test_kicks_read_their_whole_tail_at_high_frame_rates(spark):
    """1000 frames a second: 50 rows count behind a peak, not 32."""
    from strideframe.operators import events

    ankle = [float(x) for x in np.cumsum([0.0] * 20 + [1.0, 3.0, 6.0, 3.0] + [2.9] * 40 + [0.0] * 60)]
    rows = [(0, 0, f, [(100.0, 100.0, 0.9)] * 15 + [(x, 400.0, 0.9 if f < 60 else 0.5), (50.0, 400.0, 0.0)], 300.0) for f, x in enumerate(ankle)]
    d = spark.createDataFrame(rows, "clip_id long, track_id long, frame_index long, kp array<struct<x: double, y: double, conf: double>>, height_px double")
    out = events.detect_kicks(d, adapters.pose_clips(spark, 1000.0), cutoff_hz=None).collect()
    assert len(out) == 1
    seen = [0.9 if f < 60 else 0.5 for f in range(out[0].frame_index, out[0].frame_index + 50)]
    assert abs(out[0].confidence - sum(seen) / 50) < 1e-9 and out[0].deceleration_bh_s2 < -1000


def test_readers_turn_nan_into_null(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0, 3.0, float("nan"), 5.0, float("inf"))], "clip_id long, lx double, ly double, rx double, ry double, crossbar_y double")
    d.write.parquet(str(tmp_path / "g"))
    assert tuple(readers.read(spark, "goals", str(tmp_path / "g")).first()) == (1, 2.0, 3.0, None, 5.0, None)
    texts = spark.createDataFrame([("410,520",), (" 1.5 , 2",), ("1,2,3",), ("a,b",), (None,)], "t string")
    assert [r.p for r in texts.select(readers.parse_point(F.col("t")).alias("p")).collect()] == [[410.0, 520.0], [1.5, 2.0], None, None, None]


def test_sinks_write_what_they_say(spark, sf, tmp_path):
    d = adapters.poses(spark, sf).where("track_id < 2")
    wide = sinks.wide(d, adapters.pose_clips(spark))
    assert len(wide.columns) == 4 + 51
    sinks.write(wide, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == d.count()
    text = sinks.nested(d, adapters.pose_clips(spark), d.select("clip_id", F.lit(3).alias("dives")).limit(1), frames_each=20)
    parts = {r.part: json.loads(r.value) for r in text.collect()}
    assert sorted(parts) == [0, 1, 2] and [len(parts[k]["frames"]) for k in range(3)] == [19, 20, 11]  # frames 1 to 50
    assert parts[0]["goalkeeper"] == [{"dives": 3}] and "goalkeeper" not in parts[1] and all(p["schema_version"] == 1 for p in parts.values())
    assert sinks.run_name("clip", datetime(2024, 5, 6, 7, 8, 9)) == "clip_20240506_070809"


def test_unknown_names_are_refused(spark):
    from strideframe.functions.skeleton import layout

    with pytest.raises(KeyError):
        layout("nothing")
    with pytest.raises(KeyError):
        clips.with_profile(spark.createDataFrame([], "clip_id long"), "nothing")
    assert calibration.landmarks(spark).count() == 21


def test_low_pass_over_groups(spark):
    pdf = pd.DataFrame({"k": [0] * 30 + [1] * 10, "i": [*range(30), *range(10)], "v": np.random.default_rng(1).normal(size=40)})
    out = series.filtered(spark.createDataFrame(pdf), ["k"], "i", ["v"], F.lit(60.0), 6.0).toPandas().sort_values(["k", "i"], ignore_index=True)
    assert np.allclose(out["v"][:30], signal.low_pass(pdf[["v"]].to_numpy()[:30], 60, 6)[:, 0]) and np.allclose(out["v"][30:], pdf["v"][30:])


def test_low_pass_by_the_clock_sees_gaps_and_strides(spark):
    """Rows of every frame, filtered, are what the rows that are left give when every second one or a stretch is absent."""
    t = np.arange(400)
    wave = 100 * np.sin(t / 25)  # slow beside the cutoff
    rows = [(k, int(i), float(wave[i] + (8 if i % 4 < 2 else -8)), 60.0, 2 if k == "strided" else 1) for k in ("whole", "strided", "gap") for i in t if not (k == "strided" and i % 2) and not (k == "gap" and 150 <= i < 180)]
    d = spark.createDataFrame(rows, "k string, i long, v double, fps double, frame_stride int")
    out = {(r.k, r.i): r.v for r in series.filtered_in_time(d, ["k"], "i", ["v"], "fps", 5.0, "frame_stride").collect()}
    assert len(out) == len(rows)
    inner = [i for i in range(40, 360) if i % 2 == 0 and not 110 <= i < 220]
    by_rows = {(r.k, r.i): r.v for r in series.filtered(d, ["k"], "i", ["v"], F.col("fps"), 5.0).collect()}
    assert all(out["whole", i] == by_rows["whole", i] for i in range(400))
    assert max(abs(out["gap", i] - out["whole", i]) for i in inner) < 0.5
    assert max(abs(out["strided", i] - wave[i]) for i in inner) < 2 * max(abs(out["whole", i] - wave[i]) for i in inner) + 1
    expect = signal.low_pass(np.array([[wave[i] + (8 if i % 4 < 2 else -8)] for i in t[::2]]), 30.0, 5.0)[:, 0]
    assert np.allclose([out["strided", i] for i in t[::2].tolist()], expect)


def test_marker_text_and_formats(spark, sf, tmp_path):
    rows = adapters.poses3d(spark, sf).where("vec_id < 20")
    sinks.write_trc(rows, str(tmp_path / "trc"), "vec_id", 60.0)
    lines = [r.value for r in spark.read.text(str(tmp_path / "trc")).collect()]
    assert len(lines) == 25 and lines[3].startswith("Frame#") and all(x.count("\t") == 52 for x in lines[5:])
    with pytest.raises(ValueError):
        sinks.write_trc(rows.limit(0), str(tmp_path / "none"), "vec_id", 60.0)
    assert sinks.write_all({"a": rows.select("vec_id"), "b": rows}, str(tmp_path / "out"), ["csv", "png", "json"]) == ["csv/b: AnalysisException", "no writer for png"]


def test_the_tracker_hands_other_columns_on_in_arrow(spark):
    """Keypoints went through pandas row by row; what the tracker does not read stays as it is, nulls and stamps too."""
    schema = "clip_id long, frame_index long, det_id long, bbox struct<x1: double, y1: double, x2: double, y2: double>, mean_conf double, kp array<struct<x: double, y: double>>, at timestamp, word string"
    rows = [(c, f, d, (100.0 * d, 0.0, 100.0 * d + 50, 90.0) if f % 5 else None, 0.9, [(0.1, None), None] if f % 2 else None, datetime(2026, 1, 1, 0, 0, f, 1), None if f % 3 else "é") for c in range(3) for f in range(12) for d in (0, 1)]
    df = spark.createDataFrame(rows, schema)
    out = tracks.track_boxes(df, tracks.Tracker(min_hits=2))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    found = out.orderBy("clip_id", "frame_index", "det_id").collect()
    assert [tuple(r)[:-2] for r in found] == [tuple(r) for r in df.orderBy("clip_id", "frame_index", "det_id").collect()]
    assert [r.track_id for r in found] == [(r.det_id if r.frame_index % 5 else None) for r in found]
    assert [r.confirmed for r in found] == [r.frame_index % 5 > 0 and r.frame_index > 1 for r in found]
