"""Settings, backends and the whole clip pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strideframe.plans import pipeline
from strideframe.plans.config import Config, ConfigError
from strideframe.sources import adapters, backends, store


def test_settings_are_strict():
    c = Config.from_dict({"tracking": {"max_age": 45}, "goalkeeper": {"enabled": True}})
    assert c.tracking.max_age == 45 and c.goalkeeper.enabled and c.pose.min_person_confidence == 0.4
    assert Config.from_dict(c.to_dict()) == c
    assert Config.from_yaml(c.to_yaml()) == c and Config.from_yaml("") == Config()
    for bad in ({"nothing": 1}, {"tracking": {"age": 1}}, {"video": 3}, {"analysis": {"filter_order": 2}}, {"goalkeeper": {"identification": "guess"}}, {"goalkeeper": {"identification": "manual"}}, {"goalkeeper": {"goal_width_m": 0}}, {"output": {"overlay_video": True}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad)


@pytest.mark.parametrize(("path", "value"), [("video.apply_rotation", False), ("video.decoder", "opencv"), ("pose.backend", "sapiens"), ("pose.backend_options", {"a": 1}), ("pose.min_joint_confidence", 0.5), ("calibration.assumed_player_height_m", 1.9)])
def test_settings_without_effect_are_refused(path, value):
    section, name = path.split(".")
    with pytest.raises(ConfigError, match=path):
        Config.from_dict({section: {name: value}})


def test_the_device_preset_and_the_output_directory_act(spark):
    from strideframe import __main__ as cli
    from strideframe.operators import clips

    d = spark.createDataFrame([(1, 1920, 1080, 30.0, 100, 0, "h264", 3.0)], "clip_id long, width int, height int, fps double, frame_count long, rotation int, codec string, duration_s double")
    of = lambda preset: clips.with_profile(d, None, preset).first().device
    assert (of(None), of("action_cam"), of("no such")) == ("android_midrange", "action_cam", "generic")
    assert cli.settings(cli.parser().parse_args(["run", "a", "b"])).output.directory == "outputs" and cli.settings(cli.parser().parse_args(["run", "a", "b", "-o", "c"])).output.directory == "c"


def test_backends_say_what_they_are(spark):
    assert backends.default() is None and [n for n, _ in backends.listing()] == ["mediapipe", "posepipeline", "rtmpose", "sapiens"]
    with pytest.raises(backends.BackendNotAvailable):
        backends.get("sapiens").estimate(b"")
    with pytest.raises(KeyError):
        backends.get("none")
    with pytest.raises(ValueError):
        backends.register("mediapipe")(backends.Backend)


def clips_of(spark, sf):
    return adapters.dive_clips(spark, sf).select("clip_id", "fps", F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(0).alias("rotation"), F.lit("h264").alias("codec"), F.lit(120).cast("bigint").alias("frame_count"), F.lit(2.0).alias("duration_s"))


def test_a_keeper_is_found_and_reported(spark, sf):
    d = adapters.dive_tracks(spark, sf).where("clip_id < 3").drop("track_id").withColumn("bbox", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double, score: double>"))
    c = Config.from_dict({"goalkeeper": {"enabled": True, "goal_posts": [[120, 300], [852, 300]]}})
    out = pipeline.run(clips_of(spark, sf).where("clip_id < 3"), d, c)
    assert {r.clip_id for r in out.keepers.collect()} == {0, 1, 2}
    assert [(r.clip_id, r.direction) for r in out.dives.orderBy("clip_id").collect()] == [(0, "right"), (1, "left"), (2, "right")]
    assert {r.dive_count for r in out.report.collect()} == {1} and out.kicks is None
    texts = {r.clip_id: r.text for r in out.summary().collect()}
    assert set(texts) == {0, 1, 2}
    assert all(w in texts[0] for w in ("Clip       : 0", "1280x720  (landscape)", "60.00 fps", "120 processed", "Dives      : 1", "Goalkeeper: track", "Positioning", "Median distance off line", "Set position (frame", "Dives detected: 1", "1. right", "Caveats"))
    assert {r.clip_id: r.uncertain for r in out.uncertain.collect()} == {0: False, 1: False, 2: False}
    out.release()
    # A goal of another size changes metres, and only those.
    c.goalkeeper.goal_width_m = 3.66
    small = pipeline.run(clips_of(spark, sf).where("clip_id < 1"), d, c)
    one, half = out.dives.where("clip_id = 0").first(), small.dives.first()
    assert abs(half.lateral_m - one.lateral_m / 2) < 1e-9 and half.lateral_bh == one.lateral_bh
    small.release()


def test_profile_stride_and_identification_take_effect(spark, sf):
    d = adapters.dive_tracks(spark, sf).where("clip_id < 1").drop("track_id").withColumn("bbox", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double, score: double>"))
    rows = clips_of(spark, sf).where("clip_id < 1")
    out = pipeline.run(rows, d, Config.from_dict({"video": {"profile": "fast", "start_s": 0.05}}))
    assert sorted(r.frame_index for r in out.tracked.collect()) == list(range(3, 120, 2)) and out.kicks is not None
    out.release()
    out = pipeline.run(rows, d, Config.from_dict({"goalkeeper": {"enabled": True, "identification": "colour", "goal_posts": [[120, 300], [852, 300]]}}))
    assert [r.method for r in out.keepers.collect()] == ["longest"] and out.warnings == ["nothing to identify the keeper by colour with; the longest track is taken"]
    out.release()


def test_records_lifters_and_lookups(spark):
    import json

    from strideframe.operators import calibration, clips, lifting
    from strideframe.schema import BackendNotAvailable, StrideframeError

    made = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.5, 4, True), (2, None, None, 3, False)], "clip_id long, h array<double>, reproj_err_px double, n_points long, reliable boolean")
    got = {r.clip_id: json.loads(r.value) for r in calibration.records(made).collect()}
    assert got[1] == {"homography": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "reprojection_error_px": 0.5, "is_reliable": True, "num_points": 4} and got[2]["num_points"] == 3
    goal = json.loads(calibration.goal_records(adapters.fixed_goals(adapters.pose_clips(spark))).first().value)
    assert goal["px_per_m"] == 100 and goal["left_post"] == [120, 300] and abs(goal["scale_consistency"] - 1) < 1e-9
    assert lifting.lifter() is lifting.smooth and clips.device("no such")[0] == "generic" and clips.device("action_cam")[3] == 118.0
    with pytest.raises(BackendNotAvailable):
        lifting.lifter("monocular")(made, made)
    with pytest.raises(KeyError):
        lifting.lifter("none")
    assert issubclass(ConfigError, StrideframeError) and issubclass(BackendNotAvailable, StrideframeError)


def test_command_line_settings(tmp_path, capsys):
    from strideframe import __main__ as cli

    (tmp_path / "c.yaml").write_text("tracking:\n  max_age: 7\n")
    assert cli.settings(cli.parser().parse_args(["run", "a", "b", "-o", "c", "-c", str(tmp_path / "c.yaml")])).tracking.max_age == 7
    (tmp_path / "c.json").write_text('{"tracking": {"max_age": 9}}')
    args = cli.parser().parse_args(["run", "a", "b", "-o", "c", "-c", str(tmp_path / "c.json"), "--goal-posts", "120,300", "852,300", "--end", "2"])
    config = cli.settings(args)
    assert config.tracking.max_age == 9 and config.goalkeeper.enabled and config.goalkeeper.goal_posts == [[120, 300], [852, 300]] and config.video.end_s == 2
    cli.main(["devices"])
    cli.main(["backends"])
    assert "iphone_recent" in capsys.readouterr().out


def test_the_summary_reads_each_stage_once(spark, sf):
    """Plans that hold the keepers' plan again and again fill the driver: 158 exchanges before they were stored."""
    d = adapters.dive_tracks(spark, sf).where("clip_id < 1").select("clip_id", "frame_index", (F.col("frame_index") / 60.0).alias("ts"), F.col("det_id").cast("int").alias("det_id"), "kp", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double, score: double>").alias("bbox"))
    rows = clips_of(spark, sf).where("clip_id < 1")
    out = pipeline.run(rows, d, Config.from_dict({"goalkeeper": {"enabled": True, "goal_posts": [[120, 300], [852, 300]]}, "analysis": {"filter_cutoff_hz": None}}))
    assert out.summary()._jdf.queryExecution().executedPlan().toString().count("Exchange") < 50
    out.release()


def test_frames_do_not_go_through_the_driver(spark, sf, monkeypatch):
    """Frames made from few keys look small to Spark, which broadcast all of them to meet their clips."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store.stored(df, name)

    monkeypatch.setattr(pipeline, "stored", noted)
    d = adapters.dive_tracks(spark, sf).where("clip_id < 3").drop("track_id").withColumn("bbox", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double, score: double>"))
    out = pipeline.run(clips_of(spark, sf).where("clip_id < 2"), d, Config.from_dict({}))
    assert "BuildLeft" not in plans[0] and "LeftOuter" in plans[0]
    assert {(r.clip_id, r["count"]) for r in out.tracked.groupBy("clip_id").count().collect()} == {(0, 120), (1, 120)}  # the third clip is not among the clips
    out.release()
