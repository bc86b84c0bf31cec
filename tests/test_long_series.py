"""Keys that go through many slices give the rows of one pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import signal
from strideframe.operators import long_series, series, tracks
from strideframe.sources import store

KEY = ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, one short one, one of a single row and one without a key; gaps in the order and in the values."""
    main = spark.range(6000).where("id % 7 <> 3").select(F.lit("a").alias("k"), F.col("id").alias("i"))
    more = spark.range(40).select(F.lit("b").alias("k"), (F.col("id") * 5).alias("i"))
    odd = spark.createDataFrame([("c", 9), (None, 4), (None, 8)], "k string, i long")
    value = F.when((F.xxhash64("i", "k") % 5 != 0) & ~F.col("i").between(2000, 3400), F.round(F.sin(F.col("i") / 9) * 10 + F.pmod(F.xxhash64("i"), F.lit(7)), 3))
    out = main.union(more).union(odd).withColumn("v", value).withColumn("t", F.col("i") / 50 + F.pmod(F.hash("i"), F.lit(3)) / 1000)
    return store.stored(out.repartition(6))


def same(a, b, digits=9):
    of = lambda d: sorted(((r["k"] or "", r["i"], *(None if x is None else round(x, digits) if isinstance(x, float) else x for x in [r["out"]])) for r in d.select("k", "i", "out").collect()))
    left, right = of(a), of(b)
    assert left == right and len(left) > 5000


@pytest.mark.parametrize("size", [97, 1500])
def test_slices_give_the_rows_of_one_pass(spark, rows, size):
    w, filled = series.over(KEY, "i"), rows.na.fill(0.0, ["v"])
    same(long_series.gradient(rows, KEY, "i", "v", "t", "out", size), rows.withColumn("out", series.gradient(F.col("v"), F.col("t"), w)))
    same(long_series.uniform_gradient(rows, KEY, "i", "v", 0.02, "out", size), rows.withColumn("out", series.uniform_gradient(F.col("v"), 0.02, w)))
    same(long_series.step_length(filled, KEY, "i", "v", "t", "out", size), filled.withColumn("out", series.step_length(F.col("v"), F.col("t"), w)))
    same(long_series.local_peaks(rows, KEY, "i", "v", 5.0, "out", size), rows.withColumn("out", series.local_peak(F.col("v"), 5.0, w)))
    same(long_series.numbered(rows, KEY, "i", "out", size), rows.withColumn("out", series.number(KEY, "i")))
    same(long_series.interpolated(rows, KEY, "i", "v", "i", "out", size), rows.withColumn("out", series.interpolated(F.col("v"), F.col("i"), KEY, "i")))
    flag = F.coalesce(F.col("v") > 0, F.lit(False)) | F.col("i").between(3000, 3700)  # a run through many slices
    same(long_series.islands(rows, KEY, "i", flag, size).withColumn("out", F.col("island")), series.islands(rows, KEY, "i", flag).withColumn("out", F.col("island")))


def test_a_long_key_is_shared_by_many_tasks(spark):
    """No task reads a tenth of the rows of the one key beyond its even share."""
    n = 400_000
    one = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("i"), (F.col("id") % 100).cast("double").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = long_series.with_neighbours(one, KEY, "i", ["v"], 5000)
        by = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        wrong = met.where("(i > 0 and before.v is distinct from pmod(i - 1, 100)) or (i < 399999 and after.v is distinct from pmod(i + 1, 100))").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(by) == n and max(by) < 0.1 * n and wrong == 0


def test_low_pass_in_pieces_is_that_of_the_whole_series(spark):
    n, rng = 200_000, np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=n)) / 10 + 100 * np.sin(np.arange(n) / 500)
    gone = rng.random(n) < 0.05
    gone[90_000:103_000] = True  # longer than a piece
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(n), "x": np.where(gone, np.nan, x)})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    out = long_series.filtered(table, KEY, "i", ["x"], F.lit(60.0), 6.0, piece_rows=9000, slice_rows=20_000).toPandas().sort_values("i")
    whole = signal.low_pass(np.where(gone, np.nan, x)[:, None], 60.0, 6.0)[:, 0]
    assert np.array_equal(out["x"].isna(), gone) and len(out) == n
    assert np.nanmax(np.abs(out["x"].to_numpy() - whole)) < 1e-9


def test_low_pass_in_pieces_leaves_what_it_must(spark):
    d = spark.createDataFrame([(1, i, float(i % 3)) for i in range(12)] + [(2, i, float(i % 3)) for i in range(60)] + [(3, i, None) for i in range(40)] + [(4, i, 2.0 if i == 30 else None) for i in range(40)], "k long, i long, x double")
    fps = F.when(F.col("k") == 2, 10.0).otherwise(60.0)
    out = {(r.k, r.i): r.x for r in long_series.filtered(d, KEY, "i", ["x"], fps, 6.0, piece_rows=20).collect()}
    assert all(out[1, i] == i % 3 for i in range(12)) and all(out[2, i] == i % 3 for i in range(60))  # too short; cutoff too high
    assert {out[3, i] for i in range(40)} == {None} and abs(out[4, 30] - 2.0) < 1e-9 and out[4, 29] is None
    assert long_series.filtered(d, KEY, "i", ["x"], fps, None) is d


@pytest.mark.parametrize("size", [50, 1_000_000])
def test_segments_of_a_clip_get_the_ids_of_one_pass(spark, size):
    rng, found = np.random.default_rng(7), []
    for clip, frames in ((1, 1500), (2, 30)):
        for f in range(frames):
            if clip == 1 and (200 <= f < 231 or 400 <= f < 430 or 900 <= f < 1100):  # 31 frames are a cut, 30 are not
                if f % 10 == 0:
                    found.append((clip, f, 0, None, 0.9))  # no box
                continue
            for d in range(3):
                if rng.random() < 0.9:
                    x = 300.0 * d + f % 40 + float(rng.integers(0, 5))
                    found.append((clip, f, d, (x, 0.0, x + 50, 150.0, 1.0), 0.2 if rng.random() < 0.05 else 0.9))
    table = spark.createDataFrame(found, "clip_id long, frame_index long, det_id long, bbox struct<x1: double, y1: double, x2: double, y2: double, score: double>, mean_conf double").repartition(5)
    of = lambda d: sorted((r.clip_id, r.frame_index, r.det_id, r.track_id is None, r.track_id or 0, r.confirmed) for r in d.collect())
    cut = tracks.track_long_clips(table, min_conf=0.5, slice_rows=size)
    assert of(cut) == of(tracks.track_boxes(table, min_conf=0.5)) and cut.columns == [*table.columns, "track_id", "confirmed"]
    one = tracks.track_long_clips(table.where("clip_id = 2").withColumn("bbox", F.lit(None).cast(table.schema["bbox"].dataType)), slice_rows=size)
    assert one.where("track_id is null").count() == one.count() > 0
