"""Kicks, foot contacts and cadence from the speed of the ankles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions import skeleton as sk
from strideframe.operators import series
from strideframe.schema import FRAME, TRACK

FEET = (("left", sk.L_ANKLE, 0), ("right", sk.R_ANKLE, 1))
KEY = [*TRACK, "foot", "foot_order"]


def foot_series(features: DataFrame, clips: DataFrame, cutoff_hz: float | None) -> DataFrame:
    """Both ankles as one long table, low-passed; feet with under eight usable rows are left out."""
    feet = []
    for name, i, order in FEET:
        p = g.joint(F.col("kp"), i, g.USABLE)
        feet.append(F.struct(F.lit(name).alias("foot"), F.lit(order).alias("foot_order"), p.x.alias("x"), p.y.alias("y"), F.get("kp", F.lit(i))["conf"].alias("conf")))
    rows = features.where("height_px > 0").select(*TRACK, FRAME, "height_px", F.explode(F.array(*feet)).alias("f")).select(*TRACK, FRAME, "height_px", "f.*").where("x is not null")
    whole = Window.partitionBy(*KEY)
    rows = rows.join(clips.select("clip_id", "fps"), "clip_id").withColumns({"n": F.count("*").over(whole), "reference_px": F.expr("percentile(height_px, 0.5)").over(whole)}).where("n >= 8")
    return series.filtered(rows, KEY, FRAME, ["x", "y"], F.col("fps"), cutoff_hz).withColumn("time_s", F.col(FRAME) / F.col("fps"))


def detect_kicks(features: DataFrame, clips: DataFrame, speed: float = 3.0, separation_s: float = 0.4, cutoff_hz: float | None = 12.0) -> DataFrame:
    """Peaks of ankle speed, at most one within the separation over both feet."""
    feet, w = foot_series(features, clips, cutoff_hz), series.over(KEY, FRAME)
    v = {a: series.gradient(F.col(a), F.col("time_s"), w) / F.col("reference_px") for a in "xy"}
    moving = feet.withColumns({"vx": v["x"], "vy": v["y"]}).withColumn("speed", F.hypot("vx", "vy")).withColumn("acc", series.gradient(F.col("speed"), F.col("time_s"), w))
    moving = moving.withColumn("i", series.number(KEY, FRAME))
    peaks = moving.withColumn("peak", series.local_peak(F.col("speed"), speed, w)).where("peak").select(*KEY, FRAME, "time_s", "speed", "i", F.greatest(F.lit(2), (F.col("fps") * 0.05).cast("int")).alias("reach"))
    # How many rows behind a peak count depends on the frame rate; only peaks ask for them, by position.
    asked = peaks.select(*KEY, F.col("i").alias("peak_i"), F.explode(F.expr("sequence(i, i + reach - 1)")).alias("i"))
    tails = asked.join(moving.select(*KEY, "i", "acc", "conf"), [*KEY, "i"]).groupBy(*KEY, F.col("peak_i").alias("i")).agg(F.min("acc").alias("deceleration_bh_s2"), F.avg("conf").alias("confidence"))
    kicks = peaks.withColumnRenamed("speed", "peak_speed_bh_s").join(tails, [*KEY, "i"])
    return series.refractory(kicks, TRACK, "time_s", "peak_speed_bh_s", separation_s, "foot_order", "foot", FRAME, "deceleration_bh_s2", "confidence")


def foot_contacts(features: DataFrame, clips: DataFrame, cutoff_hz: float | None = 8.0) -> DataFrame:
    """Lowest points of an ankle while it moves slower up and down than in 60 % of its rows."""
    feet, w = foot_series(features, clips, cutoff_hz), series.over(KEY, FRAME)
    rows = feet.withColumn("vertical", F.abs(series.gradient(F.col("y"), F.col("time_s"), w)) / F.col("reference_px"))
    rows = rows.withColumn("slow", F.col("vertical") < F.expr("percentile(vertical, 0.4)").over(Window.partitionBy(*KEY)))
    lowest = (F.col("y") >= F.lag("y").over(w)) & (F.col("y") > F.lead("y").over(w))
    return rows.withColumn("contact", F.coalesce(lowest & F.col("slow"), F.lit(False))).where("contact").select(*TRACK, FRAME, "time_s", "foot", "foot_order", F.col("conf").alias("confidence"))


def cadence(contacts: DataFrame) -> DataFrame:
    """Steps per minute of each track; NULL with under two contacts or outside 40 to 260."""
    n, span = F.count("*"), F.max("time_s") - F.min("time_s")
    rate = 60.0 * (n - 1) / F.nullif(span, F.lit(0.0))
    return contacts.groupBy(*TRACK).agg(n.alias("contacts"), F.when(rate.between(40, 260), rate).alias("cadence_spm"))
