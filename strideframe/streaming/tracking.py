"""Tracking as a stream: state for each clip, frames in order by event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strideframe.operators.tracks import Tracker
from strideframe.schema import FRAME
from strideframe.sources.store import shared_folder

OUT = "clip_id bigint, frame_index bigint, det_id bigint, track_id bigint, confirmed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CORNERS = ("x1", "y1", "x2", "y2")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; the setting is the session's, so the caller makes it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def frame_times(rows: DataFrame, clips: DataFrame, at: str = "at") -> DataFrame:
    """rows with ``at``, the event time of their frame: the clip's ``started`` and the frame's share of ``fps``."""
    from pyspark.sql import functions as F

    known = clips.select("clip_id", F.col("started").alias("_started"), F.col("fps").alias("_fps"))
    micros = F.unix_micros("_started") + F.round(F.col(FRAME) / F.col("_fps") * 1e6).cast("bigint")
    return rows.join(known, "clip_id").withColumn(at, F.timestamp_micros(micros)).drop("_started", "_fps")


class ClipProcessor(StatefulProcessor):
    """The tracker of one clip.

    ``trails`` maps ids to a box, its velocity, hits and misses; ``waiting``
    lists the boxes of frames that the watermark has not passed; ``clip`` holds
    the last frame taken, the next free id, the time of the latest row and the
    timer that will see whether the clip has gone silent. Rows that arrive are
    appended to the list, with a timer for the earliest of them; when a timer
    fires, frames whose time is not after the watermark are complete and are
    taken in order.
    """

    def __init__(self, settings: Tracker, idle_s: float, at: str):
        self.settings, self.idle_ms, self.at = settings, int(idle_s * 1000), at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", "last bigint, next_id bigint, seen_ms bigint, silent_ms bigint")
        self.trails = handle.getMapState("trails", "id bigint", "box array<double>, velocity array<double>, hits bigint, misses bigint")
        self.waiting = handle.getListState("waiting", "frame bigint, at_ms bigint, det bigint, box array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, next_id, seen, silent = self.clip.get() if self.clip.exists() else (None, 0, 0, None)
        found = []
        for pdf in rows:
            micros = pdf[self.at].astype("datetime64[us]").astype("int64")
            # A frame is complete when no row of it can come any more, so times are rounded up.
            for frame, at, det, box in zip(pdf[FRAME].tolist(), (-(-micros // 1000)).tolist(), pdf["det_id"].tolist(), pdf["bbox"], strict=True):
                if last is None or frame > last:
                    found.append((int(frame), int(at), None if box is None else int(det), None if box is None else [float(box[c]) for c in _CORNERS]))
        if found:
            self.waiting.appendList(found)
            self.handle.registerTimer(min(at for _, at, _, _ in found))
            seen = max(seen, *(at for _, at, _, _ in found))
            if silent is None:
                silent = seen + self.idle_ms
                self.handle.registerTimer(silent)
            self.clip.update((last, next_id, seen, silent))
        yield pd.DataFrame([], columns=["clip_id", FRAME, "det_id", "track_id", "confirmed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, next_id, seen, silent = self.clip.get()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[1] <= mark], [r for r in rows if r[1] > mark]
        if ready:
            last, next_id = self._take(int(key[0]), ready, last, next_id, out)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[1] for r in rest))
            else:
                self.waiting.clear()
        if silent is not None and silent <= mark:
            silent = None
            if rest or seen + self.idle_ms > mark:
                silent = max(seen + self.idle_ms, mark + 1)
                self.handle.registerTimer(silent)
            elif self.trails.exists():
                self.trails.clear()  # the next free id stays, so that ids never repeat
        self.clip.update((last, next_id, seen, silent))
        yield pd.DataFrame(out, columns=["clip_id", FRAME, "det_id", "track_id", "confirmed"])

    def _take(self, clip: int, ready: list[tuple], last: int | None, next_id: int, out: list) -> tuple[int, int]:
        s = self.settings
        own = Tracker(s.min_iou, s.reach, s.max_age, s.min_hits, s.smoothing, s.decay)
        before = {k[0]: v for k, v in self.trails.iterator()} if self.trails.exists() else {}
        own.load(next_id, [(i, list(b), list(v), h, m) for i, (b, v, h, m) in sorted(before.items())])
        frames: dict[int, list[tuple[int, list[float]]]] = {}
        for frame, _, det, box in ready:
            boxes = frames.setdefault(frame, [])
            if box is not None:
                boxes.append((det, list(box)))
        for frame in sorted(frames):
            boxes = sorted(frames[frame])
            for _ in range(min(frame - last - 1, own.max_age + 1) if last is not None else 0):
                own.step([])
            found = own.step([b for _, b in boxes])
            out += [(clip, frame, det, track, sure) for (det, _), (track, sure) in zip(boxes, found, strict=True)]
            last = frame
        next_id, trails = own.dump()
        kept = {i for i, *_ in trails}
        for i in before.keys() - kept:
            self.trails.removeKey((i,))
        for i, box, velocity, hits, misses in trails:
            self.trails.updateValue((i,), (box, velocity, hits, misses))
        return last, next_id

    def close(self) -> None:
        pass


def stream_tracks(detections: DataFrame, settings: Tracker | None = None, at: str = "at", late: str = "1 second", idle_s: float = 600.0) -> DataFrame:
    """clip_id, frame_index, det_id, track_id, confirmed of boxes as they arrive.

    ``at`` is the event time of a row's frame (``frame_times`` makes it). Frames
    must be taken in order, but may arrive out of it: a frame waits until the
    watermark, ``late`` behind the latest time seen in any clip, has passed it.
    Rows behind the watermark are left out by Spark. As only event time counts,
    neither the size of batches nor a pause or a restart changes an id. The last
    frames of a stream that ends go when a later row comes: send one with a null
    bbox, which is never a box.

    The state of a clip is its trails, bounded by max_age, the boxes of the
    frames that wait, and four numbers. When a clip has been silent for
    ``idle_s`` of event time its boxes are forgotten; the next free id stays.
    The session must use the RocksDB store (``use_rocksdb``).
    """
    rows = detections.select("clip_id", FRAME, "det_id", "bbox", at).withWatermark(at, late)
    return rows.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=ClipProcessor(settings or Tracker(), idle_s, at), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives from what is there now, as a table in the shared folder; the session's state store is put back."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before, path = spark.conf.get(key), f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    use_rocksdb(spark)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
