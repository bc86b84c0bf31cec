"""Duplicate suppression, greedy tracking and per-track summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from strideframe.functions import geometry as g
from strideframe.operators import long_series, series
from strideframe.schema import FRAME, TRACK
from strideframe.sources.store import stored


def suppress_duplicates(detections: DataFrame, keys: list[str], max_iou: float = 0.6, max_containment: float = 0.8, conf: str = "mean_conf", ordinal: str = "det_id", box: str = "bbox") -> DataFrame:
    """Detections of each frame without those that a surer kept one covers.

    By falling confidence (ties: ordinal) a detection goes if it overlaps a kept
    one by more than max_iou or is held by, or holds, one by more than
    max_containment. Those without a box stay. The fold runs inside the JVM over
    the few detections of one frame; ``rank`` is their new order.
    """
    columns = [c for c in detections.columns if c not in keys]
    listed = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(conf)).alias("_a"), F.col(ordinal).alias("_b"), *columns))).alias("all"))

    def covered(kept: Column, e: Column) -> Column:
        return F.exists(kept, lambda k: k[box].isNotNull() & ((g.iou(k[box], e[box]) > max_iou) | (g.containment(k[box], e[box]) > max_containment)))

    empty = F.slice(F.col("all"), 1, 0)
    kept = F.aggregate("all", empty, lambda acc, e: F.when(e[box].isNotNull() & covered(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    return listed.select(*keys, F.posexplode(kept).alias("rank", "e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in columns], F.col("rank").cast("bigint").alias("rank"))


Box = tuple[float, float, float, float]
#: Pairs of a frame up to which plain numbers are faster than arrays.
FEW_PAIRS = 100


@dataclass
class Trail:
    """State of one track: its box, velocity, hits and misses."""

    box: Box
    velocity: Box = (0.0, 0.0, 0.0, 0.0)
    hits: int = 1
    misses: int = 0


@dataclass
class Tracker:
    """Greedy two-pass linking of boxes, first by overlap and then by centres.

    Frames come in order through ``step``; the state is small and serialisable,
    so the same object drives the batch operator and the streaming one.
    """

    min_iou: float = 0.3
    reach: float = g.LENGTHS
    max_age: int = 30
    min_hits: int = 3
    smoothing: float = 0.5
    decay: float = 0.8
    trails: dict[int, Trail] = field(default_factory=dict)
    next_id: int = 0

    def step(self, boxes: Sequence[Sequence[float]]) -> list[tuple[int, bool]]:
        """(track id, confirmed) of each box of the next frame."""
        ids, new = list(self.trails), [tuple(map(float, b)) for b in boxes]
        ahead = [tuple(b + v for b, v in zip(t.box, t.velocity, strict=True)) for t in self.trails.values()]
        pairs: dict[int, int] = {}
        if ids and new:
            for found in self._scored(ahead, new):
                taken = set(pairs.values())
                for _, t, d in sorted(found):
                    if t not in pairs and d not in taken:
                        pairs[t] = d
                        taken.add(d)
                if len(pairs) == min(len(ids), len(new)):
                    break
        out: list[tuple[int, bool]] = [(-1, False)] * len(new)
        s, decay = self.smoothing, self.decay
        for t, i in enumerate(ids):
            trail = self.trails[i]
            if t in pairs:
                d = pairs[t]
                trail.velocity = tuple(s * (n - b) + (1 - s) * v for n, b, v in zip(new[d], trail.box, trail.velocity, strict=True))
                trail.box, trail.hits, trail.misses = new[d], trail.hits + 1, 0
                out[d] = (i, trail.hits >= self.min_hits)
            else:
                trail.box, trail.velocity, trail.misses = ahead[t], tuple(v * decay for v in trail.velocity), trail.misses + 1
                if trail.misses > self.max_age:
                    del self.trails[i]
        for d, box in enumerate(new):
            if out[d][0] < 0:
                self.trails[self.next_id] = Trail(box)
                out[d] = (self.next_id, self.min_hits <= 1)
                self.next_id += 1
        return out

    def _scored(self, ahead: list[Box], new: list[Box]) -> Iterator[list[tuple[float, int, int]]]:
        """For each pass the pairs that may link, as (-score, track, box): the best come first, ties go to earlier tracks, then to earlier boxes."""
        if len(ahead) * len(new) <= FEW_PAIRS:
            every = [(t, d, a, b) for t, a in enumerate(ahead) for d, b in enumerate(new)]
            yield [(-v, t, d) for t, d, a, b in every if (v := _overlap(a, b)) >= self.min_iou]
            yield [(-v, t, d) for t, d, a, b in every if (v := _near(a, b, self.reach)) > 0]
            return
        a, b = np.array(ahead), np.array(new)
        for score, allowed in ((_overlaps(a, b), lambda v: v >= self.min_iou), (_nearness(a, b, self.reach), lambda v: v > 0)):
            t, d = np.nonzero(allowed(score))
            yield list(zip((-score[t, d]).tolist(), t.tolist(), d.tolist(), strict=True))

    def dump(self) -> tuple[int, list[tuple[int, list[float], list[float], int, int]]]:
        return self.next_id, [(i, list(t.box), list(t.velocity), t.hits, t.misses) for i, t in self.trails.items()]

    def load(self, next_id: int, trails: list[tuple[int, list[float], list[float], int, int]]) -> Tracker:
        self.next_id = next_id
        self.trails = {i: Trail(tuple(b), tuple(v), h, m) for i, b, v, h, m in trails}
        return self


def _overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = w * h if w > 0 and h > 0 else 0.0
    size = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = size(a) + size(b) - inter
    return inter / union if union > 0 else 0.0


def _near(a: Box, b: Box, reach: float) -> float:
    long = lambda x: math.sqrt(max(0.0, x[2] - x[0]) ** 2 + max(0.0, x[3] - x[1]) ** 2)
    scale = (long(a) + long(b)) / 2
    dx, dy = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    return max(0.0, 1 - math.sqrt(dx * dx + dy * dy) / scale / reach) if scale > 0 else 0.0


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.maximum(0, high - low), axis=2)
    size = lambda x: np.prod(np.maximum(0, x[:, 2:] - x[:, :2]), axis=1)
    union = size(a)[:, None] + size(b)[None] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _nearness(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    middle = lambda x: (x[:, :2] + x[:, 2:]) / 2
    diagonal = lambda x: np.linalg.norm(np.maximum(0, x[:, 2:] - x[:, :2]), axis=1)
    scale = (diagonal(a)[:, None] + diagonal(b)[None]) / 2
    gap = np.linalg.norm(middle(a)[:, None] - middle(b)[None], axis=2)
    ratio = np.divide(gap, scale, out=np.full_like(gap, np.inf), where=scale > 0)
    return np.maximum(0, 1 - ratio / reach)


def track_boxes(detections: DataFrame, tracker: Tracker | None = None, min_conf: float = 0.0) -> DataFrame:
    """detections (clip_id, frame_index, det_id, bbox, mean_conf) with track_id and confirmed.

    One clip is one group, as its frames depend on each other; clips are
    independent. Frames without detections inside a clip count as misses.
    ``track_long_clips`` gives the same for clips that are too long for one task.
    """
    return _tracked(detections, ["clip_id"], tracker or Tracker(), min_conf)


def track_long_clips(detections: DataFrame, tracker: Tracker | None = None, min_conf: float = 0.0, slice_rows: int = long_series.SLICE_ROWS) -> DataFrame:
    """What ``track_boxes`` gives, a segment of a clip at a time.

    When no box has come for max_age + 1 frames every trail has been given up:
    the tracker's state is empty but for its next id. So a clip is cut there,
    segments are tracked apart, and the ids of a segment go on from how many
    all earlier ones of its clip have used. Finding the cuts takes slices of
    ``slice_rows`` rows. The tracked rows are written once to the shared folder,
    as both the numbers of ids and the result read them.
    """
    settings = tracker or Tracker()
    usable = F.col("bbox").isNotNull() & (F.col("mean_conf") >= min_conf)
    seen = F.when(usable, F.col(FRAME))
    met = long_series.with_known(detections, ["clip_id"], FRAME, seen, F.col(FRAME), slice_rows, here=False)
    begins = F.when(usable & (F.col(FRAME) - F.col("back.v") > settings.max_age + 1), 1).otherwise(0)
    cut = long_series.counted(met.withColumn("_begins", begins).drop("back", "ahead"), ["clip_id"], FRAME, F.col("_begins"), "_segment", slice_rows, ties=True).drop("_begins")
    done = stored(_tracked(cut, ["clip_id", "_segment"], settings, min_conf), "tracked")
    used = done.groupBy("clip_id", "_segment").agg((F.max("track_id") + 1).alias("ids"))
    before = Window.partitionBy("clip_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offset = used.select("clip_id", "_segment", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_offset"))
    out = done.join(offset, ["clip_id", "_segment"])
    return out.withColumn("track_id", F.col("track_id") + F.col("_offset")).select(*detections.columns, "track_id", "confirmed")


def _tracked(detections: DataFrame, keys: list[str], settings: Tracker, min_conf: float) -> DataFrame:
    """Rows with track_id and confirmed, whole keys at a time; a frame without boxes is a miss."""
    schema = StructType([*detections.schema.fields, StructField("track_id", LongType()), StructField("confirmed", BooleanType())])
    corner = [F.col(f"bbox.{c}").cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    usable = (F.col("bbox").isNotNull() & (F.col("mean_conf") >= min_conf)).alias("_usable")
    rows = detections.select(*detections.columns, *corner, F.coalesce(usable, F.lit(False)).alias("_usable"))
    made = rows.columns[len(detections.columns) :]

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        ids, sure = np.full(table.num_rows, -1), np.zeros(table.num_rows, bool)
        pdf = table.select([FRAME, "det_id", *made]).to_pandas()
        boxes, ok = pdf[made[:4]].to_numpy(dtype=float).tolist(), pdf["_usable"].tolist()
        frames, turn = pdf[FRAME].tolist(), pdf["det_id"].tolist()
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            own, last, i = Tracker(settings.min_iou, settings.reach, settings.max_age, settings.min_hits, settings.smoothing, settings.decay), None, a
            while i < b:
                frame, at = frames[i], []
                while i < b and frames[i] == frame:
                    if ok[i]:
                        at.append(i)
                    i += 1
                at.sort(key=turn.__getitem__)
                for _ in range(min(frame - last - 1, own.max_age + 1) if last is not None else 0):
                    own.step([])
                for k, (track, confirmed) in zip(at, own.step([boxes[k] for k in at]), strict=True):
                    ids[k], sure[k] = track, confirmed
                last = frame
        return table.drop_columns(made).append_column("track_id", pa.array(ids, mask=ids < 0)).append_column("confirmed", pa.array(sure))

    return series.by_key_in_arrow(rows, keys, FRAME, run, schema)


def tall_boxes(detections: DataFrame, frame_height: Column | float, least: float = 0.05) -> DataFrame:
    """Detections whose box is at least that share of the frame tall, with ``rank`` from 1 within the frame: the largest first, then by det_id."""
    b = F.col("bbox")
    frame = Window.partitionBy(*[c for c in ("clip_id", FRAME) if c in detections.columns])
    tall = detections.where((b["y2"] - b["y1"]) >= least * (frame_height if isinstance(frame_height, Column) else F.lit(frame_height)))
    return tall.withColumn("rank", F.row_number().over(frame.orderBy(F.desc(g.area(b)), "det_id")).cast("bigint"))


def spans(rows: DataFrame) -> DataFrame:
    """Rows, first and last frame and coverage of each track."""
    n = F.count("*")
    return rows.groupBy(*TRACK).agg(n.alias("n"), F.min(FRAME).alias("first_frame"), F.max(FRAME).alias("last_frame"), (n / (F.max(FRAME) - F.min(FRAME) + 1)).alias("coverage"))


def longest_track(rows: DataFrame) -> DataFrame:
    """The track of each clip with the most rows; ties go to the one seen first, then to the smaller id."""
    best = F.max_by(F.struct("track_id", "n"), F.struct("n", -F.col("first_frame"), -F.col("track_id")))
    return spans(rows).groupBy("clip_id").agg(best.alias("b")).select("clip_id", "b.track_id", "b.n")


def reference_heights(features: DataFrame) -> DataFrame:
    return features.groupBy(*TRACK).agg(F.median("height_px").alias("reference_px"), F.count("height_px").alias("n_heights"))
