"""Colours of kits from the pixels of sampled frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.schema import FRAME

OUT = "clip_id bigint, track_id bigint, frame_index bigint, r double, g double, b double"


def patch_median(pixels: np.ndarray) -> tuple[float, float, float]:
    """Median of each channel of a patch (rows, columns, 3) of bytes, from its histogram."""
    n = pixels.shape[0] * pixels.shape[1]
    out = []
    for c in range(3):
        reached = np.cumsum(np.bincount(pixels[:, :, c].ravel(), minlength=256))
        low, high = np.searchsorted(reached, [(n - 1) // 2, n // 2], side="right")
        out.append((int(low) + int(high)) / 2)
    return out[0], out[1], out[2]


def samples(poses: DataFrame, images: DataFrame, inset: float = 0.2) -> DataFrame:
    """clip_id, track_id, frame_index, r, g, b: the median colour of each pose's torso in its frame.

    images has clip_id, frame_index, width, height and pixels (bytes of rows of
    RGB). Poses without all four corners of the torso, or with a patch of no
    size, give no row, nor do frames whose bytes do not fit their size. The
    patch is cut out of its frame where pose and frame meet, so that only its
    bytes go to Python.
    """
    patch = g.torso_patch(F.col("kp"), F.col("width"), F.col("height"), inset)
    met = poses.select("clip_id", "track_id", FRAME, "kp").join(images.select("clip_id", FRAME, "width", "height", "pixels"), ["clip_id", FRAME])
    fits = met.withColumn("patch", patch).where("patch is not null and octet_length(pixels) = 3 * width * height").select("clip_id", "track_id", FRAME, "width", "patch.*", "pixels")
    line = "substring(pixels, cast(3 * (y * width + x1) + 1 as int), cast(3 * (x2 - x1) as int))"
    some = fits.select("clip_id", "track_id", FRAME, (F.col("x2") - F.col("x1")).alias("wide"), F.expr(f"transform(sequence(y1, y2 - 1), y -> {line})").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for wide, lines in zip(batch.column("wide").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                found.append(patch_median(np.frombuffer(b"".join(lines), np.uint8).reshape(-1, wide, 3)))
            colours = np.array(found, dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("clip_id", "track_id", FRAME)), *(pa.array(colours[:, k]) for k in range(3))], names=["clip_id", "track_id", FRAME, "r", "g", "b"])

    return some.mapInArrow(run, OUT)
