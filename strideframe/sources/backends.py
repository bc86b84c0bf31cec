"""Pose backends at the boundary: frames in, detections out, one model for each partition.

Decoding and inference need libraries that are not part of the engine; what is
registered here says so when it is asked to run. An own backend is a class
with ``estimate`` under a name of its own.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strideframe.schema import DETECTIONS, BackendNotAvailable


class Backend(ABC):
    """Lifecycle on an executor: setup, estimate for every frame, close."""

    def __init__(self, **options: Any):
        self.options = options

    @classmethod
    def available(cls) -> bool:
        return True

    def setup(self) -> None: ...

    def close(self) -> None: ...

    @abstractmethod
    def estimate(self, image: bytes) -> list[dict[str, Any]]:
        """People of one frame: dicts with kp and bbox."""


BACKENDS: dict[str, type[Backend]] = {}
#: The order in which an available one is taken.
PREFERENCE = ("mediapipe", "rtmpose", "sapiens", "posepipeline")


def register(name: str) -> Callable[[type[Backend]], type[Backend]]:
    def add(cls: type[Backend]) -> type[Backend]:
        if name in BACKENDS:
            raise ValueError(f"there is a backend {name!r} already")
        BACKENDS[name] = cls
        return cls

    return add


def get(name: str, **options: Any) -> Backend:
    if name not in BACKENDS:
        raise KeyError(f"no backend {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](**options)


def default() -> str | None:
    """The first available backend in order of preference, then by name."""
    order = [*PREFERENCE, *sorted(set(BACKENDS) - set(PREFERENCE))]
    return next((n for n in order if n in BACKENDS and BACKENDS[n].available()), None)


def listing() -> list[tuple[str, bool]]:
    return sorted(((n, c.available()) for n, c in BACKENDS.items()), key=lambda x: (not x[1], x[0]))


def _absent(name: str) -> None:
    @register(name)
    class Absent(Backend):
        @classmethod
        def available(cls) -> bool:
            return False

        def estimate(self, image: bytes) -> list[dict[str, Any]]:
            raise BackendNotAvailable(f"{name} is not part of the engine; register a class of your own for it")


for _name in PREFERENCE:
    _absent(_name)


def detect(frames: DataFrame, name: str, **options: Any) -> DataFrame:
    """Detections of frames (clip_id, frame_index, ts, image) by a registered backend."""
    if not BACKENDS[name].available():
        raise BackendNotAvailable(name)
    kind = BACKENDS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = kind(**options)
        own.setup()
        try:
            for pdf in batches:
                rows = [(r.clip_id, r.frame_index, r.ts, n, p["kp"], p.get("bbox")) for r in pdf.itertuples() for n, p in enumerate(own.estimate(r.image))]
                yield pd.DataFrame(rows, columns=["clip_id", "frame_index", "ts", "det_id", "kp", "bbox"])
        finally:
            own.close()

    return frames.select("clip_id", "frame_index", "ts", "image").mapInPandas(run, DETECTIONS)


def table_function(name: str, **options: Any) -> Any:
    """A registered backend as a table function over frames: ``spark.udtf.register("pose", table_function("own"))``, then

        SELECT * FROM pose(TABLE(frames))

    Frames come as Arrow batches. The backend is made and set up with the first
    batch of a partition and closed at its end, or when a batch fails.
    """
    if not BACKENDS[name].available():
        raise BackendNotAvailable(name)
    kind = BACKENDS[name]

    class Pose:
        def __init__(self) -> None:
            self.own: Backend | None = None

        def eval(self, frames: pa.RecordBatch) -> Iterator[pa.Table]:
            if self.own is None:
                self.own = kind(**options)
                self.own.setup()
            try:
                columns = [frames.column(c).to_pylist() for c in ("clip_id", "frame_index", "ts", "image")]
                found = [(clip, frame, ts, n, p["kp"], p.get("bbox")) for clip, frame, ts, image in zip(*columns, strict=True) for n, p in enumerate(self.own.estimate(image))]
            except BaseException:
                self.terminate()
                raise
            yield pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in found], schema=schema)

        def terminate(self) -> Iterator[pa.Table]:
            if self.own is not None:
                self.own.close()
                self.own = None
            return iter(())

    schema, names = to_arrow_schema(StructType.fromDDL(DETECTIONS)), [f.name for f in StructType.fromDDL(DETECTIONS)]
    return arrow_udtf(Pose, returnType=DETECTIONS)
