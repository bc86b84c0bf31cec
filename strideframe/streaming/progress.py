"""Progress of a run: frames and people so far, while a stream or a batch job works.

Counts travel with the rows, as observed metrics, so nothing is read twice. A
callback gets the share that is done (None if it is not known how much there
is) and a line of text, each time another ``every`` frames have come.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Callback = Callable[[float | None, str], None]
METRIC = "strideframe_progress"


def _counts(first_of_frame: Column | None) -> list[Column]:
    first = F.col("det_id") == 0 if first_of_frame is None else first_of_frame
    return [F.count(F.when(first, 1)).alias("frames"), F.count("*").alias("people"), F.count_if(F.col("bbox").isNull()).alias("without_box")]


def watched(detections: DataFrame, first_of_frame: Column | None = None, name: str = METRIC) -> DataFrame:
    """Detections of a stream with their counts as metrics that ``StreamProgress`` reads.

    first_of_frame tells one row of each frame (det_id 0 if it is not given).
    """
    return detections.observe(name, *_counts(first_of_frame))


def observed(detections: DataFrame, first_of_frame: Column | None = None) -> tuple[DataFrame, Observation]:
    """Detections of a batch and the counts of what an action on them has read (``get`` waits for one)."""
    seen = Observation(f"{METRIC}_{uuid.uuid4().hex}")
    return detections.observe(seen, *_counts(first_of_frame)), seen


class StreamProgress(StreamingQueryListener):
    """Adds up the metrics of ``watched`` over the batches of the streams of a session.

    Give it to ``spark.streams.addListener``; ``expected`` is how many frames
    there will be, if that is known.
    """

    def __init__(self, callback: Callback, expected: int | None = None, every: int = 10, name: str = METRIC):
        self.callback, self.expected, self.every, self.name = callback, expected, every, name
        self.frames = self.people = self.told = 0
        self.ended = threading.Event()

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        self.frames, self.people = self.frames + row["frames"], self.people + row["people"]
        if self.frames - self.told >= self.every:
            self.told = self.frames
            share = min(1.0, self.frames / self.expected) if self.expected else None
            self.callback(share, f"frame {self.frames}{f'/{self.expected}' if self.expected else ''}, {self.people} people")

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.ended.set()


def reported(spark: SparkSession, action: Callable[[], Any], callback: Callback, label: str = "run", interval_s: float = 0.5) -> Any:
    """What ``action`` returns; while its jobs run the callback gets the share of their tasks that are done."""
    group, tracker, over = f"{METRIC}_{uuid.uuid4().hex}", spark.sparkContext.statusTracker(), threading.Event()
    tags = spark.sparkContext

    def look() -> None:
        last = -1
        while not over.wait(interval_s):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
            total, done = (sum(getattr(s, n) for s in stages if s) for n in ("numTasks", "numCompletedTasks"))
            if total and done != last:
                last = done
                callback(done / total, f"{label}: task {done}/{total}")

    watcher = threading.Thread(target=look, daemon=True)
    tags.setJobGroup(group, label)
    watcher.start()
    try:
        return action()
    finally:
        over.set()
        watcher.join()
        tags.setLocalProperty("spark.jobGroup.id", None)
        callback(1.0, f"{label}: done")
