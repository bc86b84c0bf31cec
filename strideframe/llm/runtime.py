"""What the operators of this subpackage share: cutting lineage and components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine (tests) a
    temporary folder is taken; a cluster without that setting is refused.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    A result may read them lazily, so they live until ``clear`` or until the
    Python process ends, whichever comes first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0
        _OPEN.append(self)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and read it again with the same schema."""
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete all tables; results that read them must be stored by now."""
        self._delete(self.base)
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Scratches of this process that nobody has cleared yet.
_OPEN: list[Scratch] = []


def clear_all() -> None:
    """Delete the tables of every scratch of this process; call it when the results are stored."""
    for scratch in list(_OPEN):
        scratch.clear()


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # a session that has been stopped deletes nothing any more
        clear_all()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph of bigint nodes: columns node, component.

    links has columns a and b; loops, repeats and nulls are allowed. The result
    has every node that has a link to another one; component is the smallest
    node of its component. Each round hooks every current root onto its
    smallest neighbour, follows the pointers to their ends and rewrites the
    links between roots. A root with a neighbour hooks or is hooked onto, so
    the roots at least halve in every round. All state stays in tables.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    edges = scratch.put(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = scratch.put(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = scratch.put(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.put(hooks.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("new"), "root"), "jumped")
            settled = jumped.where("new <> root").isEmpty()
            scratch.drop(hooks)
            hooks = jumped.select("node", F.col("new").alias("root"))
            hooks._scratch_path = jumped._scratch_path
            if settled:
                break
        over = hooks.select(F.col("node").alias("component"), F.col("root"))
        relabelled = scratch.put(labels.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        left, right = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = scratch.put(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        scratch.drop(hooks, labels, edges)
        labels, edges = relabelled, rest
    return labels


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], groups: int = 24) -> np.ndarray:
    """The sum over all partitions of the flat array that ``part`` makes of each one's batches.

    part gives arrays of one length and type (int64 or float64), whatever its
    batches; what comes to the driver is ``groups`` arrays at most. They are
    added in one order, so that equal parts give equal sums.
    """
    kinds = {"i": "<i8", "f": "<f8"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.asarray(part(batches))
        kind = made.dtype.kind
        yield pa.RecordBatch.from_pydict({"g": [TaskContext.get().partitionId() % groups], "kind": [kind], "v": [made.astype(kinds[kind]).tobytes()]}, pa.schema([("g", pa.int32()), ("kind", pa.string()), ("v", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        total = np.sum([np.frombuffer(v, kinds[kind]) for v in sorted(pdf["v"])], axis=0)
        return pd.DataFrame({"kind": [kind], "v": [total.astype(kinds[kind]).tobytes()]})

    found = rows.mapInArrow(run, "g int, kind string, v binary").groupBy("g").applyInPandas(add, "kind string, v binary").collect()
    return np.sum([np.frombuffer(v, kinds[k]) for k, v in sorted((r["kind"], bytes(r["v"])) for r in found)], axis=0)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The lists of ``size`` values of an Arrow column as rows; the column has no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names the operator makes itself (in any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of TEXT_ROWS rows at most.

    Spark's own limit is made for narrow rows; with texts it costs each
    worker, and the buffers of its executor, some hundred MB. The setting stays for
    the session, as plans are made when results are asked for.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """No collection of cycles meanwhile: memories that hold none make it slow. Workers are reused, so it comes back."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
