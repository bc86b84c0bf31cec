"""Clip documents and marker text as data sources: parts are written by tasks, named once by the commit.

    spark.dataSource.register(ClipJson)
    sinks.nested(detections, clips).write.format("clip_json").mode("append").save(folder)
    spark.read.format("clip_json").load(folder)

Each task writes files of its own under a name nobody reads (a dot before it);
the commit of the job renames them, an abort deletes them. The folder is a path
or URI that driver and executors share, reached through Arrow's file systems.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from strideframe.functions.skeleton import COCO17


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are and what they shall be called."""

    files: list[tuple[str, str]]


class PartsWriter(DataSourceWriter):
    """Writes with ``pieces`` (name and text of each file); names appear when the job commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def pieces(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[str]]]:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, base = opened(self.path)
        hidden, files = posixpath.join(base, f".{self.job}"), []
        system.create_dir(hidden, recursive=True)
        for name, texts in self.pieces(rows):
            to = posixpath.join(hidden, uuid.uuid4().hex)
            with system.open_output_stream(to) as out:
                for text in texts:
                    out.write(text.encode())
            files.append((to, posixpath.join(base, name)))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two parts of the table are of one name")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base)):
                if old.is_file:
                    system.delete_file(old.path)
        for at, to in files:
            system.move(at, to)
        system.delete_dir(posixpath.join(base, f".{self.job}"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = opened(self.path)
        hidden = posixpath.join(base, f".{self.job}")
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class ClipJsonWriter(PartsWriter):
    def pieces(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[str]]]:
        for r in rows:
            yield f"clip-{r['clip_id']}-{r['part']}.json", iter([r["value"]])


@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FilesReader(DataSourceReader):
    """One partition for each named file."""

    suffix = ""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.path)
        found = system.get_file_info(fs.FileSelector(base))
        return [OneFile(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.endswith(self.suffix) and not posixpath.basename(i.path).startswith(".")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "path", None):
            return
        with opened(self.path)[0].open_input_stream(partition.path) as f:
            yield from self.rows(posixpath.basename(partition.path), f.read().decode())

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError


class ClipJsonReader(FilesReader):
    suffix = ".json"

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        clip = int(name.split("-")[1])
        for frame in json.loads(text)["frames"]:
            for p in frame["people"]:
                kp = [(k.get("x"), k.get("y"), k.get("conf")) for k in p.get("kp") or []]
                yield clip, frame["frame_index"], p.get("det_id"), p.get("track_id"), kp


class ClipJson(DataSource):
    """Documents as ``sinks.nested`` makes them (clip_id, part, value): a file each; read as detections."""

    @classmethod
    def name(cls) -> str:
        return "clip_json"

    def schema(self) -> str:
        return "clip_id bigint, frame_index bigint, det_id bigint, track_id bigint, kp array<struct<x: double, y: double, conf: double>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ClipJsonReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ClipJsonWriter(self.options["path"], overwrite)


class MarkerWriter(PartsWriter):
    """A marker file for each track; its rows come together and in order (``sinks.marker_rows`` sees to that)."""

    def __init__(self, path: str, overwrite: bool, fps: float, units: str):
        super().__init__(path, overwrite)
        self.fps, self.units = fps, units

    def pieces(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[str]]]:
        for (clip, track), some in groupby(rows, key=lambda r: (r["clip_id"], r["track_id"])):
            yield f"clip-{clip}-track-{track}.trc", self.lines(f"clip-{clip}-track-{track}.trc", some)

    def lines(self, name: str, rows: Iterator[Row]) -> Iterator[str]:
        for i, r in enumerate(rows):
            if i == 0:
                yield marker_head(name, self.fps, r["n"], self.units)
            yield f"{r['line']}\n"


def marker_head(name: str, fps: float, n: int, units: str) -> str:
    """The five lines before a track's places."""
    joints = "\t".join(f"{j}\t\t" for j in COCO17)
    axes = "\t".join(f"X{i}\tY{i}\tZ{i}" for i in range(1, len(COCO17) + 1))
    return "\n".join([f"PathFileType\t4\t(X/Y/Z)\t{name}", "DataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames", f"{fps:g}\t{fps:g}\t{n}\t{len(COCO17)}\t{units}\t{fps:g}\t1\t{n}", f"Frame#\tTime\t{joints}", f"\t\t{axes}", ""])


class MarkerReader(FilesReader):
    suffix = ".trc"

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        _, clip, _, track = name.removesuffix(".trc").split("-")
        scale = {"m": 1.0, "mm": 0.001}[text.split("\n", 3)[2].split("\t")[4]]
        for line in text.split("\n")[5:]:
            if line:
                frame, _, *places = line.split("\t")
                xyz = [None if p == "" else float(p) * scale for p in places]
                yield int(clip), int(track), int(frame), list(zip(xyz[::3], xyz[1::3], xyz[2::3], strict=True))


class Markers(DataSource):
    """Marker text of tracks with 3D places (options fps and units, m or mm); read as places in metres."""

    @classmethod
    def name(cls) -> str:
        return "trc"

    def schema(self) -> str:
        return "clip_id bigint, track_id bigint, frame_index bigint, kp3d array<struct<x: double, y: double, z: double>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MarkerReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MarkerWriter(self.options["path"], overwrite, float(self.options["fps"]), self.options.get("units", "m"))
