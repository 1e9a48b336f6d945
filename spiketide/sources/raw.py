"""Raw 16-bit channels as a partitioned data source: a file is read in ranges of bytes, each by a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file to a task, and frames to a batch; both may be set as options.
RANGE_BYTES, BATCH_FRAMES = 64 << 20, 1 << 18


def file_system(path: str):
    """(file system, path in it) of a URI or a plain local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    """Bytes [start, end) of a file, whole records of it."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class RawReader(DataSourceReader):
    def __init__(self, options: dict):  # keys in lower case
        self.path = options["path"]
        self.record = 4 if options.get("interleaved", "false").lower() == "true" else 2
        self.size = max(1, int(options.get("rangebytes", RANGE_BYTES)) // self.record) * self.record

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return sorted((f.path, f.size) for f in found if f.is_file)

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(at + self.size, size // self.record * self.record)) for path, size in self._files() for at in range(0, size // self.record * self.record, self.size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        with file_system(self.path)[0].open_input_file(part.path) as file:
            file.seek(part.start)
            at = part.start
            while at < part.end:
                data = file.read(min(BATCH_FRAMES * self.record, part.end - at))
                v = np.frombuffer(data, "<i2")
                v = np.maximum(v[::2], v[1::2]) if self.record == 4 else v
                frames = at // self.record + np.arange(len(v), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(v)), pa.array(frames), pa.array(v.astype(np.int32))], ["path", "frame", "voltage"])
                at += len(data)


class RawChannel(DataSource):
    """format("raw_channel"): (path, frame, voltage) of a file of little-endian 16-bit samples or of the files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "raw_channel"

    def schema(self) -> str:
        return "path string, frame long, voltage int"

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))


def raw_channel(spark: SparkSession, path: str, interleaved: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, frame, voltage) of raw 16-bit little-endian samples, a file or a folder of them, on a file system that
    pyarrow reads and all executors see.

    interleaved: of each pair of samples of two channels the greater. What is left of a file after its last whole sample or
    pair is left out; empty files give no rows. Files are read in ranges of range_bytes, a task each, a batch at a time.
    """
    spark.dataSource.register(RawChannel)
    return spark.read.format("raw_channel").option("interleaved", str(interleaved).lower()).option("rangeBytes", str(range_bytes)).load(path)
