"""Array files (.npy) as a partitioned data source, and the spikes and centres of sorters that write them."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raw import BATCH_FRAMES, RANGE_BYTES, file_system


def header(file) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begins) of an array file; arrays of objects, which would have to be unpickled, and arrays in column
    order of more than one dimension are refused."""
    start = file.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size, width = (struct.unpack("<H", file.read(2))[0], 2) if start[6] == 1 else (struct.unpack("<I", file.read(4))[0], 4)
    told = ast.literal_eval(file.read(size).decode("latin-1" if start[6] < 3 else "utf-8"))
    kind, shape = np.dtype(told["descr"]), tuple(told["shape"])
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    if told["fortran_order"] and sum(n > 1 for n in shape) > 1:
        raise ValueError("arrays in column order are not read")
    return kind, shape, 8 + width + size


class Rows(InputPartition):
    """Rows [start, end) of an array."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):  # keys in lower case
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        system, path = file_system(self.path)
        with system.open_input_file(path) as file:
            self.kind, self.shape, self.begin = header(file)
        self.width = int(np.prod(self.shape[1:])) if len(self.shape) > 1 else 1

    def partitions(self) -> list[Rows]:
        rows = self.shape[0] if self.shape else 1
        step = max(1, self.range // max(1, self.width * self.kind.itemsize))
        return [Rows(a, min(a + step, rows)) for a in range(0, rows, step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        system, path = file_system(self.path)
        size = self.width * self.kind.itemsize
        with system.open_input_file(path) as file:
            file.seek(self.begin + part.start * size)
            for at in range(part.start, part.end, max(1, BATCH_FRAMES // max(1, self.width))):
                n = min(max(1, BATCH_FRAMES // max(1, self.width)), part.end - at)
                v = np.frombuffer(file.read(n * size), self.kind)
                whole = v.astype(np.int64 if self.kind.kind in "iub" else np.float64)
                ends = pa.array(np.arange(0, (n + 1) * self.width, self.width)[: n + 1].astype(np.int32)) if self.width else pa.array(np.zeros(n + 1, np.int32))
                columns = [pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, pa.array(whole))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "values"])


class ArrayFile(DataSource):
    """format("array_file"): (row, values) of an .npy file; whole numbers come as longs, others as doubles, a row of more than two
    dimensions flattened."""

    @classmethod
    def name(cls) -> str:
        return "array_file"

    def schema(self) -> str:
        system, path = file_system(self.options["path"])
        with system.open_input_file(path) as file:
            kind = header(file)[0].kind
        return f"row long, values array<{'long' if kind in 'iub' else 'double'}>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def array_file(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row, values) of an array file, read in ranges of rows, a task each; an array without rows has none."""
    spark.dataSource.register(ArrayFile)
    return spark.read.format("array_file").option("rangeBytes", str(range_bytes)).load(path)


def sorted_spikes(spark: SparkSession, folder: str, recording: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """((recording, cell_index, times), (recording, cell_index, centres_x, centres_y)) of a sorter's folder of array files: spike_times,
    spike_clusters and, for the centres, spike_positions, one row to a spike.

    The files meet by row. A cell's centre is the mean position of its spikes, by its own number, so gaps in the numbers do not matter; without positions
    the second table has nulls.
    """
    read = lambda name: array_file(spark, f"{folder}/{name}.npy", range_bytes)
    first = lambda df, out: df.select("row", F.get("values", F.lit(0)).cast("long").alias(out))
    spikes = first(read("spike_clusters"), "cell_index").join(first(read("spike_times"), "times"), "row")
    named = spikes.withColumn("recording", F.lit(recording))
    system, path = file_system(f"{folder}/spike_positions.npy")
    if system.get_file_info(path).is_file:
        places = read("spike_positions").select("row", *[F.get("values", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xy")])
        placed = named.join(places, "row", "left")
    else:
        placed = named.withColumns({c: F.lit(None).cast("double") for c in "xy"})
    centres = placed.groupBy("recording", "cell_index").agg(F.avg("x").alias("centres_x"), F.avg("y").alias("centres_y"))
    return named.select("recording", "cell_index", "times"), centres


def electrode_centres(cells: DataFrame, geometry: DataFrame) -> DataFrame:
    """(recording, cell_index, centres_x, centres_y): cells (recording, cell_index, electrode) with the place of the electrode that
    saw them strongest, from geometry (recording, electrode, x, y); null for electrodes it does not know."""
    met = cells.join(geometry, ["recording", "electrode"], "left")
    return met.select("recording", "cell_index", F.col("x").cast("double").alias("centres_x"), F.col("y").cast("double").alias("centres_y"))


def recording_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, sampling_freq) of text files whose second line is the sampling frequency."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return lines.select("path", F.get("lines", F.lit(1)).try_cast("double").alias("sampling_freq"))
