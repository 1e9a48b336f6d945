"""Readers and writers of spike tables, trigger channels and sorter output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histograms
from .arrays import array_file
from .raw import raw_channel

#: Old column names of stimulus and cell tables and what they are called now; fixed values.
RENAMED = {"Stimulus_name": "stimulus_name", "Begin_Fr": "begin_fr", "End_Fr": "end_fr", "Trigger_Fr_relative": "trigger_fr_relative", "Trigger_int": "trigger_int", "Stimulus_index": "stimulus_index", "Stimulus_repeat_logic": "stimulus_repeat_logic", "Stimulus_repeat_sublogic": "stimulus_repeat_sublogic", "Cell index": "cell_index", "Nr of Spikes": "nr_of_spikes", "Centres x": "centres_x", "Centres y": "centres_y"}


def spikes(spark: SparkSession, path: str, waveforms: bool = False) -> DataFrame:
    """A spike table, a folder for each recording; waveforms are read only if asked for."""
    df = spark.read.parquet(path)
    return df if waveforms else df.select("recording", "cell_index", "times")


def write_spikes(df: DataFrame, path: str) -> None:
    df.repartition("recording").sortWithinPartitions("recording", "cell_index", "times").write.partitionBy("recording").mode("overwrite").parquet(path)


def write_psth(hist: DataFrame, by: list[str], path: str, width: float, start: float = 0.0) -> None:
    """A dense histogram as Parquet, a row of counts for each group, with the width and the start of its bins."""
    histograms.stacked(hist, by).withColumns({"bin_width": F.lit(float(width)), "bin_start": F.lit(float(start))}).write.mode("overwrite").parquet(path)


def read_psth(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by..., bin, time, count) of what write_psth() wrote; time is where a bin begins."""
    rows = spark.read.parquet(path).select(*by, "bin_width", "bin_start", F.posexplode("values").alias("bin", "count"))
    return rows.select(*by, F.col("bin").cast("long").alias("bin"), (F.col("bin_start") + F.col("bin") * F.col("bin_width")).alias("time"), "count")


def modernised(df: DataFrame) -> DataFrame:
    """Old column names brought up to date."""
    return df.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in df.columns})


def from_arrays(cells: DataFrame, recording: str) -> DataFrame:
    """Spike table of (cell_index, spiketimes array)."""
    return cells.select(F.lit(recording).alias("recording"), F.col("cell_index").cast("long").alias("cell_index"), F.explode(F.col("spiketimes").cast("array<long>")).alias("times"))


def centres(spike_positions: DataFrame) -> DataFrame:
    """Mean position of each cell's spikes."""
    return spike_positions.groupBy("cell_index").agg(F.avg("x").alias("centres_x"), F.avg("y").alias("centres_y"))


READERS = {"parquet": lambda spark, path: spark.read.parquet(path), "csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=False), "dat": raw_channel, "npy": array_file}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read by the suffix of the path."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in READERS:
        raise NotImplementedError(f"no reader for .{suffix}; bring it to parquet, csv, npy or raw .dat")
    return READERS[suffix](spark, path)
