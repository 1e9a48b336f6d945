"""Streams of spikes: alignment to a fixed trigger table, counts in windows, bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the Parquet files under path, or of the one file that it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path if folder else f"{path[:-1]}[{path[-1]}]")


def landed(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now and return the table it leaves under `folder`, which keeps its
    progress as well: another call takes up where this one ended. A batch that is repeated after a failure replaces its first attempt. In
    complete mode the last batch is the table."""
    spark, table = stream.sparkSession, f"{folder}/table"

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={'latest' if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(table)


def triggered(stream: DataFrame, stimuli: DataFrame, dim_rows: int) -> DataFrame:
    """Alignment of a stream of spikes; repeated spikes are dropped within the state that deduplication keeps."""
    return align.triggered(stream, stimuli, dim_rows=dim_rows)


def window_counts(stream: DataFrame, time: str, by: list[str], length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Spikes of each group in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def bursts(stream: DataFrame, time: str, by: list[str], gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of spikes of a group with no gap as long as `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
