"""Domain tables made from the test tables: spikes from events, stimuli from constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FS, PERIOD, LENGTH, EVERY, LOGIC = 3600.0, 518_400, 432_000, 43_200, 2
NAMES = ("fff", "chirp", "csteps", "fff", "chirp")
RECORDINGS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("rec_"), F.col("user_id") % RECORDINGS).alias("recording"), F.col("user_id").alias("cell_index"), seconds.alias("times"), "value")


def stimuli(spark: SparkSession) -> DataFrame:
    """One row per recording and stimulus: at most RECORDINGS * 5."""
    trigger = F.sequence(F.lit(0).cast("long"), F.lit(LENGTH).cast("long"), F.lit(EVERY).cast("long"))
    rows = spark.range(RECORDINGS * len(NAMES), numPartitions=1)
    i = (F.col("id") % len(NAMES)).cast("int")
    return rows.select(
        F.concat(F.lit("rec_"), F.floor(F.col("id") / len(NAMES))).alias("recording"), i.alias("stimulus_index"), F.element_at(F.array(*map(F.lit, NAMES)), i + 1).alias("stimulus_name"),
        (i.cast("long") * PERIOD).alias("begin_fr"), (i.cast("long") * PERIOD + LENGTH).alias("end_fr"), trigger.alias("trigger_fr_relative"),
        F.array_repeat(F.lit(EVERY).cast("long"), LENGTH // EVERY).alias("trigger_int"), F.lit(LOGIC).alias("stimulus_repeat_logic"), F.lit(1).alias("stimulus_repeat_sublogic"), F.lit(FS).alias("sampling_freq"),
    )


STIMULUS_ROWS = RECORDINGS * len(NAMES) * (LENGTH // EVERY)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimuli whose triggers are spikes: of every stimulus window of a recording, the first spike of each tenth of it. Their
    intervals are uneven, repeats take 1 to 3 intervals and may be cut short, intervals have one or two parts."""
    t = spikes(spark, sf_dir).select("recording", F.floor((F.col("times") - 1) / PERIOD).cast("int").alias("stimulus_index"), "times")
    at = F.col("times") - F.col("stimulus_index").cast("long") * PERIOD
    inside = t.filter((F.col("stimulus_index") >= 0) & (F.col("stimulus_index") < len(NAMES)) & (at > 0) & (at <= LENGTH))
    slots = inside.groupBy("recording", "stimulus_index", F.floor((at - 1) / EVERY).alias("slot")).agg(F.min("times").alias("t"))
    every = slots.groupBy("recording", "stimulus_index").agg(F.array_sort(F.collect_list("t")).alias("t")).filter(F.size("t") > 1)
    first, n = F.get("t", F.lit(0)), F.size("t")
    gaps = F.zip_with(F.slice("t", F.lit(2), n - 1), F.slice("t", F.lit(1), n - 1), lambda b, a: b - a)
    i = F.col("stimulus_index")
    return every.select(
        "recording", "stimulus_index", F.element_at(F.array(*map(F.lit, NAMES)), i + 1).alias("stimulus_name"), first.alias("begin_fr"), F.element_at("t", -1).alias("end_fr"),
        F.transform("t", lambda x: x - first).alias("trigger_fr_relative"), gaps.alias("trigger_int"),
        (i % 3 + 1).alias("stimulus_repeat_logic"), (i % 2 + 1).alias("stimulus_repeat_sublogic"), F.lit(FS).alias("sampling_freq"),
    )
