"""Alignment of spikes to stimulus windows, trigger intervals and repeats.

A stimulus window is (begin, end]; a trigger interval is [start, next), the last one closed. Times stay whole frames
until the last projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of trigger intervals up to which they are broadcast.
BROADCAST_ROWS = 500_000


def intervals(stimuli: DataFrame) -> DataFrame:
    """One row per trigger interval: k-th of its stimulus, start and end relative to the window, onset of its repeat."""
    every = stimuli.select("*", F.size("trigger_fr_relative").alias("m"), F.posexplode("trigger_fr_relative").alias("k", "start")).filter("k < m - 1")
    logic = F.greatest(F.col("stimulus_repeat_logic"), F.lit(1))
    repeat = F.floor(F.col("k") / logic)
    return every.select(
        "recording", "stimulus_index", "begin_fr", "end_fr", "sampling_freq", F.col("k").cast("long").alias("k"), "start",
        F.get("trigger_fr_relative", F.col("k") + 1).alias("end"), (F.col("k") == F.col("m") - 2).alias("last"),
        (F.col("k") % logic).cast("long").alias("trigger"), repeat.cast("long").alias("repeat"),
        F.get("trigger_fr_relative", (repeat * logic).cast("int")).alias("onset"),
    )


def _meet(spikes: DataFrame, dim: DataFrame, low, high, inside, rows: int | None) -> DataFrame:
    """Join of spikes with windows [low, high] of their recording by recording and bucket of time. Buckets are as wide as
    the windows are on average, so windows fall in three times as many buckets as there are windows at most. Windows known
    to be few are broadcast; else Spark decides by their size."""
    width = dim.agg(F.greatest(F.lit(1), F.floor(F.avg(high - low))).alias("width"))
    windows = dim.join(F.broadcast(width)).withColumn("bucket", F.explode(F.sequence(F.floor(low / F.col("width")), F.floor(high / F.col("width"))))).drop("width")
    windows = F.broadcast(windows) if rows is not None and rows <= BROADCAST_ROWS else windows
    placed = spikes.join(F.broadcast(width)).withColumn("bucket", F.floor(F.col("times") / F.col("width"))).drop("width")
    return placed.join(windows, ["recording", "bucket"]).filter(inside).drop("bucket")


def triggered(spikes: DataFrame, stimuli: DataFrame, legacy: bool = False, seconds: bool = True, dim_rows: int | None = None) -> DataFrame:
    """Each spike in each stimulus window of its recording, once per trigger interval it falls in.

    legacy: intervals are (start, end] instead. seconds: divide by the sampling frequency at the end. Spikes that occur
    twice come out once. dim_rows: the number of trigger intervals, if known.
    """
    dim = intervals(stimuli)
    rel = F.col("times") - F.col("begin_fr")
    if legacy:
        own = (rel > F.col("start")) & (rel <= F.col("end"))
    else:
        own = (rel >= F.col("start")) & ((rel < F.col("end")) | (F.col("last") & (rel <= F.col("end"))))
    window = (F.col("times") > F.col("begin_fr")) & (F.col("times") <= F.col("end_fr"))
    low, high = F.col("begin_fr") + F.col("start"), F.col("begin_fr") + F.col("end")
    hit = _meet(spikes.select("recording", "cell_index", "times"), dim, low, high, window & own, dim_rows)
    hit = hit.dropDuplicates(["recording", "cell_index", "stimulus_index", "times", "k"])
    scale = F.col("sampling_freq") if seconds else F.lit(None)
    unit = (lambda c: c / scale) if seconds else (lambda c: c)
    return hit.select(
        "recording", "cell_index", "stimulus_index", unit(F.col("times")).alias("times"), unit(rel).alias("times_relative"),
        "trigger", "repeat", unit(rel - F.col("onset")).alias("times_triggered"),
    )


#: What carry() gives spikes without a row in the cell table, by the type of the column; other types: null. Fixed values.
MISSING = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False, "string": ""}


def carry(result: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the cell table beside each spike, joined by recording, cell and, where the cell table has it, stimulus.

    Nulls of the cell table stay null; a spike without a row in it gets 0, false or an empty text by the column's type. Of
    several rows of a key the greatest counts, its columns together. Rows whose keys are null match none.
    """
    keys = [k for k in ("recording", "cell_index", "stimulus_index") if k in cells.columns and k in result.columns]
    some = cells.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("__carried"))
    joined = result.drop(*columns).join(some, keys, "left")

    def value(c: str):
        kind = cells.schema[c].dataType.simpleString()
        none = F.lit(MISSING.get("double" if kind.startswith("decimal") else kind)).cast(cells.schema[c].dataType)
        return F.when(F.col("__carried").isNull(), none).otherwise(F.col(f"__carried.{c}"))

    return joined.withColumns({c: value(c) for c in columns}).drop("__carried")


def cell_counts(spikes: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Spikes of every cell of a recording in every stimulus window of it, zeros included."""
    dim = stimuli.select("recording", "stimulus_index", "stimulus_name", "begin_fr", "end_fr")
    grid = spikes.select("recording", "cell_index").distinct().join(dim, "recording")
    inside = (F.col("times") > F.col("begin_fr")) & (F.col("times") <= F.col("end_fr"))
    found = _meet(spikes, dim, F.col("begin_fr"), F.col("end_fr"), inside, None).groupBy("recording", "cell_index", "stimulus_index").agg(F.count("*").alias("n"))
    keys = ["recording", "cell_index", "stimulus_index"]
    return grid.join(found, keys, "left").select(*keys, "stimulus_name", F.coalesce("n", F.lit(0)).cast("long").alias("nr_of_spikes"))


def align_on_condition(df: DataFrame, condition: str, starts: list[float], time: str) -> DataFrame:
    """Subtract from `time` the start that belongs to the rank of the condition's value among its sorted values."""
    ranks = df.select(condition).distinct()
    known = [r[0] for r in ranks.orderBy(condition).limit(len(starts) + 1).collect()]
    if len(known) != len(starts):
        raise ValueError(f"{condition} has not {len(starts)} values")
    place = F.create_map(*[x for v, s in zip(known, starts, strict=True) for x in (F.lit(v), F.lit(float(s)))])
    return df.withColumn(time, F.col(time) - F.element_at(place, F.col(condition)))
