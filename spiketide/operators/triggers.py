"""Trigger arrays of stimuli and detection of triggers on a recorded channel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables


def trigger_times(stimuli: DataFrame, how: str = "mean") -> DataFrame:
    """(recording, stimulus_index, position, seconds): mean, max or min over repeats of each interval within a repeat,
    dealt evenly over its sub-positions."""
    op = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    reps = F.floor(F.size("trigger_int") / F.col("stimulus_repeat_logic"))
    each = stimuli.select("*", F.posexplode("trigger_int").alias("k", "frames"), reps.alias("reps")).filter(F.col("k") < F.col("reps") * F.col("stimulus_repeat_logic"))
    keys = ["recording", "stimulus_index", "stimulus_repeat_sublogic", "sampling_freq"]
    per = each.groupBy(*keys, (F.col("k") % F.col("stimulus_repeat_logic")).alias("at")).agg(op("frames").alias("frames"))
    sub = per.select("*", F.explode(F.sequence(F.lit(0), F.col("stimulus_repeat_sublogic") - 1)).alias("s"))
    return sub.select("recording", "stimulus_index", (F.col("at") * F.col("stimulus_repeat_sublogic") + F.col("s")).cast("long").alias("position"), (F.col("frames") / F.col("stimulus_repeat_sublogic") / F.col("sampling_freq")).alias("seconds"))


def stimulus_duration(stimuli: DataFrame) -> DataFrame:
    return trigger_times(stimuli).groupBy("recording", "stimulus_index").agg(F.sum("seconds").alias("duration"))


def repeats(stimuli: DataFrame) -> DataFrame:
    """nr_repeats: whole repeats in the trigger array."""
    return stimuli.withColumn("nr_repeats", F.floor((F.size("trigger_fr_relative") - 1) / F.col("stimulus_repeat_logic")).cast("long"))


def find_ends(stimuli: DataFrame) -> DataFrame:
    """(recording, stimulus_index, k, trigger_end): onset plus the least interval at this place of a repeat."""
    each = stimuli.select("recording", "stimulus_index", "stimulus_repeat_logic", "trigger_fr_relative", F.posexplode("trigger_int").alias("k", "frames"))
    w = Window.partitionBy("recording", "stimulus_index", F.col("k") % F.col("stimulus_repeat_logic"))
    return each.select("recording", "stimulus_index", F.col("k").cast("long").alias("k"), (F.get("trigger_fr_relative", F.col("k")) + F.min("frames").over(w)).alias("trigger_end"))


def split_triggers(triggers: Column, splits: int) -> Column:
    """Insert the whole-numbered midpoint between neighbours, so often."""
    for _ in range(splits):
        ahead = F.slice(triggers, 2, F.greatest(F.size(triggers) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(triggers, 1, F.greatest(F.size(triggers) - 1, F.lit(0))), ahead, lambda a, b: F.array(a, F.floor((a + b) / 2).cast("long")))
        triggers = F.concat(F.flatten(pairs), F.slice(triggers, F.size(triggers), 1))
    return triggers


def regular_triggers(length: Column, every: Column) -> Column:
    """0, every, ... below length."""
    return F.sequence(F.lit(0).cast("long"), (length - 1).cast("long"), every.cast("long"))


def downsample(channel: DataFrame, factor: int) -> DataFrame:
    """Greatest voltage of every `factor` frames."""
    return channel.groupBy(F.floor(F.col("frame") / factor).cast("long").alias("slot")).agg(F.max("voltage").alias("voltage"))


def detect(channel: DataFrame, by: list[str]) -> DataFrame:
    """Left edges of plateaus above half the range of each channel: two frames or more, both edges inside the slice."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("frame")
    half = (F.min("voltage").over(group) + F.max("voltage").over(group)) / 2
    marked = channel.withColumns({"high": (F.col("voltage") > half).cast("int"), "first": F.min("frame").over(group), "final": F.max("frame").over(group)})
    runs = marked.withColumn("turn", (F.col("high") != F.lag("high", 1, -1).over(order)).cast("int")).withColumn("island", F.sum("turn").over(order))
    tops = runs.filter("high = 1").groupBy(*by, "island").agg(F.min("frame").alias("frame"), F.max("frame").alias("end"), F.count("*").alias("width"), F.first("first").alias("first"), F.first("final").alias("final"))
    return tops.filter("width >= 2 and frame > first and `end` < final").select(*by, "frame", "width")


def category(repeat: Column, labels: list[str], reps: int) -> Column:
    """The label of a repeat by its place in the cycle; empty after `reps` cycles."""
    n = len(labels)
    return F.when(repeat < n * reps, F.element_at(F.array(*map(F.lit, labels)), (repeat % n + 1).cast("int"))).otherwise("")


def remapped(df: DataFrame, column: str, order: list[int]) -> DataFrame:
    """Triggers renamed: the k-th takes the k-th number of `order`; others become null."""
    return df.withColumn(column, F.get(F.array(*map(F.lit, order)), F.col(column).cast("int")))


def refresh_grid(frames: Column, fs: Column, rate: float = 60.0) -> Column:
    """The frames at which a display of the given rate refreshes: ceil(k * fs / rate) below `frames`."""
    count = F.ceil(frames * rate / fs)
    every = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: F.ceil(k * fs / rate))
    return F.filter(every, lambda x: x < frames)


def indices_of(stimuli: DataFrame, names: list[str]) -> DataFrame:
    """(recording, stimulus_index, stimulus_name) of the stimuli whose name holds one of the names."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.col("stimulus_name"), F.lit(n)) for n in names], F.lit(False))
    return stimuli.filter(hit).select("recording", "stimulus_index", "stimulus_name")


def interleaved(starts: Column, ends: Column, fs: float) -> Column:
    """Start and end times in turn as frames, then one more after the mean distance of all; null with fewer than one pair."""
    flat = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b)))
    last, first = F.try_element_at(flat, F.lit(-1)), F.try_element_at(flat, F.lit(1))
    closed = F.concat(flat, F.array(last + F.try_divide(last - first, F.size(flat) - 1)))
    return F.when(F.size(flat) > 1, F.transform(closed, lambda t: F.floor(t * fs).cast("long")))


def stimulus_info(stimuli: DataFrame) -> DataFrame:
    """(recording, stimulus_index, begin, end, first, rest, logic): bounds, first trigger, further triggers and repeat logic."""
    rest = F.slice("trigger_fr_relative", 2, F.greatest(F.size("trigger_fr_relative") - 1, F.lit(0)))
    first = F.get("trigger_fr_relative", F.lit(0))
    return stimuli.select("recording", "stimulus_index", F.col("begin_fr").alias("begin"), F.col("end_fr").alias("end"), first.alias("first"), rest.alias("rest"), F.col("stimulus_repeat_logic").alias("logic"))


def random_latencies(groups: DataFrame, events: DataFrame, by: list[str], time: str, draws: int, low: int, high: int, most: int, seed: int = 1) -> DataFrame:
    """(by..., draw, at, latency): the null of a latency. Each group gets `draws` whole times in [low, high) from hashes of
    seed, keys and draw, and the time to its next event (at or after), null where none comes within `most`. One shuffle."""
    at = low + F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") % (high - low)
    asked = groups.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("back", -at)
    known = events.select(*by, (-F.col(time)).cast("long").alias("back"), F.col(time).cast("long").alias("next"))
    met = tables.asof(asked, known, by, "back", ["next"]).withColumn("latency", F.col("next") + F.col("back"))
    return met.select(*by, "draw", (-F.col("back")).alias("at"), F.when(F.col("latency") <= most, F.col("latency")).alias("latency"))


def random_onsets(onsets: DataFrame, by: list[str], draws: int, jitter: float, seed: int = 1) -> DataFrame:
    """(by..., trigger, repeat, onset): the null of responses to triggers. Each group gets `draws` onsets, numbered by
    `repeat`: one of its own, chosen by a hash of seed, keys and draw, moved by up to `jitter` either way, evenly; `trigger` is 0.

    Together with latency.trigger_windows(), which opens a window on both sides, these stand beside the real ones. Onsets of a group (its triggers)
    come together in an array; groups without any have no row.
    """
    own = onsets.filter(F.col("onset").isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.col("onset").cast("double"))).alias("__own"))
    drawn = own.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<long>")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("repeat").cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    moved = F.get("__own", (number(1) % F.size("__own")).cast("int")) + (number(9) / F.lit(float(1 << 31)) - 1.0) * jitter
    return drawn.select(*by, F.lit(0).cast("long").alias("trigger"), "repeat", moved.alias("onset"))
