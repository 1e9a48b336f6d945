"""First spikes after triggers: windows about onsets, firing rates on both sides of a break, and the posterior of the change.

All of it is one long table keyed by cell, trigger and repeat; the events of a key lie in one window of an onset and are few.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rates that stand for those that are not positive, before and after the break: the logarithm needs one. Fixed values.
LEAST_BEFORE, LEAST_AFTER = 1.0, sys.float_info.min


def trigger_windows(events: DataFrame, onsets: DataFrame, keys: list[str], time: str, low: float, high: float) -> DataFrame:
    """events with trigger, repeat and t, the time since the onset, once for every onset whose open window (onset + low,
    onset + high) holds them.

    onsets (keys..., trigger, repeat, onset) and events meet by the keys and by a bucket of time as wide as the
    window, so an onset falls in two buckets, or three; further columns of onsets come along. Events or onsets without
    a time match none.
    """
    width = float(high - low)
    bucket = lambda c: F.floor(c / width)
    spread = onsets.select("*", F.explode(F.sequence(bucket(F.col("onset") + low), bucket(F.col("onset") + high))).alias("__bucket"))
    met = events.withColumn("__bucket", bucket(F.col(time))).join(spread, [*keys, "__bucket"])
    t = F.col(time) - F.col("onset")
    return met.withColumn("t", t).filter((F.col("t") > low) & (F.col("t") < high)).drop("__bucket", "onset", *({time} - set(keys)))


def segment_rates(windows: DataFrame, cell: list[str], breaks: list[float], repeats: int) -> DataFrame:
    """(cell..., trigger, breaks, slopes): events per unit of time and repeat between fixed breaks; what a fit of segments
    to the cumulative counts gives, where no fit is wanted."""
    pairs = list(zip(breaks, breaks[1:], strict=False))
    rates = [F.count(F.when((F.col("t") >= a) & (F.col("t") < b), 1)) / F.lit((b - a) * repeats) for a, b in pairs]
    return windows.groupBy(*cell, "trigger").agg(F.array(*rates).alias("slopes")).select(*cell, "trigger", F.array(*map(F.lit, map(float, breaks))).alias("breaks"), "slopes")


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def rates(fits: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., trigger, before, after, start): firing rates on both sides of the break where a cell begins to respond.

    fits (cell..., trigger, breaks, slopes) has one break more than slopes. A trigger's response starts at the break before its greatest
    slope, a cell's at the median of these; of each trigger the break nearest to that, the first of equally near ones, divides its slopes.
    The rates are the means of the slopes before and after it: LEAST_BEFORE and LEAST_AFTER where these are not
    positive, null where there are none. start: the median of the cells' starts, the same in every row. fits are read
    more than once: store them if they cost much.
    """
    known = fits.select(*cell, "trigger", "breaks", "slopes").filter((F.size("slopes") > 0) & (F.size("breaks") == F.size("slopes") + 1))
    steepest = F.get("breaks", (F.array_position("slopes", F.array_max("slopes")) - 1).cast("int"))
    starts = known.withColumn("start", steepest).groupBy(*cell).agg(F.median("start").alias("own"))
    middle = starts.agg(F.median("own").alias("start"))
    met = known.join(starts, cell).join(F.broadcast(middle))
    nearest = F.array_min(F.transform("breaks", lambda b, i: F.struct(F.abs(b - F.col("own")).alias("d"), i.alias("i"))))["i"]
    split = met.withColumn("at", nearest)
    before = _mean(F.slice("slopes", F.lit(1), F.col("at")))
    after = _mean(F.slice("slopes", F.col("at") + 1, F.greatest(F.size("slopes") - F.col("at"), F.lit(0))))
    clamp = lambda x, least: F.when(x <= 0, least).otherwise(x)
    return split.select(*cell, "trigger", clamp(before, LEAST_BEFORE).alias("before"), clamp(after, LEAST_AFTER).alias("after"), "start")


def first_spikes(windows: DataFrame, fits: DataFrame, cell: list[str], low: float, std: float) -> DataFrame:
    """(cell..., trigger, repeat, n, early, first_spike, posterior): of each repeat the event at which the rate turns from
    `before` into `after` (see rates()).

    Of n events at times c since the window began, all but the last are candidates. Of the i-th, L1 = i ln(before) - before c,
    L2 = (n - i) ln(after) - after (c_n - c), prior = exp(-((c - start) / std)^2 / 2) and posterior = prior
    exp(L1 + L2 - the greatest of these). early: an event lies before the onset; then the greatest posterior decides, or else the
    greatest L2; the first of equal ones. first_spike is its time since the onset; null with under two events, without a
    fit of the trigger, or where the rate that is asked for is null.
    """
    key = [*cell, "trigger", "repeat"]
    group, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("t")
    c = F.col("t") - low
    ranked = windows.select(*key, F.col("t").cast("double").alias("t")).withColumns({"c": c, "i": F.row_number().over(order), "n": F.count("*").over(group), "end": F.max(c).over(group), "early": F.min("t").over(group) < 0})
    met = ranked.join(rates(fits, cell), [*cell, "trigger"], "left")
    inner = F.col("i") < F.col("n")
    one = F.col("i") * F.ln("before") - F.col("before") * F.col("c")
    two = (F.col("n") - F.col("i")) * F.ln("after") - F.col("after") * (F.col("end") - F.col("c"))
    logs = met.withColumns({"two": F.when(inner, two), "both": F.when(inner, one + two)})
    prior = F.exp(-0.5 * F.pow((F.col("t") - F.col("start")) / std, F.lit(2.0)))
    posterior = prior * F.exp(F.col("both") - F.max("both").over(group))
    scored = logs.withColumn("posterior", posterior).withColumn("score", F.when(F.col("early"), F.col("posterior")).otherwise(F.col("two")))
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("i")).alias("i"), "t", "posterior")))
    return scored.groupBy(*key).agg(F.count("*").alias("n"), F.max("early").alias("early"), best.alias("best")).select(*key, "n", "early", F.col("best.t").alias("first_spike"), F.col("best.posterior").alias("posterior"))


def first_spike_summary(found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., trigger, repeats, median, sure): repeats with a first spike, its median, and the mean posterior."""
    return found.filter("first_spike is not null").groupBy(*cell, "trigger").agg(F.count("*").alias("repeats"), F.median("first_spike").alias("median"), F.avg("posterior").alias("sure"))
