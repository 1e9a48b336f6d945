"""Bayesian change points and first spikes as window functions over the events of a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def posterior(events: DataFrame, by: list[str], time: str, before: float, after: float, tau: float | None = None, std: float | None = None) -> DataFrame:
    """(by..., candidate, posterior): each event but the last as the place where a rate `before` turns into `after`;
    with tau and std, weighted by a Gaussian prior. Probabilities of a group sum to one."""
    group = Window.partitionBy(*by)
    ranked = events.select(*by, F.col(time).cast("double").alias("t")).withColumns({"i": F.row_number().over(group.orderBy("t")), "n": F.count("*").over(group), "end": F.max("t").over(group)})
    inner = ranked.filter("i < n")
    log = F.col("i") * math.log(before) - before * F.col("t") + (F.col("n") - F.col("i")) * math.log(after) - after * (F.col("end") - F.col("t"))
    scaled = inner.withColumn("log", log).withColumn("weight", F.exp(F.col("log") - F.max("log").over(group)))
    if tau is not None and std is not None:
        scaled = scaled.withColumn("weight", F.col("weight") * F.exp(-0.5 * F.pow((F.col("t") - tau) / std, F.lit(2.0))))
    return scaled.select(*by, F.col("t").alias("candidate"), F.try_divide(F.col("weight"), F.sum("weight").over(group)).alias("posterior"))


def credible_interval(post: DataFrame, by: list[str], mass: float = 0.95) -> DataFrame:
    """(by..., low, high): first candidates at which the running sum reaches the tails; the last candidate at most."""
    w = Window.partitionBy(*by).orderBy("candidate").rowsBetween(Window.unboundedPreceding, 0)
    summed = post.withColumn("cdf", F.round(F.sum("posterior").over(w), 9))
    tail = round((1 - mass) / 2, 9)
    at = lambda q: F.coalesce(F.min(F.when(F.col("cdf") >= q, F.col("candidate"))), F.max("candidate"))
    return summed.groupBy(*by).agg(at(tail).alias("low"), at(1 - tail).alias("high"))


def single_rate(events: DataFrame, by: list[str], time: str, rate: float, epsilon: float, threshold: float) -> DataFrame:
    """(by..., change): the first event whose waiting time is likelier under `rate` than under `epsilon`, by threshold."""
    w = Window.partitionBy(*by).orderBy(time)
    wait = F.col(time) - F.lag(time, 1, 0).over(w)
    f = lambda r: r * F.exp(-r * F.col("wait"))
    p = F.try_divide(f(rate), f(rate) + f(epsilon))
    return events.withColumn("wait", wait.cast("double")).filter(p > threshold).groupBy(*by).agg(F.min(time).alias("change"))


def first_spikes(df: DataFrame, by: list[str], time: str, low: float, high: float) -> DataFrame:
    """(by..., first_spike, spikes): the earliest spike in the open window (low, high) of each group."""
    return df.filter((F.col(time) > low) & (F.col(time) < high)).groupBy(*by).agg(F.min(time).alias("first_spike"), F.count("*").alias("spikes"))


def line_data(df: DataFrame, by: list[str], starts: str, slopes: str, lengths: str, points: int = 10) -> DataFrame:
    """(by..., segment, point, x, y): evenly spaced points of joined line segments, each of which begins where the one
    before it ended; the first at 0. The three columns are arrays of one length."""
    parts = df.select(*by, F.posexplode(F.arrays_zip(F.col(starts).alias("s"), F.col(slopes).alias("m"), F.col(lengths).alias("l"))).alias("segment", "z"), F.arrays_zip(F.col(slopes).alias("m"), F.col(lengths).alias("l")).alias("every"))
    base = F.aggregate(F.slice("every", F.lit(1), F.col("segment")), F.lit(0.0), lambda t, z: t + z["m"] * z["l"])
    steps = parts.select(*by, "segment", "z", base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    along = F.col("z.l") * F.col("point") / (points - 1)
    return steps.select(*by, "segment", "point", (F.col("z.s") + along).alias("x"), (F.col("base") + F.col("z.m") * along).alias("y"))
