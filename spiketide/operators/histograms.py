"""Histograms, binary signals and response quality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_index(t: Column, start: float, width: float) -> Column:
    """The i with start + i*width <= t < start + (i+1)*width, edges as doubles: a floor, put right by one either way."""
    i = F.floor((t - F.lit(float(start))) / F.lit(float(width)))
    edge = lambda k: F.lit(float(start)) + k * F.lit(float(width))
    return F.when(t < edge(i), i - 1).when(t >= edge(i + 1), i + 1).otherwise(i).cast("long")


def edges(start: float, end: float, width: float) -> np.ndarray:
    return np.arange(start, end, width)


def psth(df: DataFrame, time: str, width: float, end: float, by: list[str] | None = None, start: float = 0.0) -> DataFrame:
    """Dense counts (by..., bin, count): n edges from start by width below end make n-1 bins, half-open but for the
    last. Groups without rows are absent; a group whose rows all lie outside has zeros."""
    by = by or []
    n = max(0, len(edges(start, end, width)) - 1)
    i = bin_index(F.col(time), start, width)
    last = F.lit(float(start)) + F.lit(n) * F.lit(float(width))
    placed = df.withColumn("bin", F.when((F.col(time) == last) & F.lit(n > 0), F.lit(n - 1)).otherwise(i).cast("long"))
    counts = placed.filter((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*by, "bin").agg(F.count("*").alias("count"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))).cast("array<long>")).alias("bin")
    grid = df.select(*by).distinct().select(*by, bins) if by else df.sparkSession.range(n).select(F.col("id").alias("bin"))
    return grid.filter(F.lit(n > 0)).join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def cumulative(hist: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cumulative", F.sum("count").over(w))


def stacked(hist: DataFrame, by: list[str], value: str = "count") -> DataFrame:
    """(by..., values): the bins of each group as one array in their order, a row of the matrix of all groups. Histograms are dense, so all
    rows are of one length; of groups that lack a bin the array is shorter."""
    rows = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", value))).alias("s"))
    return rows.select(*by, F.transform("s", lambda x: x[value]).alias("values"))


def autorange(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins between the least and the greatest value; one pass for the range, one for the counts."""
    ends = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    i = F.least(F.floor((F.col(column) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(i.alias("bin")).agg(F.count("*").alias("count"))


def binary(df: DataFrame, time: str, width: float, window: float, repeats: int, cell: list[str]) -> DataFrame:
    """(cell..., repeat, index, value): 1 where a spike falls in the bin; every repeat and bin of every cell is there."""
    n = math.ceil(window / width)
    hits = df.filter((F.col(time) >= 0) & (F.col(time) < window) & (F.col("repeat") < repeats))
    hits = hits.select(*cell, "repeat", F.least(bin_index(F.col(time), 0, width), F.lit(n - 1)).alias("index")).distinct().withColumn("hit", F.lit(1))
    grid = df.select(*cell).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<long>")))
    grid = grid.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    return grid.join(hits, [*cell, "repeat", "index"], "left").select(*cell, "repeat", "index", F.coalesce("hit", F.lit(0)).cast("tinyint").alias("value"))


def binary_arrays(signal: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., repeat, values): each repeat of a binary signal as an array, in order of its bins."""
    rows = signal.groupBy(*cell, "repeat").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("s"))
    return rows.select(*cell, "repeat", F.transform("s", lambda x: x["value"]).alias("values"))


def reject_single(df: DataFrame, cell: list[str]) -> DataFrame:
    """Without cells of one spike or of one repeat."""
    poor = df.groupBy(*cell).agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("r")).filter("n = 1 or r = 1")
    return df.join(poor, cell, "left_anti")


def variance_ratio(signal: DataFrame, cell: list[str]) -> DataFrame:
    """Variance over time of the mean over repeats, by the mean over time of the variance over repeats."""
    at = signal.groupBy(*cell, "index").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return at.groupBy(*cell).agg(F.try_divide(F.var_pop("m"), F.avg("v")).alias("qi"))


def kernel(width: float = 0.01, fs: float = 1000.0) -> np.ndarray:
    """A Gaussian of the given full width at half maximum, its sum 1."""
    half = int(0.02 * fs)
    t = np.arange(-half, half)
    k = np.exp(-4 * math.log(2) * t**2 / int(fs * width) ** 2)
    return k / k.sum()


def smoothed(signal: DataFrame, cell: list[str], taps: list[float]) -> DataFrame:
    """(cell..., repeat, index, value): each repeat convolved with the taps where they lie inside it as a whole; bins are dense. A
    repeat shorter than the taps has no rows."""
    rows = signal.groupBy(*cell, "repeat").agg(F.array_sort(F.collect_list(F.struct("index", F.col("value").cast("double").alias("value")))).alias("s"))
    v, m = F.transform("s", lambda x: x["value"]), len(taps)
    weights = F.array(*[F.lit(float(t)) for t in reversed(list(taps))])
    at = lambda i: F.aggregate(F.zip_with(F.slice("v", i, F.lit(m)), weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    long = rows.select(*cell, "repeat", v.alias("v")).filter(F.size("v") >= m)
    out = long.select(*cell, "repeat", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("v") - m + 1), at)).alias("index", "value"))
    return out.withColumn("index", F.col("index").cast("long"))


def quality_index(signal: DataFrame, cell: list[str], fs: float = 1000.0) -> DataFrame:
    """(cell..., qi): the variance ratio of the repeats smoothed by kernel(); null where repeats never differ or are
    shorter than the kernel. A repeat's bins meet in an array, a cell's in sums."""
    found = variance_ratio(smoothed(signal, cell, kernel(fs=fs).tolist()), cell)
    return signal.select(*cell).distinct().join(found, cell, "left").select(*cell, "qi")


def local_peaks(hist: DataFrame, by: list[str], distance: float) -> DataFrame:
    """(by..., bin, count): tops of a dense histogram as high as the group's standard deviation, thinned out by distance.

    A top is a run of equal counts with lower ones on both sides, at its middle bin, the earlier of two; a run at an end of the histogram is
    none. From the highest on (of equal ones the earlier first), each top that stays removes those less than
    `distance` bins away; a top that is gone removes nothing. Tops that lie `distance` or more from the next do not touch each other, so
    a group is cut there and each cluster of tops is thinned on its own. Rows without a count are left out.
    """
    order, group = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    known = hist.filter(F.col("count").isNotNull())
    turned = known.withColumns({"turn": F.coalesce((F.col("count") != F.lag("count").over(order)).cast("int"), F.lit(0)), "sd": F.stddev_pop("count").over(group)})
    runs = turned.withColumn("run", F.sum("turn").over(order)).groupBy(*by, "run").agg(F.min("bin").alias("first"), F.max("bin").alias("final"), F.first("count").alias("count"), F.first("sd").alias("sd"))
    along = Window.partitionBy(*by).orderBy("run")
    tops = runs.withColumns({"before": F.lag("count").over(along), "after": F.lead("count").over(along)}).filter("count > before and count > after and count >= sd")
    tops = tops.select(*by, F.floor((F.col("first") + F.col("final")) / 2).cast("long").alias("bin"), "count")
    far = F.coalesce((F.col("bin") - F.lag("bin").over(order) >= distance).cast("int"), F.lit(0))
    clusters = tops.withColumn("far", far).withColumn("cluster", F.sum("far").over(order)).groupBy(*by, "cluster")
    ranked = clusters.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("low"), "bin", "count"))).alias("tops"))
    none = F.slice("tops", 1, 0)
    kept = F.aggregate("tops", none, lambda k, x: F.when(F.exists(k, lambda y: F.abs(y["bin"] - x["bin"]) < distance), k).otherwise(F.concat(k, F.array(x))))
    return ranked.select(*by, F.explode(kept).alias("top")).select(*by, "top.bin", "top.count")


def peak_heights(peaks: DataFrame, onsets: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by..., position, height): the height of the peak that belongs to each onset, 0 where there is none.

    peaks (by..., bin, count) lie at bin * width; onsets (by..., position, seconds) hold the length of each interval of a
    stimulus in order of position. An interval begins at the sum of those before it, rounded to whole seconds, halves to even; a peak
    belongs to the nearest beginning, the first of equally near ones; of an onset's peaks the last counts.
    """
    before = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    starts = onsets.select(*by, "position", F.bround(F.coalesce(F.sum("seconds").over(before), F.lit(0.0))).alias("start"))
    every = starts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "start"))).alias("starts"))
    near = F.array_min(F.transform("starts", lambda s: F.struct(F.abs(F.col("bin") * width - s["start"]).alias("d"), s["position"].alias("position"))))
    own = peaks.join(every, by).select(*by, near["position"].alias("position"), "bin", "count").groupBy(*by, "position").agg(F.max_by("count", "bin").alias("height"))
    return starts.select(*by, "position").join(own, [*by, "position"], "left").select(*by, "position", F.coalesce("height", F.lit(0)).cast("long").alias("height"))


def weighted(df: DataFrame, value: str, weight: str, width: float, end: float, by: list[str], density: bool = False) -> DataFrame:
    """(by..., bin, weight): sums of weights in bins of the given width from 0 below end; with density, as shares of the
    group's sum by bin width. Bins without rows are absent."""
    sums = df.filter((F.col(value) >= 0) & (F.col(value) < end)).groupBy(*by, bin_index(F.col(value), 0, width).alias("bin")).agg(F.sum(weight).alias("weight"))
    if not density:
        return sums
    every = sums.groupBy(*by).agg(F.sum("weight").alias("__sum"))
    return sums.join(every, by).select(*by, "bin", F.try_divide(F.col("weight"), F.col("__sum") * width).alias("weight"))


def weighted_ecdf(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """(by..., value, ecdf): the running share of the group's weight up to each value."""
    steps = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*by).orderBy(value)
    return steps.select(*by, value, F.try_divide(F.sum("__w").over(w), F.sum("__w").over(Window.partitionBy(*by))).alias("ecdf"))


def group_ranges(df: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """(by..., bin, count): equal bins between the least and the greatest value of each group; all in bin 0 where these
    are equal."""
    ends = df.groupBy(*by).agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    i = F.coalesce(F.least(F.floor(F.try_divide(F.col(column) - F.col("low"), (F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)), F.lit(0)).cast("long")
    return df.filter(F.col(column).isNotNull()).join(ends, by).groupBy(*by, i.alias("bin")).agg(F.count("*").alias("count"))
