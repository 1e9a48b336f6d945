"""Response features: directions, circular statistics, polarity, epochs, tuning, regressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables


#: Labels whose mean vectors are broadcast at once.
MOST_LABELS = 10_000


def direction_vector(df: DataFrame, angle: str, weight: str, by: list[str]) -> DataFrame:
    """(by..., magnitude, direction): vector sum of weights at their own angles, by the total weight; degrees from 0 to 360."""
    a = F.radians(F.col(angle))
    sums = df.groupBy(*by).agg(F.sum(F.col(weight) * F.cos(a)).alias("x"), F.sum(F.col(weight) * F.sin(a)).alias("y"), F.sum(weight).alias("w"))
    turn = F.degrees(F.atan2("y", "x"))
    return sums.select(*by, F.try_divide(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), F.col("w")).alias("magnitude"), ((turn + 360) % 360).alias("direction"))


def rayleigh(df: DataFrame, angle: str, weight: str, by: list[str], spacing: float) -> DataFrame:
    """(by..., mean_angle, z, p): weighted circular mean and Rayleigh test, the resultant corrected for binned angles."""
    import math

    half = math.radians(spacing) / 2
    found = direction_vector(df, angle, weight, by)
    n = df.groupBy(*by).agg(F.sum(weight).alias("n"))
    r = F.least(F.lit(1.0), F.col("magnitude") * (half / math.sin(half)))
    big = F.col("n") * r
    p = F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") * F.col("n") - big * big)) - (1 + 2 * F.col("n")))
    return found.join(n, by).select(*by, F.col("direction").alias("mean_angle"), (big * big / F.col("n")).alias("z"), p.alias("p"))


def polarity(on: Column, off: Column) -> Column:
    """(on - off) / (on + off); 0 where both are 0."""
    return F.coalesce(F.try_divide(on - off, on + off), F.lit(0.0))


def narrowness(values: Column) -> Column:
    """(rest - greatest) / (rest + greatest) of the absolute values."""
    sizes = F.transform(values, lambda x: F.abs(x))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total - 2 * F.array_max(sizes), total)


def epochs(hist: DataFrame, by: list[str], length: int) -> DataFrame:
    """Per epoch of `length` bins: greatest count, its first place in the epoch, share of silent bins, median, sum, and
    transience: the first half's share of the sum."""
    e, at = F.floor(F.col("bin") / length).cast("long"), (F.col("bin") % length).cast("long")
    marked = hist.withColumns({"epoch": e, "at": at})
    return marked.groupBy(*by, "epoch").agg(
        F.max("count").alias("maxima"), (-F.max(F.struct("count", (-F.col("at")).alias("at")))["at"]).alias("argmax"),
        F.avg((F.col("count") == 0).cast("double")).alias("sparsity"), F.median("count").alias("median"), F.sum("count").alias("total"),
        F.try_divide(F.sum(F.when(F.col("at") < length // 2, F.col("count")).otherwise(0)), F.sum("count")).alias("transience"),
    )


def moving_average(df: DataFrame, value: str, order: str, by: list[str], n: int) -> DataFrame:
    """Trailing mean of n rows; the first n-1 of a group are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"moving": F.avg(value).over(w.rowsBetween(-(n - 1), 0)), "seen": F.row_number().over(w)}).filter(F.col("seen") >= n).drop("seen")


def detrended(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Residual of the line fitted to each group."""
    line = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope__"), F.regr_intercept(y, x).alias("intercept__"))
    return df.join(line, by).withColumn("residual", F.col(y) - (F.col("slope__") * F.col(x) + F.col("intercept__"))).drop("slope__", "intercept__")


def detrended_in_parts(df: DataFrame, y: str, x: str, by: list[str], breaks: list[float]) -> DataFrame:
    """Residual of a line fitted to each group and each part of it between the breaks; a break begins the part after it."""
    part = sum(((F.col(x) >= b).cast("int") for b in breaks), F.lit(0))
    return detrended(df.withColumn("__part", part), y, x, [*by, "__part"]).drop("__part")


def autocorrelation(hist: DataFrame, by: list[str], lags: int) -> DataFrame:
    """(by..., lag, product): sums of count(bin) * count(bin + lag). Each bin is copied to `lags` places and meets the
    bin that lies there, so the work grows with bins and lags, not with pairs of bins."""
    shifted = hist.filter("count > 0").select(*by, F.col("count").alias("ahead"), F.col("bin").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"))
    shifted = shifted.withColumn("bin", F.col("from") - F.col("lag"))
    return hist.join(shifted, [*by, "bin"]).groupBy(*by, F.col("lag").cast("long").alias("lag")).agg(F.sum(F.col("count") * F.col("ahead")).alias("product"))


def density(df: DataFrame, value: str, points: int, low: float, high: float, inside: bool = False) -> DataFrame:
    """(x, density): Gaussian kernel density with Scott's bandwidth at evenly spaced points, its greatest value 1. Values
    are put to a grid of points first, carried on beyond both ends, so each value costs one row however many points there
    are. inside: values beyond the ends count for the bandwidth but add nothing to the points."""
    step = (high - low) / (points - 1)
    n = df.filter(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.stddev(value).alias("sd"))
    at = df.filter(F.col(value).isNotNull()).groupBy(F.round((F.col(value) - low) / step).cast("long").alias("at")).agg(F.count("*").alias("c"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "i")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) / step
    cells = at.filter((F.col("at") >= 0) & (F.col("at") < points)) if inside else at
    near = cells.join(F.broadcast(grid)).join(F.broadcast(n))
    curve = near.groupBy("i").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("i") - F.col("at")) / h, F.lit(2.0)))).alias("d"))
    top = curve.agg(F.max("d").alias("top"))
    return curve.join(F.broadcast(top)).select((low + F.col("i") * step).alias("x"), (F.col("d") / F.col("top")).alias("density"))


def ols(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def nearest_centroid(vectors: DataFrame, vector: str, label: str, noise, key: str) -> DataFrame:
    """(key, label, distance): rows labelled `noise` take the label of the nearest mean of the others, the least of equally near
    labels. Means are stored once and broadcast in blocks of about MOST_LABELS, each of which the rows meet in turn; without a mean there are no rows."""
    flat = vectors.filter((F.col(label) != noise) & F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("d", "v"))
    means = flat.groupBy(label, "d").agg(F.avg("v").alias("v")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("mean"))
    means = tables.stored(means)
    blocks = max(1, -(-means.count() // MOST_LABELS))
    to = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("mean"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    asked = vectors.filter(F.col(label) == noise).select(key, vector)
    best = F.min(F.struct(to.alias("distance"), F.col(label).alias("label")))
    near = [asked.join(F.broadcast(means.filter(F.pmod(F.xxhash64(label), F.lit(blocks)) == b))).groupBy(key).agg(best.alias("b")) for b in range(blocks)]
    every = reduce(lambda a, b: a.unionByName(b), near).groupBy(key).agg(F.min("b").alias("b"))
    return every.select(key, F.col("b.label").alias("label"), F.col("b.distance").alias("distance"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n): Pearson's correlation of every ordered pair of columns, in one pass over the rows; n counts the
    rows where both are known."""
    pairs = [(a, b) for a in columns for b in columns if a <= b]
    sums = df.agg(*[F.struct(F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"p{k}.r").alias("r"), F.col(f"p{k}.n").alias("n")) for k, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return sums.select(F.inline(F.array(*rows)))


def halves_correlation(hist: DataFrame, by: list[str], half: int) -> DataFrame:
    """(by..., r): correlation of a dense histogram's first `half` bins with the next `half`, such as of ON and OFF
    responses; null where either is constant."""
    place = hist.filter(F.col("bin") < 2 * half).withColumns({"at": F.col("bin") % half, "off": F.col("bin") >= half})
    wide = place.groupBy(*by, "at").agg(F.sum(F.when(~F.col("off"), F.col("count"))).cast("double").alias("x"), F.sum(F.when(F.col("off"), F.col("count"))).cast("double").alias("y"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    cov, vx, vy = n * F.sum(F.col("x") * F.col("y")) - sx * sy, n * F.sum(F.col("x") * F.col("x")) - sx * sx, n * F.sum(F.col("y") * F.col("y")) - sy * sy
    return wide.groupBy(*by).agg(F.try_divide(cov, F.sqrt(vx * vy)).alias("r"))


def diagonal_offset(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., r, offset): correlation of x and y and their mean distance from the diagonal."""
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"), (F.avg(F.abs(F.col(x) - F.col(y))) / F.sqrt(F.lit(2.0))).alias("offset"))


def ranked(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """df with the average rank of a column within its group, from 1; rows without a value go. Windows run over distinct values."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(n.select(*by, column, (upto - (F.col("__n") - 1) / 2).alias(out)), [*by, column])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., r, n): rank correlation of the rows where both are known, ties at their average rank. Keys are not null."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    both = ranked(ranked(known, x, by, "__x"), y, by, "__y")
    return both.groupBy(*by).agg(F.corr("__x", "__y").alias("r"), F.count("*").alias("n"))


def shift_vectors(df: DataFrame, key: str, condition: str, vector: str, first, second) -> DataFrame:
    """(key, shift, length): from each key's vector in the first condition to that in the second; keys without both go."""
    wide = df.groupBy(key).agg(*[F.max(F.when(F.col(condition) == c, F.col(vector))).alias(n) for c, n in ((first, "a"), (second, "b"))])
    moved = wide.filter("a is not null and b is not null").select(key, F.zip_with("b", "a", lambda b, a: b - a).alias("shift"))
    return moved.withColumn("length", F.sqrt(F.aggregate("shift", F.lit(0.0), lambda s, v: s + v * v)))


def centroid_distance(df: DataFrame, condition: str, vector: str, first, second, by: list[str]) -> DataFrame:
    """(by..., distance): between the mean vectors of two conditions; null without both. Means are partial sums by component."""
    flat = df.select(*by, F.col(condition).alias("__of"), F.posexplode(vector).alias("k", "v"))
    means = flat.groupBy(*by, "k").agg(*[F.avg(F.when(F.col("__of") == c, F.col("v"))).alias(n) for c, n in ((first, "a"), (second, "b"))])
    gap = F.col("b") - F.col("a")
    return means.groupBy(*by).agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def tuning(df: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """(by..., position, phase, tuning): the mean value at each position (such as a count in a window or the height of a peak) by the
    greatest mean of its group; even positions are `on`, odd ones `off`. Null where that is 0."""
    means = df.groupBy(*by, position).agg(F.avg(value).alias("__mean"))
    top = F.max("__mean").over(Window.partitionBy(*by)) if by else F.max("__mean").over(Window.partitionBy(F.lit(0)))
    phase = F.when(F.col(position) % 2 == 0, "on").otherwise("off")
    return means.select(*by, position, phase.alias("phase"), F.try_divide(F.col("__mean"), top).alias("tuning"))
