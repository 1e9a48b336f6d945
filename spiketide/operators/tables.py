"""Counts, joins and reshaping on keyed tables."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of the right table where it has one; nulls never overwrite and no row is added. Of several right rows of
    a key the one with the greatest values counts."""
    new = right.groupBy(*keys).agg(*[F.max(c).alias(f"{c}__new") for c in columns])
    joined = left.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"{c}__new"), F.col(c)) for c in columns}).drop(*[f"{c}__new" for c in columns])


def align_concat(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join on the keys, keys coalesced."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


def sum_spikes(df: DataFrame, time: str, onsets: list[float], window: float, by: list[str]) -> DataFrame:
    """Wide counts c0, c1, ... in the open windows (onset, onset + window); groups without a hit are absent."""
    hit = [(F.col(time) > s) & (F.col(time) < s + window) for s in onsets]
    wide = df.filter(reduce(lambda a, b: a | b, hit)).groupBy(*by)
    return wide.agg(*[F.count(F.when(h, 1)).alias(f"c{i}") for i, h in enumerate(hit)])


def intervals_between(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """isi: positive gaps between successive spikes of a group."""
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumn("isi", F.col(time) - F.lag(time).over(w)).filter("isi > 0")


def robust_sigma(column: str) -> Column:
    """Interquartile range by 1.349."""
    return (F.percentile(column, F.lit(0.75)) - F.percentile(column, F.lit(0.25))) / 1.349


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def filled(column: str, order: Window) -> Column:
    """The last value seen, or else the next."""
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(column, True).over(back), F.first(column, True).over(ahead))


def linear_index(df: DataFrame, columns: list[str], out: str = "idx") -> DataFrame:
    """Row-major index over the product of two columns' sorted values. Values of the columns are few: they are
    numbered in a table of their own, which is joined back."""
    first, second = columns
    numbered = lambda c: df.select(c).distinct().withColumn(f"{c}__n", F.row_number().over(Window.orderBy(c)) - 1)
    size = df.agg(F.countDistinct(second).alias("size"))
    joined = df.join(numbered(first), first).join(numbered(second), second).join(F.broadcast(size))
    return joined.withColumn(out, (F.col(f"{first}__n") * F.col("size") + F.col(f"{second}__n")).cast("long")).drop("size", f"{first}__n", f"{second}__n")


def rescaled(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Columns minmax and z of a column, over each group or the whole; null where all values are equal."""
    stats = [F.min(column).alias("lo__"), F.max(column).alias("hi__"), F.avg(column).alias("mean__"), F.stddev_pop(column).alias("sd__")]
    joined = df.join(df.groupBy(*by).agg(*stats), by) if by else df.join(F.broadcast(df.agg(*stats)))
    c = F.col(column)
    return joined.withColumns({"minmax": F.try_divide(c - F.col("lo__"), F.col("hi__") - F.col("lo__")), "z": F.try_divide(c - F.col("mean__"), F.col("sd__"))}).drop("lo__", "hi__", "mean__", "sd__")


#: Stretches of time into which as-of joins cut the range of both sides.
STRETCHES = 256


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, columns: list[str]) -> DataFrame:
    """Each left row with `columns` of the last right row of its group at or before its time; null before the first. Of
    right rows of one group and time the one with the greatest values counts; left rows without a time match none.

    Both sides are sorted together within a group and a stretch of time, right rows ahead at equal times, and the last
    right row is carried on. What came before a stretch is the last row of an earlier one: those are aggregated, a row per group
    and stretch, so a group of any size is spread over tasks.
    """
    once = right.filter(F.col(time).isNotNull()).groupBy(*by, time).agg(F.max(F.struct(*columns)).alias("__right"))
    kind = once.schema["__right"].dataType
    range_of = once.agg(F.min(time).cast("double").alias("__low"), F.max(time).cast("double").alias("__high"))
    stretch = F.floor((F.col(time).cast("double") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * STRETCHES)
    place = lambda df: df.join(F.broadcast(range_of)).withColumn("__stretch", F.coalesce(F.greatest(F.lit(-1).cast("long"), F.least(stretch, F.lit(STRETCHES).cast("long"))), F.lit(0).cast("long"))).drop("__low", "__high")
    known = place(once)
    lasts = known.groupBy(*by, "__stretch").agg(F.max_by("__right", time).alias("__right"))
    steps = lasts.unionByName(place(left).select(*by, "__stretch").distinct().withColumn("__right", F.lit(None).cast(kind)))
    carried = steps.groupBy(*by, "__stretch").agg(F.first("__right", True).alias("__right"))
    ahead = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = carried.select(*by, "__stretch", F.last("__right", True).over(ahead).alias("__right")).filter(F.col("__right").isNotNull())
    none = F.lit(None).cast(kind)
    both = place(left).withColumns({"__right": none, "__side": F.lit(2)})
    both = both.unionByName(known.withColumn("__side", F.lit(1)), allowMissingColumns=True).unionByName(before.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "__stretch").orderBy(F.expr("__side > 0"), time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(F.col(time).isNotNull(), F.last("__right", True).over(w))
    return both.withColumn("__last", last).filter("__side = 2").select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in columns])


def interpolated(samples: DataFrame, grid: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., x, y): linear interpolation of each group's samples (by..., x, y) at the grid's places (by..., x); null
    outside them. Samples of one place count with their mean."""
    known = samples.groupBy(*by, x).agg(F.avg(y).alias("y")).select(*by, F.col(x).cast("double").alias("x"), "y", F.lit(False).alias("ask"))
    both = known.unionByName(grid.select(*by, F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("ask")))
    point = F.when(~F.col("ask"), F.struct("x", "y"))
    w = Window.partitionBy(*by).orderBy("x", "ask")
    sides = both.withColumns({"a": F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("ask")
    inner = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    return sides.select(*by, F.col("x").alias(x), F.when(F.col("a.x") == F.col("x"), F.col("a.y")).otherwise(inner).alias(y))


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a folder of our own only where that is
    unset on a local master."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spiketide-"))


def stored(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def group_numbers(df: DataFrame, keys: list[str], out: str = "group") -> DataFrame:
    """Rows with the place of their keys among the sorted distinct keys, from 0. The distinct keys are dealt to ranges and
    stored with the number of their range, so sizes and places come from one execution; of each range only the size goes to
    the driver."""
    spark = df.sparkSession
    placed = stored(df.select(*keys).distinct().repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    starts = spark.createDataFrame([(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes] or [(0, 0)], "__part int, __start long")
    w = Window.partitionBy("__part").orderBy(*keys)
    numbered = placed.withColumn("__k", F.row_number().over(w) - 1).join(F.broadcast(starts), "__part")
    numbered = numbered.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__start") + F.col("__k")).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(numbered, same).drop(*[f"__{k}" for k in keys])


def sampled(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """About a share of the rows, chosen by the hash of their key: the same rows on every run and at any partitioning."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(part < int(share * 2**32))


def replaced(df: DataFrame, column: str, values: dict) -> DataFrame:
    """The column with some values replaced by others; the rest stay."""
    c = F.col(column)
    return df.withColumn(column, reduce(lambda acc, kv: F.when(c == F.lit(kv[0]), F.lit(kv[1])).otherwise(acc), values.items(), c))


def bin_width(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., width): the least positive gap between sorted values of a group."""
    return intervals_between(df.select(*by, column).distinct(), column, by).groupBy(*by).agg(F.min("isi").alias("width"))


def left_filled(left: DataFrame, right: DataFrame, keys: list[str], fill) -> DataFrame:
    """Left outer join; columns of the right table are `fill` where it has no row."""
    added = [c for c in right.columns if c not in keys]
    return left.join(right, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in added})


def summarised(df: DataFrame, by: list[str], measures: dict) -> DataFrame:
    """(by..., names...): name -> (aggregate, column), the aggregate any function from a column to an aggregate of it."""
    return df.groupBy(*by).agg(*[how(F.col(column)).alias(name) for name, (how, column) in measures.items()])
