"""Signals of binned responses: correlation with triggers, sine fits, spectra of overlapping segments."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import _keys


def trigger_correlation(hist: DataFrame, onsets: DataFrame, keys: list[str], cell: list[str], lags: list[int]) -> DataFrame:
    """(cell..., lag, product): sums over bins of triggers(bin + lag) * count(bin), for the lags given that have any.

    onsets (keys..., bin, n) counts the triggers in each bin; cell holds the keys and more. Each trigger is copied to the bin that lies a lag before it and meets
    the cells' counts there: the work grows with triggers and lags, not with pairs of bins. Bins of no count are left out beforehand.
    """
    lag = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in lags])).alias("lag")
    ahead = onsets.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).select(*keys, F.col("bin").alias("__at"), "n", lag)
    ahead = ahead.select(*keys, (F.col("__at") - F.col("lag")).alias("bin"), "n", "lag")
    return hist.filter("count > 0").select(*cell, "bin", "count").join(ahead, [*keys, "bin"]).groupBy(*cell, "lag").agg(F.sum(F.col("count") * F.col("n")).alias("product"))


def on_off_index(hist: DataFrame, onsets: DataFrame, keys: list[str], cell: list[str], interval: int) -> DataFrame:
    """(cell..., on, off, index): a cell's correlation with its stimulus's triggers, greatest among the first interval // 2
    lags and among the interval // 2 + 1 lags from interval - 1 on, and (off - on) / (off + on), null where either is 0.

    interval: bins from an ON trigger to the next OFF. Cells of the histogram that never meet a trigger have zeros.
    """
    first, second = range(interval // 2), range(interval - 1, interval + interval // 2)
    found = trigger_correlation(hist, onsets, keys, cell, sorted({*first, *second}))
    best = lambda lags: F.max(F.when(F.col("lag").between(lags.start, lags.stop - 1), F.col("product")))
    tops = found.groupBy(*cell).agg(best(first).alias("on"), best(second).alias("off"))
    every = hist.select(*cell).distinct().join(tops, cell, "left").withColumns({"on": F.coalesce("on", F.lit(0)), "off": F.coalesce("off", F.lit(0))})
    index = F.when((F.col("on") != 0) & (F.col("off") != 0), (F.col("off") - F.col("on")) / (F.col("off") + F.col("on")))
    return every.select(*cell, "on", "off", index.alias("index"))


def _harmonic(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., hertz, fit) from (by..., x, y, hertz): the least-squares sine of that frequency, from ten sums."""
    turn = 2 * math.pi * F.col("hertz") * F.col("x")
    parts = points.select(*by, "hertz", "y", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    sums = parts.groupBy(*by, "hertz").agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in "ycs"],
        *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("yy", "cc", "ss", "cs", "yc", "ys")],
    )
    co = lambda a, b: F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}")
    det = co("c", "c") * co("s", "s") - co("c", "s") * co("c", "s")
    solved = sums.withColumns({
        "a": F.try_divide(co("y", "c") * co("s", "s") - co("y", "s") * co("c", "s"), F.when(det > 1e-12, det)),
        "b": F.try_divide(co("y", "s") * co("c", "c") - co("y", "c") * co("c", "s"), F.when(det > 1e-12, det)),
    })
    error = (co("y", "y") - F.col("a") * co("y", "c") - F.col("b") * co("y", "s")) * F.col("n")
    fit = F.struct(F.greatest(error, F.lit(0.0)).alias("sse"), "hertz", "a", "b", (F.col("my") - F.col("a") * F.col("mc") - F.col("b") * F.col("ms")).alias("offset"))
    return solved.filter("a is not null").select(*by, fit.alias("fit"))


def sine_fit(df: DataFrame, x: str, y: str, by: list[str], hertz: list[float], rounds: int = 3, steps: int = 9) -> DataFrame:
    """(by..., hertz, amplitude, phase, offset, sse): the sine amplitude * sin(2 pi hertz x + phase) + offset of least
    squared error, its frequency the best of the given ones (evenly spaced, rising), refined `rounds` times.

    For a fixed frequency the fit is linear, so points are summed up by group and frequency before they are shuffled. Each round
    tries `steps` frequencies between the neighbours of the best. Null x or y are left out; groups that no frequency fits (fewer than three different points) have no row. phase is in [-pi, pi].
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    best = lambda fits: fits.groupBy(*by).agg(F.min("fit").alias("fit"))
    found = best(_harmonic(points.withColumn("hertz", F.explode(F.array(*map(F.lit, map(float, hertz))))), by))
    width = (hertz[1] - hertz[0]) if len(hertz) > 1 else hertz[0] / 2
    for _ in range(rounds):
        step = 2 * width / (steps - 1)
        near = F.array(*[F.col("fit.hertz") - width + k * step for k in range(steps)])
        tried = points.join(found.select(*by, F.explode(F.filter(near, lambda h: h > 0)).alias("hertz")), by)
        found, width = best(_harmonic(tried, by)), step
    a, b = F.col("fit.a"), F.col("fit.b")
    return found.select(*by, F.col("fit.hertz").alias("hertz"), F.sqrt(a * a + b * b).alias("amplitude"), F.atan2(a, b).alias("phase"), F.col("fit.offset").alias("offset"), F.col("fit.sse").alias("sse"))


def _covering(i: Column, size: int, step: int) -> Column:
    """Numbers of the segments [k step, k step + size) that hold sample i."""
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / step))
    return F.explode(F.sequence(low.cast("long"), F.floor(i / step).cast("long")))


def welch(hist: DataFrame, by: list[str], fs: float, size: int, value: str = "count") -> DataFrame:
    """(by..., k, hertz, power): averaged periodograms of half-overlapping segments of `size` bins, Hann window, mean removed, density per Hz,
    one side only.

    hist (by..., bin, value) is dense from bin 0 on; missing bins count as 0 within a segment, segments that reach
    beyond the last bin are left out. Each bin is sent to the segments that hold it, so a segment meets in a task, not a signal.
    """
    step = size // 2
    length = F.max("bin").over(Window.partitionBy(*by)) + 1
    cut = hist.select(*by, F.col("bin").cast("long").alias("bin"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).withColumn("length", length)
    dealt = cut.select("*", _covering(F.col("bin"), size, step).alias("segment")).filter(F.col("segment") * step + size <= F.col("length"))
    segments = dealt.groupBy(*by, "segment").agg(F.collect_list(F.struct((F.col("bin") - F.col("segment") * step).cast("int").alias("at"), "v")).alias("s"))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    scale = fs * (window**2).sum()
    schema = hist.select(*by).schema

    def run(batches):
        for batch in batches:
            s = batch.column(batch.num_columns - 1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(s.offsets.to_numpy()))
            flat = s.flatten()
            m = np.zeros((batch.num_rows, size))
            m[row, flat.field("at").to_numpy()] = flat.field("v").to_numpy()
            power = np.abs(np.fft.rfft((m - m.mean(axis=1, keepdims=True)) * window)) ** 2 / scale
            power[:, 1 : None if size % 2 else -1] *= 2
            lists = pa.FixedSizeListArray.from_arrays(pa.array(power.ravel()), power.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(by))], lists], [*by, "power"])

    powers = segments.select(*by, "s").mapInArrow(run, f"{_keys(hist, by)}, power array<double>" if schema.fields else "power array<double>")
    flat = powers.select(*by, F.posexplode("power").alias("k", "p")).groupBy(*by, F.col("k").cast("long").alias("k")).agg(F.avg("p").alias("power"))
    return flat.select(*by, "k", (F.col("k") * (fs / size)).alias("hertz"), "power")
