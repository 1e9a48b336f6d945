"""Per-group fits and simulations in NumPy, and models of pyspark.ml. A group's points meet in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """df dealt by the keys over all shuffle partitions: fits cost more than the bytes of their groups show, so a small
    table is not put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def seeds_of(groups: list[tuple]) -> list[int]:
    """A seed from each group's keys, the same on every run."""
    return (pd.util.hash_array(np.array([repr(g) for g in groups], dtype=object), categorize=False) % 2**32).tolist()


def seed_of(*values) -> int:
    """A seed from one group's keys."""
    return seeds_of([values])[0]


#: Numbers that a step over many groups holds at once, and bytes of an Arrow batch of groups.
CELLS, BATCH_BYTES = 1 << 19, 32 << 20


def gathered(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """(by..., points): the columns of each group's rows as an array of structs. Batches of groups are bounded by bytes, so
    mapInArrow() sees many small groups at a time, or a few large ones."""
    spark = df.sparkSession
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = df.select(*by, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("points"))
    return spread(rows, by).groupBy(*by).agg(F.collect_list("points").alias("points"))


def points_of(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(group of each point, columns of doubles) of a batch of gathered(); points with a missing or non-finite number, NaN or null, are dropped."""
    lists = batch.column(batch.schema.get_field_index("points"))
    points = lists.flatten()
    group = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(int))
    columns = [points.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
    known = np.logical_and.reduce([np.isfinite(c) for c in columns])
    return group[known], [c[known] for c in columns]


def blocks(group: np.ndarray, cost) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of groups of equal size for points in order of their group: (groups, places of their points, a row for each).
    cost(n): the numbers that a group of n points needs; a block needs at most CELLS, or is one group."""
    groups, starts, sizes = np.unique(group, return_index=True, return_counts=True)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, CELLS // max(1, cost(int(n))))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield groups[part], starts[part][:, None] + np.arange(n)


def relationship(df: DataFrame, x: str, y: str, weight: str, by: list[str], trials: int = 50) -> DataFrame:
    """(by..., kind, slope, intercept, r2): a line or a logarithm through each group by seeded RANSAC, whichever explains
    more; `steady` if neither explains a tenth; `insufficient_data` under three points, without weight, or without x > 0.
    Groups of equal size are worked on together; each draws from its own seed, so they don't depend on each other. Points that
    are not finite are left out."""

    def ransac(t, v, w, picks):
        near = np.median(np.abs(v - np.median(v, axis=1)[:, None]), axis=1) + 1e-12
        i, j = picks[..., 0], picks[..., 1]
        at = lambda a, k: np.take_along_axis(a, k, axis=1)
        ti, vi = at(t, i), at(v, i)
        run = at(t, j) - ti
        a = (at(v, j) - vi) / np.where(run == 0, 1.0, run)
        inside = lambda k: np.abs(v[:, None] - (vi[:, k, None] + a[:, k, None] * (t[:, None] - ti[:, k, None]))) <= near[:, None, None]
        step = max(1, CELLS // t.size)
        counts = np.concatenate([inside(slice(k, k + step)).sum(axis=2) for k in range(0, trials, step)], axis=1)
        counts[run == 0] = -1
        best = counts.argmax(axis=1)[:, None]
        keep = np.abs(v - (at(vi, best) + at(a, best) * (t - at(ti, best)))) <= near[:, None]
        keep |= at(counts, best) < 2
        u = np.where(keep, w + 1e-12, 0.0)
        total = u.sum(axis=1)
        mt, mv = (u * t).sum(axis=1) / total, (u * v).sum(axis=1) / total
        ct = np.where(keep, t - mt[:, None], 0.0)
        flat = np.where(keep, t, -np.inf).max(axis=1) == np.where(keep, t, np.inf).min(axis=1)
        slope = np.where(flat, 0.0, (u * ct * (v - mv[:, None])).sum(axis=1) / np.where(flat, 1.0, (u * ct * ct).sum(axis=1)))
        start = np.where(flat, v.mean(axis=1), mv - slope * mt)
        mean = (w * v).sum(axis=1) / w.sum(axis=1)
        spread_ = (w * (v - mean[:, None]) ** 2).sum(axis=1)
        left = (w * (v - slope[:, None] * t - start[:, None]) ** 2).sum(axis=1)
        return slope, start, np.where(spread_ > 0, 1 - left / np.where(spread_ > 0, spread_, 1.0), 0.0), mean

    def run(batches):
        for batch in batches:
            group, (t, v, w) = points_of(batch, ["x", "y", "w"])
            keep = t > 0
            order = np.lexsort((w[keep], v[keep], t[keep], group[keep]))
            group, t, v, w = (c[keep][order] for c in (group, t, v, w))
            keys = batch.select(by).to_pylist()
            kinds = np.full(len(batch), "insufficient_data", object)
            found = np.full((3, len(batch)), np.nan)
            for own, at in blocks(group, lambda n: 200 + trials * n):
                own, at = (c[w[at].sum(axis=1) > 0] for c in (own, at))
                if at.shape[1] < 3 or not len(own):
                    continue
                seeds = seeds_of([tuple(keys[g].values()) for g in own])
                share = w[at] / w[at].sum(axis=1)[:, None]
                ends = share.cumsum(axis=1)
                ends /= ends[:, -1:]
                picks = np.stack([e.searchsorted(np.random.default_rng(s).random((2, trials, 2)), side="right") for e, s in zip(ends, seeds, strict=True)])
                line, log = ransac(t[at], v[at], w[at], picks[:, 0]), ransac(np.log(t[at]), v[at], w[at], picks[:, 1])
                steady = (np.abs(line[2]) < 0.1) & (np.abs(log[2]) < 0.1)
                linear = line[2] > log[2]
                kinds[own] = np.where(steady, "steady", np.where(linear, "linear", "logarithmic"))
                for k, still in enumerate((0.0, line[3], 1.0)):
                    found[k, own] = np.where(steady, still, np.where(linear, line[k], log[k]))
            out = [pa.array(kinds, pa.string()), *(pa.array(c, mask=np.isnan(c)) for c in found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *out], [*by, "kind", "slope", "intercept", "r2"])

    double = lambda c: F.col(c).cast("double")
    return gathered(df, by, x=double(x), y=double(y), w=double(weight)).mapInArrow(run, f"{_keys(df, by)}, kind string, slope double, intercept double, r2 double")


def poisson_trains(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by..., t): simulated spikes of the segments (start, end, rate) of each group, seeded by its keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed_of(*pdf[by].iloc[0].tolist()))
        times: list[float] = []
        for s, e, r in pdf.sort_values("start")[["start", "end", "rate"]].to_numpy(float):
            times += np.sort(rng.uniform(s, e, rng.poisson(max(0.0, (e - s) * r)))).tolist()
        return pdf[by].iloc[[0] * len(times)].reset_index(drop=True).assign(t=np.array(times, float))

    return segments.groupBy(*by).applyInPandas(run, f"{_keys(segments, by)}, t double")


def warped(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """Dynamic time warping distance within a band of the diagonal."""
    band = max(band, abs(len(a) - len(b)))
    row = np.full(len(b) + 1, np.inf)
    row[0] = 0
    for i, x in enumerate(a, 1):
        new = np.full(len(b) + 1, np.inf)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            new[j] = (x - b[j - 1]) ** 2 + min(row[j], new[j - 1], row[j - 1])
        row = new
    return float(np.sqrt(row[-1]))


def template_distance(vectors: DataFrame, key: str, vector: str, template: list[float], band: int = 4) -> DataFrame:
    """(key, distance): warped distance of each vector from one template."""
    shape = np.array(template, float)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        return v.map(lambda x: warped(np.asarray(x, float), shape, band))

    return vectors.select(key, distance(vector).alias("distance"))


def standardised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, scaled): each component less its mean, by its standard deviation (of a sample); 0 where that is 0."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(rows).transform(rows)
    return scaled.select(key, vector_to_array("x").alias("scaled"))


def distances_from(vectors: DataFrame, key: str, vector: str, one: DataFrame) -> DataFrame:
    """(key, euclidean, cosine): distances of every vector from that of `one`, a table of a single row; cosine distance is null for a
    vector of zeros. Nothing but that row moves."""
    target = one.select(F.col(vector).cast("array<double>").alias("__t")).limit(1)
    met = vectors.select(key, F.col(vector).cast("array<double>").alias("__v")).join(F.broadcast(target))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    euclid = F.sqrt(total(F.zip_with("__v", "__t", lambda x, y: (x - y) * (x - y))))
    return met.select(key, euclid.alias("euclidean"), (1 - F.try_divide(dot("__v", "__t"), F.sqrt(dot("__v", "__v")) * F.sqrt(dot("__t", "__t")))).alias("cosine"))


def components(vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, scores): principal components of standardised vectors."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(rows).transform(rows)
    return PCA(k=k, inputCol="x", outputCol="pc").fit(scaled).transform(scaled).select(key, vector_to_array("pc").alias("scores"))


def group_components(vectors: DataFrame, key: str, views: list[str], each: int, k: int) -> DataFrame:
    """Principal components of each view, side by side, and of these again."""
    joined = None
    for n, view in enumerate(views):
        part = components(vectors, key, view, each).withColumnRenamed("scores", f"v{n}")
        joined = part if joined is None else joined.join(part, key)
    wide = joined.select(key, F.concat(*[F.col(f"v{n}") for n in range(len(views))]).alias("v"))
    return components(wide, key, "v", k)


def clusters(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def mixture_bic(vectors: DataFrame, vector: str, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, bic) of Gaussian mixtures over whole vectors; the fits are independent models over the same table."""
    rows = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n, dims = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    free = lambda k: k - 1 + k * dims + k * dims * (dims + 1) // 2
    found = [(k, float(free(k) * np.log(n) - 2 * GaussianMixture(k=k, seed=seed).fit(rows).summary.logLikelihood)) for k in ks]
    return vectors.sparkSession.createDataFrame(found, "k int, bic double")
