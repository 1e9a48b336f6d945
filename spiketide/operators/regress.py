"""Regressions from sums that merge: cross-validated lasso on Gram matrices, p values of lines, bootstraps by weights.

No group's rows meet in one task; what meets is a matrix per group and fold, or a sum per group and draw.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import CELLS, _keys, gathered, spread

#: Bytes of matrices that a task holds before it sends them on.
HELD_BYTES = 64 << 20


# -- the incomplete beta function and p values


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, brought back by the recurrence."""
    up = z + 8
    series = (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, F.lit(5.0)))
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, k: s + F.ln(z + k))


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function of x in [0, 1] by its continued fraction (modified Lentz), on the side
    where it converges fast; null for null."""
    tiny = 1e-300

    def fraction(x: Column, a: Column, b: Column) -> Column:
        near = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        d0 = 1 / near(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            c, d, h = acc["c"], acc["d"], acc["h"]
            for factor in (even, odd):
                d = 1 / near(1 + factor * d)
                c = near(1 + factor / c)
                h = h * d * c
            return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

        done = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), start, step)
        front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return front * done["h"]

    inner = F.when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull(), inner)


def line(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """(by..., slope, intercept, r2, p, n): the least-squares line of each group and the two-sided p value of its slope (Student's t, n - 2
    degrees of freedom); p is null where n < 3 or x or y is constant. Rows with a null x or y do not count."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_syy(y, x).alias("__syy"))
    told = (F.col("n") > 2) & (F.col("__syy") > 0) & F.col("r2").isNotNull()
    p = incomplete_beta(1 - F.least(F.col("r2"), F.lit(1.0)), (F.col("n") - 2) / 2.0, F.lit(0.5))
    return fit.withColumn("p", F.when(told, p)).select(*by, "slope", "intercept", "r2", "p", "n")


# -- lasso


def grams(df: DataFrame, features: str, y: str, by: list[str], folds: int, key: str) -> DataFrame:
    """(by..., fold, n, sums): for each group and fold the sums of products of [1, features..., y] with itself, row by row.
    A row's fold is a hash of its key. Tasks add up what they see; rows with a null or non-finite value are left out."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold")
    rows = df.filter(F.col(features).isNotNull() & F.col(y).isNotNull()).select(*by, fold, F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            keys = pd.DataFrame(list(held), columns=[*by, "fold"]).astype(kinds)
            yield pa.RecordBatch.from_pandas(keys.assign(sums=[m.ravel() for m in held.values()]), preserve_index=False, schema=schema)

        kinds, schema = {}, None
        for batch in batches:
            pdf = batch.to_pandas()
            if schema is None:
                kinds = pdf[[*by, "fold"]].dtypes.to_dict()
                schema = pa.schema([batch.schema.field(c) for c in [*by, "fold"]] + [pa.field("sums", pa.list_(pa.float64()))])
            for group, part in pdf.groupby([*by, "fold"], sort=False, dropna=False):
                a = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(float)])
                a = a[np.isfinite(a).all(axis=1)]
                held[group] = held.get(group, 0) + a.T @ a
            if held and len(held) * next(iter(held.values())).nbytes > HELD_BYTES:
                yield from out()
                held.clear()
        if held:
            yield from out()

    partial = rows.mapInArrow(run, f"{_keys(df, by)}, fold int, sums array<double>")
    flat = partial.select(*by, "fold", F.posexplode("sums").alias("at", "v")).groupBy(*by, "fold", "at").agg(F.sum("v").alias("v"))
    return flat.groupBy(*by, "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"))


class _Centred:
    """Products of centred features and response, from sums of products of [1, features, response]."""

    def __init__(self, m: np.ndarray):
        self.n = m[0, 0]
        mean = m[0] / self.n
        c = m / self.n - np.outer(mean, mean)
        self.xx, self.xy, self.yy, self.mx, self.my = c[1:-1, 1:-1], c[1:-1, -1], max(c[-1, -1], 0.0), mean[1:-1], mean[-1]


def descend(s: _Centred, penalty: float, beta: np.ndarray, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Coordinate descent for the lasso on means of products, from beta on; it ends when no coefficient moves the prediction by more than
    `tolerance` of the response's spread. Only coefficients that move cost more than a comparison."""
    beta = beta.copy()
    left, scale = s.xy - s.xx @ beta, np.diag(s.xx)
    used, sizes = np.flatnonzero(scale > 1e-12 * max(scale.max(initial=0.0), 1e-300)).tolist(), scale.tolist()
    least = tolerance * math.sqrt(s.yy or 1.0)
    for _ in range(rounds):
        moved = 0.0
        for k in used:
            rho = left[k] + sizes[k] * beta[k]
            new = (rho - penalty if rho > penalty else rho + penalty if rho < -penalty else 0.0) / sizes[k]
            step = new - beta[k]
            if step:
                left -= s.xx[k] * step
                beta[k] = new
                moved = max(moved, abs(step) * math.sqrt(sizes[k]))
        if moved <= least:
            break
    return beta


def _error(m: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Mean squared error of a model on the rows whose sums of products are m."""
    v = np.concatenate([[-intercept], -beta, [1.0]])
    return float(v @ m @ v / m[0, 0])


def lasso_cv(df: DataFrame, features: str, y: str, by: list[str], key: str, folds: int = 5, penalties: int = 50, least: float = 1e-3) -> DataFrame:
    """(by..., n, penalty, coefficients, intercept, r2, linear, linear_r2): the lasso whose penalty has the least mean error over
    `folds` folds, and the plain least-squares fit beside it.

    Penalties fall evenly in the logarithm from the least that leaves no coefficient to `least` times that; of equally good
    ones the greatest counts. Folds are hashes of `key`, empty ones are skipped; with under two the greatest penalty is taken. Constant
    features get 0. r2 is null where y is constant. A group's matrices of each fold meet in one task.
    """
    names = ["n", "penalty", "coefficients", "intercept", "r2", "linear", "linear_r2"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(round(math.sqrt(len(pdf["sums"].iloc[0]))))
        parts = [m for m in (np.asarray(s, float).reshape(width, width) for s in pdf.sort_values("fold")["sums"]) if m[0, 0] > 0]
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*by, *names]})
        every = sum(parts)
        whole = _Centred(every)
        top = float(np.abs(whole.xy).max(initial=0.0))
        grid = top * np.logspace(0, math.log10(least), penalties) if top > 0 else np.zeros(1)
        errors = np.zeros(len(grid))
        for part in parts if len(parts) > 1 else []:
            s = _Centred(every - part)
            beta = np.zeros(len(s.xy))
            for j, penalty in enumerate(grid):
                beta = descend(s, penalty, beta)
                errors[j] += _error(part, s.my - s.mx @ beta, beta)
        penalty = float(grid[int(np.argmin(errors))])
        beta = descend(whole, penalty, np.zeros(len(whole.xy)))
        plain = np.linalg.lstsq(whole.xx, whole.xy, rcond=None)[0]
        share = lambda b: 1 - float(whole.yy - 2 * b @ whole.xy + b @ whole.xx @ b) / whole.yy if whole.yy > 0 else None
        found = [int(every[0, 0]), penalty, beta.tolist(), float(whole.my - whole.mx @ beta), share(beta), plain.tolist(), share(plain)]
        return pdf[by].head(1).assign(**{c: [v] for c, v in zip(names, found, strict=True)}).astype({"r2": float, "linear_r2": float})

    kinds = f"{_keys(df, by)}, n long, penalty double, coefficients array<double>, intercept double, r2 double, linear array<double>, linear_r2 double"
    return spread(grams(df, features, y, by, folds, key), by).groupBy(*by).applyInPandas(run, kinds)


# -- bootstrap

#: The distribution function of a Poisson variable of mean 1 at 0 to 12; beyond, the next hash values do not reach.
POISSON = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(13))


#: Rows of a group that one task draws from, about; larger groups are dealt out, and the sums of their parts added.
PART_ROWS = 1 << 14


def bootstrap(df: DataFrame, value: str, by: list[str], key: list[str], draws: int = 1000, mass: float = 0.95, seed: int = 1) -> DataFrame:
    """(by..., low, high): percentiles over the draws of the mean of a resampled group.

    In every draw a row counts as often as a Poisson variable of mean 1 says, which a hash of seed, key and draw decides: reruns agree
    however rows are placed. Rows travel once, by group and part of a group, and a part sends on a sum and a count per draw, so
    a group of any size is spread over tasks. Rows of a null value are left out; draws that chose no row of a group do not count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("key"))
    large = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > PART_ROWS).select(*[F.col(k).alias(f"__{k}") for k in by], F.ceil(F.col("__n") / PART_ROWS).alias("__m"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    parts = rows.join(large, same, "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("__m", F.lit(1))))
    bounds = np.array([int(p * 2**32) for p in POISSON], np.int64)
    blocks = [f":{k}".encode() for k in range((draws + 3) // 4)]  # one MD5 serves four draws, eight digits each

    def weights(keys: list[str]) -> np.ndarray:
        started = [hashlib.md5(f"{seed}:{k}".encode(), usedforsecurity=False) for k in keys]
        found = bytearray()
        for start in started:
            for block in blocks:
                digest = start.copy()
                digest.update(block)
                found += digest.digest()
        return bounds.searchsorted(np.frombuffer(found, ">u4").astype(np.int64), side="right").reshape(len(keys), -1)[:, :draws]

    def draw(batches):
        for batch in batches:
            lists = batch.column(len(by))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            points = lists.flatten()
            keys, v = points.field("key"), points.field("v").to_numpy(zero_copy_only=False).astype(float)
            n, s = np.zeros((len(batch), draws), np.int64), np.zeros((len(batch), draws), np.longdouble)  # the order of rows hardly shows
            group, step = np.repeat(np.arange(len(batch)), sizes), max(1, CELLS // draws)
            for k in range(0, len(v), step):
                w, own = weights(keys[k : k + step].to_pylist()), group[k : k + step]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                n[own[first]] += np.add.reduceat(w, first, axis=0)
                s[own[first]] += np.add.reduceat(w * v[k : k + step, None].astype(np.longdouble), first, axis=0)
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * draws), pa.array(a.ravel())) for a in (n, s.astype(float))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *arrays], [*by, "n", "s"])

    def limits(batches):
        for batch in batches:
            lists, found = batch.column(len(by)), np.full((2, len(batch)), np.nan)
            ends = lists.offsets.to_numpy()
            points = lists.values
            n, s = (points.field(c).flatten().to_numpy().reshape(-1, draws) for c in ("n", "s"))
            for g, (a, b) in enumerate(zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
                count, total = n[a:b].sum(axis=0), s[a:b].sum(axis=0)
                means = np.sort(total[count > 0] / count[count > 0])
                for k, q in enumerate(((1 - mass) / 2, (1 + mass) / 2)) if len(means) else ():
                    at = (len(means) - 1) * q
                    low, high = math.floor(at), math.ceil(at)
                    found[k, g] = means[low] + (means[high] - means[low]) * (at - low)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *(pa.array(c, mask=np.isnan(c)) for c in found)], [*by, "low", "high"])

    kinds = _keys(df, by)
    dealt = gathered(parts, [*by, "part"], key=F.col("key"), v=F.col("v")).select(*by, "points")
    sums = dealt.mapInArrow(draw, f"{kinds}, n array<long>, s array<double>")
    return gathered(sums, by, n=F.col("n"), s=F.col("s")).mapInArrow(limits, f"{kinds}, low double, high double")
