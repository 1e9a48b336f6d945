"""Piecewise lines through the points of a group: optimal knots by dynamic programming over prefix sums.

A group's points (bins of a histogram, not events) meet in one task, in memory proportional to their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import CELLS, _keys, blocks, gathered, points_of


#: Scores that differ by less than this share are equal.
EQUAL = 1e-10


class _Sums:
    """Prefix sums of centred points: the squared error of the line through any run of them in constant time."""

    def __init__(self, t: np.ndarray, v: np.ndarray):
        t, v = t - t.mean(), v - v.mean()
        self.sums = np.concatenate([np.zeros((5, 1)), np.cumsum([t, v, t * t, t * v, v * v], axis=1)], axis=1)

    def error(self, i, j):
        """Of the points i to j - 1; i and j are arrays that go together."""
        n = np.maximum(j - i, 1).astype(float)
        t, v, tt, tv, vv = self.sums[:, j] - self.sums[:, i]
        stt, stv, svv = tt - t * t / n, tv - t * v / n, vv - v * v / n
        flat = stt <= 1e-12 * np.maximum(np.abs(tt), 1e-300)
        return np.maximum(svv - np.where(flat, 0.0, stv * stv / np.where(flat, 1.0, stt)), 0.0)


def knots(t: np.ndarray, v: np.ndarray, most: int, least: int = 2) -> list[list[int]]:
    """For 1 to `most` segments, the first points of the second and later segments with which lines through each segment
    of its own have the least squared error in all; segments have `least` points or more. Of equal cuts the earliest counts.
    Fewer lists come out if there are too few points. Errors are looked at in blocks of ends, so memory grows with the points only."""
    sums, n = _Sums(t, v), len(t)
    if n < least:
        return []
    starts, width = np.arange(n + 1), max(1, CELLS // (n + 1))

    def block(first: int) -> np.ndarray:
        i, j = np.meshgrid(starts, np.arange(first, min(n + 1, first + width)), indexing="ij")
        return np.where(j - i >= least, sums.error(np.minimum(i, j), j), np.inf)

    whole = block(0) if width > n else None  # a small table is kept
    errors = lambda first: block(first) if whole is None else whole
    cost = np.concatenate([errors(first)[0] for first in range(0, n + 1, width)])
    back, found = [], [[]]
    for _ in range(1, most):
        new, at = [], []
        for first in range(0, n + 1, width):
            upto = cost[:, None] + errors(first)
            at.append(upto.argmin(axis=0))
            new.append(upto.min(axis=0))
        cost = np.concatenate(new)
        back.append(np.concatenate(at))
        if not np.isfinite(cost[n]):
            break
        cuts, j = [], n
        for table in reversed(back):
            j = int(table[j])
            cuts.append(j)
        found.append(cuts[::-1])
    return found


def meetings(t: np.ndarray, v: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Where the lines on both sides of each cut meet, kept between the last point before the cut and the first after it."""
    ends = [0, *cuts, len(t)]
    lines = []
    for a, b in zip(ends, ends[1:], strict=False):
        x, y = t[a:b] - t[0], v[a:b]
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        lines.append((slope, y.mean() - slope * x.mean()))
    out = []
    for k, i in enumerate(cuts):
        (m, b), (n, c) = lines[k], lines[k + 1]
        out.append(min(max(t[0] + (c - b) / (m - n), t[i - 1]), t[i]) if m != n else t[i])
    return np.array(out)


def continuous(t: np.ndarray, v: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, squared error) of the joined lines with knots at `inner` by least squares."""
    base = np.stack([np.ones_like(t), t - t[0], *(np.maximum(0, t - k) for k in inner)], axis=1)
    beta, *_ = np.linalg.lstsq(base, v, rcond=None)
    return np.cumsum(beta[1:]), float(((v - base @ beta) ** 2).sum())


def batch_cuts(t: np.ndarray, v: np.ndarray, most: int, least: int = 2) -> list[np.ndarray]:
    """knots() of many groups of equally many points, a row each: for 1 to `most` segments the cuts, a row to a group."""
    many, n = t.shape
    if n < least:
        return []
    t, v = t - t.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
    sums = np.zeros((5, many, n + 1))
    np.cumsum([t, v, t * t, t * v, v * v], axis=2, out=sums[:, :, 1:])
    length = np.arange(n + 1)[:, None] - np.arange(n + 1)[None, :]  # of the points i to j - 1 at [j, i]
    size = np.maximum(length, 1).astype(float)
    t, v, tt, tv, vv = (s[:, :, None] - s[:, None, :] for s in sums)
    stt, stv, svv = tt - t * t / size, tv - t * v / size, vv - v * v / size
    flat = stt <= 1e-12 * np.maximum(np.abs(tt), 1e-300)
    errors = np.where(length >= least, np.maximum(svv - np.where(flat, 0.0, stv * stv / np.where(flat, 1.0, stt)), 0.0), np.inf)
    cost, back, found = errors[:, :, 0], [], [np.zeros((many, 0), int)]
    for k in range(2, min(most, n // least) + 1):
        upto = cost[:, None, :] + errors
        at = upto.argmin(axis=2)
        cost = np.take_along_axis(upto, at[:, :, None], axis=2)[:, :, 0]
        back.append(at)
        cuts, j = np.empty((many, k - 1), int), np.full(many, n)
        for place, table in zip(range(k - 2, -1, -1), reversed(back), strict=True):
            j = cuts[:, place] = table[np.arange(many), j]
        found.append(cuts)
    return found


def joined(t: np.ndarray, v: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(breaks, slopes, squared errors), a row to a group: joined lines whose knots are where the lines on both sides of each cut meet,
    by least squares.

    What meetings() and continuous() do for one group. Points of a segment lie between its knots, so each has two hat functions
    and the normal equations are tridiagonal; two points or more to a segment make them regular.
    """
    (many, n), k = t.shape, cuts.shape[1] + 1
    rows = np.arange(many)[:, None]
    first = np.concatenate([np.zeros((many, 1), int), cuts], axis=1)
    count = np.diff(first, axis=1, append=n)
    starts = (first + rows * n).ravel()
    total = lambda a: np.add.reduceat(a.ravel(), starts).reshape(many, k)
    wide = lambda a: np.repeat(a.ravel(), count.ravel()).reshape(many, n)
    x, level = t - t[:, :1], v.mean(axis=1, keepdims=True)
    mx, mv = total(x) / count, total(v) / count
    dx = x - wide(mx)
    slope = total(dx * (v - wide(mv))) / total(dx * dx)
    start = mv - slope * mx
    m, b = slope[:, 1:] - slope[:, :-1], start[:, :-1] - start[:, 1:]
    low, high = t[rows, cuts - 1], t[rows, cuts]
    inner = np.where(m != 0, np.clip(t[:, :1] + b / np.where(m != 0, m, 1.0), low, high), high)
    breaks = np.concatenate([t[:, :1], inner, t[:, -1:]], axis=1)
    span = np.diff(breaks, axis=1)
    right = (t - wide(breaks[:, :-1])) / wide(span)
    left, z = 1 - right, v - level
    diagonal, upper, hit = np.zeros((many, k + 1)), total(left * right), np.zeros((many, k + 1))
    for side, at in ((left, slice(0, k)), (right, slice(1, k + 1))):
        diagonal[:, at] += total(side * side)
        hit[:, at] += total(side * z)
    for i in range(k):  # elimination, then substitution
        ratio = upper[:, i] / diagonal[:, i]
        diagonal[:, i + 1] -= ratio * upper[:, i]
        hit[:, i + 1] -= ratio * hit[:, i]
    heights = hit / diagonal
    for i in range(k - 1, -1, -1):
        heights[:, i] -= upper[:, i] / diagonal[:, i] * heights[:, i + 1]
    rest = z - left * wide(heights[:, :-1]) - right * wide(heights[:, 1:])
    return breaks, np.diff(heights, axis=1) / span, (rest * rest).sum(axis=1)


def piecewise(df: DataFrame, x: str, y: str, by: list[str], most: int = 9) -> DataFrame:
    """(by..., segments, breaks, slopes, start, ssr): joined lines of 2 to `most` segments.

    For each number of segments the optimal cut into separate lines is found (see knots()); the knots are where these meet, between
    the points on both sides of the cut, and joined lines are fitted anew. Of the numbers, the least sum over segments of |ln(length)| * ssr counts, the fewer of equal ones;
    errors within the rounding of the values are none, and scores are equal within rounding. start: the
    break before the greatest slope. Points of one x count with their mean; null and non-finite points are left out. Groups
    of under four different x, or of y that is always 0 or missing, have no row. Groups of equally many points are fitted together.
    """

    def fit(t: np.ndarray, v: np.ndarray) -> tuple[list, list, np.ndarray]:
        many, n = t.shape
        least, ssr, breaks, slopes = np.full(many, np.inf), np.empty(many), [None] * many, [None] * many
        found = batch_cuts(t, v, most) if (n + 1) ** 2 <= CELLS else [np.array([c], int) for c in knots(t[0], v[0], most)]
        noise = n * (64 * np.finfo(float).eps * np.abs(v).max(axis=1)) ** 2
        for cuts in found[1:]:
            ends, rates, error = joined(t, v, cuts)
            score = np.where(error <= noise, 0.0, error) * np.abs(np.log(np.diff(ends, axis=1))).sum(axis=1)
            less = score < least * (1 - EQUAL)
            for g in np.flatnonzero(less).tolist():
                breaks[g], slopes[g] = ends[g], rates[g]
            ssr, least = np.where(less, error, ssr), np.where(less, score, least)
        return breaks, slopes, ssr

    def run(batches):
        for batch in batches:
            group, (t, v) = points_of(batch, ["x", "y"])
            order = np.lexsort((t, group))
            group, t, v = group[order], t[order], v[order]
            if (again := (np.diff(t) == 0) & (np.diff(group) == 0)).any():
                place = np.concatenate([[0], np.cumsum(~again)])
                first = np.flatnonzero(np.diff(place, prepend=-1))
                group, t, v = group[first], t[first], pd.Series(v).groupby(place).mean().to_numpy()
            rows, breaks, slopes, ssr = [], [], [], []
            for own, at in blocks(group, lambda n: (n + 1) ** 2):
                own, at = (c[v[at].any(axis=1)] for c in (own, at))
                if at.shape[1] < 4 or not len(own):
                    continue
                found = fit(t[at], v[at])
                rows += own.tolist()
                breaks += found[0]
                slopes += found[1]
                ssr += found[2].tolist()
            start = [float(b[s.argmax()]) for b, s in zip(breaks, slopes, strict=True)]
            lists = [pa.array(c, pa.list_(pa.float64())) for c in (breaks, slopes)]
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(map(len, slopes), pa.int32()), *lists, pa.array(start, pa.float64()), pa.array(ssr, pa.float64())], [*by, "segments", "breaks", "slopes", "start", "ssr"])

    double = lambda c: F.col(c).cast("double")
    return gathered(df, by, x=double(x), y=double(y)).mapInArrow(run, f"{_keys(df, by)}, segments int, breaks array<double>, slopes array<double>, start double, ssr double")


def two_segments(df: DataFrame, x: str, y: str, by: list[str], least: int = 10, decades: float = 20.0) -> DataFrame:
    """(by..., split, sse, slope_before, slope_after): the place that parts the points best into two lines.

    Every place with `least` points before it and more than `least` from it on is tried. Each line is fitted with weights that rise towards
    the place by so many powers of ten, the squared errors count unweighted. Points are in order of x, then y; the first of equally
    good places, to nine decimals, counts. Null and non-finite points are left out; groups of too few points have a row of nulls.
    Groups of equally many points are fitted together.
    """

    def line(t: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = w / w.sum()
        mean = lambda c: (w * c).sum(axis=1, keepdims=True)
        a, b = t - mean(t), v - mean(v)
        d = (w * a * a).sum(axis=1)
        slope = np.where(d > 0, (w * a * b).sum(axis=1) / np.where(d > 0, d, 1.0), 0.0)
        return slope, ((b - slope[:, None] * a) ** 2).sum(axis=1)

    def fit(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        n, best = t.shape[1], np.full((4, len(t)), np.nan)
        for i in range(least, n - least):
            up, down = np.logspace(-decades, 0, i), np.logspace(0, -decades, n - i)
            (s1, e1), (s2, e2) = line(t[:, :i], v[:, :i], up), line(t[:, i:], v[:, i:], down)
            error = np.array([round(e, 9) for e in (e1 + e2).tolist()])
            best = np.where(np.isnan(best[1]) | (error < best[1]), [t[:, i], error, s1, s2], best)
        return best

    def run(batches):
        for batch in batches:
            group, (t, v) = points_of(batch, ["x", "y"])
            order = np.lexsort((v, t, group))
            group, t, v = group[order], t[order], v[order]
            found = np.full((4, len(batch)), np.nan)
            for own, at in blocks(group, lambda n: 8 * n):
                found[:, own] = fit(t[at], v[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(c, mask=np.isnan(c)) for c in found)], [*by, "split", "sse", "slope_before", "slope_after"])

    double = lambda c: F.col(c).cast("double")
    return gathered(df, by, x=double(x), y=double(y)).mapInArrow(run, f"{_keys(df, by)}, split double, sse double, slope_before double, slope_after double")
