"""Dynamic time warping over tables: templates slid along signals, and k-means whose means are warped averages.

Signals are cut into overlapping stretches, so a task holds a stretch, not a signal; vectors come in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _keys

#: Windows that begin in one stretch of a signal.
STRETCH = 512


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row from 0 to 1; a constant row is 0."""
    low, high = rows.min(axis=1, keepdims=True), rows.max(axis=1, keepdims=True)
    return (rows - low) / np.where(high > low, high - low, 1.0)


def _table(rows: np.ndarray, shape: np.ndarray, band: int) -> np.ndarray:
    """Cumulated squared costs of the best paths, rows x (width + 1) x (length + 1)."""
    n, width = rows.shape
    band = max(band, abs(width - len(shape)))
    table = np.full((width + 1, len(shape) + 1, n), np.inf)
    table[0, 0] = 0
    for i in range(1, width + 1):
        for j in range(max(1, i - band), min(len(shape), i + band) + 1):
            table[i, j] = (rows[:, i - 1] - shape[j - 1]) ** 2 + np.minimum(table[i - 1, j - 1], np.minimum(table[i - 1, j], table[i, j - 1]))
    return table


def distances(rows: np.ndarray, shape: np.ndarray, band: int) -> np.ndarray:
    """Warped distance of every row from a shape within a band of the diagonal."""
    return np.sqrt(_table(rows, shape, band)[-1, -1])


def envelope_bound(rows: np.ndarray, shape: np.ndarray, band: int) -> np.ndarray:
    """What the warped distance of every row from a shape of its length is at least: its distance from the band around the shape."""
    padded = np.pad(shape, band, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * band + 1)
    out = np.maximum(np.maximum(rows - windows.max(axis=1), windows.min(axis=1) - rows), 0)
    return np.sqrt((out**2).sum(axis=1))


def template_matches(df: DataFrame, by: list[str], order: str, value: str, template: list[float], band: int = 4, most: float | None = None, prune: bool = True) -> DataFrame:
    """(by..., place, distance): windows of each signal whose warped distance from a template is at most `most`; without it, the nearest
    window of each signal, the first of equally near ones.

    df (by..., order, value) has a value for each whole number from 0 on; missing and null ones count as 0 within a stretch. Windows and
    template are scaled from 0 to 1. Windows that an envelope of the template already keeps farther away are not warped; prune: whether
    to spare them. Signals shorter than the template have no row.
    """
    shape = scaled(np.array([template], float))[0]
    size = STRETCH + len(shape) - 1
    at = F.col(order).cast("long")
    first, last = F.greatest(F.lit(0), F.floor((at - size + STRETCH) / STRETCH)).cast("long"), F.floor(at / STRETCH)
    dealt = df.select(*by, at.alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.explode(F.sequence(first, last)).alias("stretch"))
    stretches = dealt.groupBy(*by, "stretch").agg(F.collect_list(F.struct((F.col("at") - F.col("stretch") * STRETCH).cast("int").alias("at"), "v")).alias("s"))
    names = [*by, "stretch"]

    def run(batches):
        for batch in batches:
            column = batch.column(len(names))
            ends, flat = column.offsets.to_numpy(), column.values
            place, values = flat.field("at").to_numpy(), flat.field("v").to_numpy()
            found_row, found_place, found = [], [], []
            for r in range(batch.num_rows):
                own, v = place[ends[r] : ends[r + 1]], values[ends[r] : ends[r + 1]]
                signal = np.zeros(own.max() + 1)
                signal[own] = v
                if len(signal) < len(shape):
                    continue
                windows = scaled(np.lib.stride_tricks.sliding_window_view(signal, len(shape)))
                bounds = envelope_bound(windows, shape, band) if prune else np.zeros(len(windows))
                if most is not None:
                    near = np.flatnonzero(bounds <= most)
                    d = distances(windows[near], shape, band)
                    near, d = near[d <= most], d[d <= most]
                else:
                    best = (np.inf, -1)
                    ranked = np.argsort(bounds, kind="stable")
                    for a in range(0, len(ranked), 32):
                        some = ranked[a : a + 32]
                        if bounds[some[0]] > best[0]:
                            break
                        d = distances(windows[some], shape, band)
                        best = min(best, *zip(d.tolist(), some.tolist(), strict=True))
                    near, d = np.array([best[1]]), np.array([best[0]])
                found_row += [r] * len(near)
                found_place += near.tolist()
                found += d.tolist()
            picked = batch.take(pa.array(found_row, pa.int64()))
            where = np.array(found_place, np.int64) + STRETCH * picked.column(len(by)).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*picked.columns[: len(by)], pa.array(where), pa.array(found, pa.float64())], [*by, "place", "distance"])

    kinds = ", ".join(filter(None, [_keys(df, by), "place long, distance double"]))
    found = stretches.select(*names, "s").mapInArrow(run, kinds)
    if most is not None:
        return found
    return found.groupBy(*by).agg(F.min(F.struct("distance", "place")).alias("m")).select(*by, "m.place", "m.distance")


def _vectors(batch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def assigned(vectors: DataFrame, key: str, vector: str, centres: np.ndarray, band: int) -> DataFrame:
    """(key, cluster, distance): the nearest of the centres by warped distance, the first of equally near ones."""

    def run(batches):
        for batch in batches:
            rows = _vectors(batch, 1)
            d = np.stack([distances(rows, c, band) for c in centres], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], [key, "cluster", "distance"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{_keys(vectors, [key])}, cluster int, distance double")


def _averaged(vectors: DataFrame, vector: str, centres: np.ndarray, band: int) -> tuple[np.ndarray, float]:
    """The warped averages of the vectors nearest to each centre, and the sum of squared distances: sums by centre and place in each task."""

    def run(batches):
        sums, counts, loss = np.zeros_like(centres), np.zeros_like(centres), 0.0
        for batch in batches:
            rows = _vectors(batch, 0)
            tables = [_table(rows, c, band) for c in centres]
            final = np.stack([t[-1, -1] for t in tables], axis=1)
            nearest = final.argmin(axis=1)
            loss += float(final.min(axis=1).sum())
            for c, t in enumerate(tables):
                mine = np.flatnonzero(nearest == c)
                i, j = np.full(len(mine), rows.shape[1]), np.full(len(mine), centres.shape[1])
                while len(mine):
                    np.add.at(sums[c], j - 1, rows[mine, i - 1])
                    np.add.at(counts[c], j - 1, 1)
                    step = np.argmin([t[i - 1, j - 1, mine], t[i - 1, j, mine], t[i, j - 1, mine]], axis=0)
                    i, j = i - (step < 2), j - (step != 1)
                    left = (i > 0) & (j > 0)
                    mine, i, j = mine[left], i[left], j[left]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()]), pa.array([counts.ravel().tolist()]), pa.array([loss])], ["sums", "counts", "loss"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(run, "sums array<double>, counts array<double>, loss double")
    flat = parts.select(F.posexplode(F.arrays_zip("sums", "counts")).alias("at", "z")).groupBy("at").agg(F.sum("z.sums").alias("s"), F.sum("z.counts").alias("n"))
    sums, counts = np.zeros(centres.size), np.zeros(centres.size)
    for at, s, n in flat.collect():  # centres x their length
        sums[at], counts[at] = s, n
    loss = parts.agg(F.sum("loss")).first()[0] or 0.0
    sums, counts = sums.reshape(centres.shape), counts.reshape(centres.shape)
    return np.where(counts > 0, sums / np.where(counts > 0, counts, 1), centres), loss


def warped_kmeans(vectors: DataFrame, key: str, vector: str, k: int, band: int = 4, rounds: int = 10, tolerance: float = 1e-4) -> tuple[DataFrame, list[list[float]]]:
    """((key, cluster, distance), centres): k-means by warped distance, its centres barycentre averages.

    Vectors have one length and no null or non-finite component; null vectors are left out. The first centre is the vector of least hash of its key, each further one the
    vector farthest from those before. A round sends the centres to the tasks and brings back sums of their size; only vectors stay where they are. It ends
    when the sum of squared distances falls by less than `tolerance` of it, or after `rounds`. With fewer than k different vectors there are fewer centres.
    """
    known = vectors.filter(F.col(vector).isNotNull())
    head = known.orderBy(F.xxhash64(key), key).select(F.col(vector).cast("array<double>")).first()
    if head is None:
        return vectors.sparkSession.createDataFrame([], f"{_keys(vectors, [key])}, cluster int, distance double"), []
    centres = np.array([head[0]], float)
    while len(centres) < k:
        far = assigned(known, key, vector, centres, band).orderBy(F.desc("distance"), key).first()
        if far["distance"] == 0:
            break
        new = known.filter(F.col(key) == F.lit(far[key])).select(F.col(vector).cast("array<double>")).first()[0]
        centres = np.vstack([centres, new])
    last = np.inf
    for _ in range(rounds):
        moved, loss = _averaged(known, vector, centres, band)
        if not loss < last * (1 - tolerance):
            break
        centres, last = moved, loss
    return assigned(known, key, vector, centres, band), centres.tolist()
