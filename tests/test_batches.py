"""Groups that are worked on together give what each gives alone."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spiketide.operators import models, regress, segments, wavelets


def _curves(many: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return np.cumsum(rng.uniform(0.1, 1, (many, n)), axis=1), np.cumsum(rng.poisson(0.4, (many, n)), axis=1).astype(float)


def test_cuts_and_joined_lines_of_many_groups():
    for n in (4, 7, 20, 47):
        t, v = _curves(30, n)
        found = segments.batch_cuts(t, v, 9)
        for g in range(len(t)):
            alone = segments.knots(t[g], v[g], 9)
            assert [c[g].tolist() for c in found] == alone
            for cuts, own in zip(found[1:], alone[1:], strict=True):
                breaks, slopes, ssr = (x[g] for x in segments.joined(t, v, cuts))
                inner = segments.meetings(t[g], v[g], own)
                one, error = segments.continuous(t[g], v[g], inner)
                assert np.allclose(breaks[1:-1], inner) and np.allclose(slopes, one, atol=1e-7) and np.isclose(ssr, error, atol=1e-9)


def test_exact_lines_take_the_fewest_segments(spark):
    rows = [(f"g{k}", float(i), max(0, i - k) * 0.7 + 3.1) for k in range(5, 25) for i in range(47)]
    found = segments.piecewise(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()
    assert len(found) == 20 and {r["segments"] for r in found} == {2}


def test_two_segments_of_groups_of_different_sizes(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(i), float(rng.normal())) for g in range(12) for i in range(18 + g % 4 * 3)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    together = {r["g"]: r for r in segments.two_segments(df, "x", "y", ["g"]).collect()}
    assert len(together) == 12
    for g in range(12):
        assert segments.two_segments(df.filter(F.col("g") == g), "x", "y", ["g"]).first() == together[g]
        assert (together[g]["sse"] is None) == (g % 4 == 0)


def _alone(g: int, t: np.ndarray, v: np.ndarray, w: np.ndarray, trials: int = 50) -> tuple:
    """relationship() of one group, trial by trial."""
    order = np.lexsort((w, v, t))
    t, v, w = t[order], v[order], w[order]
    rng, fits = np.random.default_rng(models.seed_of(g)), []
    for x in (t, np.log(t)):
        best, keep, near = None, None, np.median(np.abs(v - np.median(v))) + 1e-12
        for i, j in rng.choice(len(x), (trials, 2), p=w / w.sum()):
            if x[i] != x[j]:
                inside = np.abs(v - (v[i] + (v[j] - v[i]) / (x[j] - x[i]) * (x - x[i]))) <= near
                if best is None or inside.sum() > best:
                    best, keep = inside.sum(), inside
        keep = np.ones(len(x), bool) if keep is None or keep.sum() < 2 else keep
        a, b = np.polyfit(x[keep], v[keep], 1, w=np.sqrt(w[keep] + 1e-12)) if np.ptp(x[keep]) else (0.0, v.mean())
        total = (w * (v - np.average(v, weights=w)) ** 2).sum()
        fits.append((a, b, 1 - (w * (v - a * x - b) ** 2).sum() / total if total else 0.0))
    line, log = fits
    if abs(line[2]) < 0.1 and abs(log[2]) < 0.1:
        return "steady", 0.0, np.average(v, weights=w), 1.0
    return ("linear", *line) if line[2] > log[2] else ("logarithmic", *log)


def test_relationships_of_many_groups_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    frames = []
    for g in range(60):
        n = int(rng.integers(3, 12))
        x = rng.permutation(np.arange(1.0, 31.0))[:n] if g % 9 else np.full(n, 4.0)
        frames.append(pd.DataFrame({"g": g, "x": x, "y": (3 * x if g % 2 else 9 * np.log(x)) + rng.normal(0, g % 5, n), "w": rng.uniform(0.5, 2, n)}))
    df = spark.createDataFrame(pd.concat(frames))
    found = models.relationship(df, "x", "y", "w", ["g"]).collect()
    assert len(found) == 60
    for r in found:
        p = frames[r["g"]]
        kind, *numbers = _alone(r["g"], *(p[c].to_numpy() for c in "xyw"))
        assert r["kind"] == kind and np.allclose(r[2:], numbers, atol=1e-7)


def test_banks_and_ridges_of_many_signals():
    rng, scales = np.random.default_rng(4), np.geomspace(1, 16, 20)
    signals, path = rng.normal(size=(7, 50)), rng.integers(0, 20, 50)
    banks = wavelets.bank(signals, scales)
    traces, shifts = wavelets.ridge(banks, path, 6)
    for s, bank, trace, shift in zip(signals, banks, traces, shifts, strict=True):
        assert np.array_equal(bank, wavelets.bank(s, scales))
        sums = {k: bank[np.clip(path + k, 0, 19), np.arange(50)].sum() for k in range(-6, 7)}
        assert sums[shift] == max(sums.values()) and np.isclose(trace.sum(), sums[shift])


def test_bootstrap_of_a_group_dealt_to_parts(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("k"), (F.col("id") * 37 % 1000 / 7).alias("v"))
    whole = regress.bootstrap(rows, "v", ["g"], ["k"], 30)
    monkeypatch.setattr(regress, "PART_ROWS", 100)
    parts = regress.bootstrap(rows, "v", ["g"], ["k"], 30)
    one, two = (sorted(map(tuple, d.collect())) for d in (whole, parts))
    assert len(one) == 2 and np.allclose(one, two)
