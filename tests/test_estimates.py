"""First spikes, segments, correlations, spectra, regressions, bootstraps and raw channels against plain versions."""

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spiketide.operators import align, histograms, latency, regress, segments, signals
from spiketide.sources import raw

rng = np.random.default_rng(3)


# -- carry and peaks


CARRY = "recording string, cell_index long, stimulus_index int"


def test_carry_takes_the_value_of_the_stimulus(spark):
    spikes = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", 3, 0), (None, 1, 0)], CARRY)
    cells = spark.createDataFrame([("a", 1, 0, 0.9, "x", None), ("a", 1, 1, 0.2, None, 4), ("a", 3, 0, 0.1, "y", 1), ("a", 3, 0, 0.5, "z", None)], CARRY + ", qi double, name string, n long")
    found = {(r["recording"], r["cell_index"], r["stimulus_index"]): (r["qi"], r["name"], r["n"]) for r in align.carry(spikes, cells, ["qi", "name", "n"]).collect()}
    assert found == {("a", 1, 0): (0.9, "x", None), ("a", 1, 1): (0.2, None, 4), ("a", 2, 0): (0.0, "", 0), ("a", 3, 0): (0.5, "z", None), (None, 1, 0): (0.0, "", 0)}


def test_carry_of_cells_without_stimuli(spark):
    spikes = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 0)], CARRY)
    cells = spark.createDataFrame([("a", 1, 7)], "recording string, cell_index long, nr int")
    assert sorted(r["nr"] for r in align.carry(spikes, cells, ["nr"]).collect()) == [0, 7, 7]
    assert align.carry(spikes, cells, ["nr"]).schema["nr"].dataType.simpleString() == "int"


def thinned(counts, distance):
    """Tops as a signal library finds them: plateaus at their middle, height, then suppression from the highest on."""
    sd, tops, i = statistics.pstdev(counts), [], 1
    while i < len(counts) - 1:
        j = i
        while j + 1 < len(counts) and counts[j + 1] == counts[i]:
            j += 1
        if counts[i - 1] < counts[i] and j + 1 < len(counts) and counts[j + 1] < counts[i] and counts[i] >= sd:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for b in sorted(tops, key=lambda b: (-counts[b], b)):
        if all(abs(b - k) >= distance for k in kept):
            kept.append(b)
    return sorted(kept)


PROBES = [([0, 10, 0, 9, 0, 8, 0], 3, [1, 5]), ([0, 10, 0, 9, 0, 8, 0], 2, [1, 3, 5]), ([0, 3, 3, 3, 3, 3, 5, 0], 2, [6]), ([9, 0, 4, 4, 4, 0, 9], 1, [3]), ([5, 5, 5], 1, []), ([7], 2, [])]


@pytest.mark.parametrize(("counts", "distance", "want"), PROBES)
def test_peaks_are_suppressed_from_the_highest_on(spark, counts, distance, want):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(counts)], "g string, bin long, count long")
    assert [r["bin"] for r in histograms.local_peaks(df, ["g"], distance).orderBy("bin").collect()] == want == thinned(counts, distance)


def test_peaks_of_many_groups(spark):
    groups = {g: rng.integers(0, 9, 80).tolist() for g in range(25)}
    df = spark.createDataFrame([(g, i, c) for g, v in groups.items() for i, c in enumerate(v)] + [(0, 99, None)], "g long, bin long, count long").repartition(3)
    found = {g: [] for g in groups}
    for r in histograms.local_peaks(df, ["g"], 4).orderBy("g", "bin").collect():
        found[r["g"]].append(r["bin"])
    assert found == {g: thinned(v, 4) for g, v in groups.items()}


def test_peak_heights_belong_to_the_nearest_rounded_onset(spark):
    peaks = spark.createDataFrame([("a", 0, 5), ("a", 9, 7), ("a", 11, 6), ("a", 30, 9)], "g string, bin long, count long")
    onsets = spark.createDataFrame([("a", 0, 1.2), ("a", 1, 1.4), ("a", 2, 1.4), ("b", 0, 1.0)], "g string, position long, seconds double")
    # intervals begin at 0, 1.2 -> 1, 2.6 -> 3; peaks lie at 0, 0.9, 1.1, 3.0
    found = sorted(tuple(r) for r in histograms.peak_heights(peaks, onsets, ["g"], 0.1).collect())
    assert found == [("a", 0, 5), ("a", 1, 6), ("a", 2, 9), ("b", 0, 0)]


# -- first spikes


def test_trigger_windows_are_open_and_overlap(spark):
    events = spark.createDataFrame([("a", t) for t in (-0.5, 0.0, 0.5, 1.0, 1.5)] + [("a", None), ("b", 0.0)], "g string, time double")
    onsets = spark.createDataFrame([("a", 0, 0, 0.0, "x"), ("a", 1, 0, 1.0, "y"), ("a", 2, 0, None, "z")], "g string, trigger long, repeat long, onset double, more string")
    found = sorted((r["trigger"], r["t"], r["more"]) for r in latency.trigger_windows(events, onsets, ["g"], "time", -0.5, 1.0).collect())
    assert found == [(0, 0.0, "x"), (0, 0.5, "x"), (1, 0.0, "y"), (1, 0.5, "y")]


def plain_first_spikes(windows, fits, low, std):
    """windows {(cell, trigger, repeat): times}, fits {(cell, trigger): (breaks, slopes)}."""
    starts = {}
    for (cell, _), (breaks, slopes) in fits.items():
        starts.setdefault(cell, []).append(breaks[int(np.argmax(slopes))])
    own = {c: statistics.median(s) for c, s in starts.items()}
    start = statistics.median(own.values())
    out = {}
    for (cell, trigger, repeat), times in windows.items():
        t = np.sort(np.array(times))
        n, c, early = len(t), np.sort(np.array(times)) - low, bool(min(times) < 0)
        out[cell, trigger, repeat] = (n, early, None, None)
        if n < 2 or (cell, trigger) not in fits:
            continue
        breaks, slopes = fits[cell, trigger]
        at = int(np.argmin(np.abs(np.array(breaks) - own[cell])))
        before, after = (float(np.mean(s)) if len(s) else None for s in (slopes[:at], slopes[at:]))
        before = latency.LEAST_BEFORE if before is not None and before <= 0 else before
        after = latency.LEAST_AFTER if after is not None and after <= 0 else after
        if after is None or (early and before is None):
            continue
        i = np.arange(1, n)
        two = (n - i) * np.log(after) - after * (c[-1] - c[:-1])
        post = None
        if before is not None:
            both = i * np.log(before) - before * c[:-1] + two
            post = np.exp(-0.5 * ((t[:-1] - start) / std) ** 2) * np.exp(both - both.max())
        k = int(np.argmax(post if early else two))
        out[cell, trigger, repeat] = (n, early, t[k], None if post is None else post[k])
    return out


def test_first_spikes_equal_a_plain_version(spark):
    windows, fits = {}, {}
    for cell, trigger in itertools.product(range(6), range(3)):
        for repeat in range(4):
            silent, active = rng.uniform(-0.2, 0.05, rng.poisson(1)), rng.uniform(0.04, 0.2, rng.poisson(5))
            times = [float(x) for x in (*silent, *active)]
            if times:
                windows[cell, trigger, repeat] = times
        breaks = [-0.2, float(rng.uniform(-0.1, 0.0)), float(rng.uniform(0.01, 0.1)), 0.2]
        fits[cell, trigger] = breaks, [float(x) for x in rng.uniform(-3, 40, 3)]
    windows[9, 0, 0], windows[0, 0, 9] = [0.1, 0.15], [0.01]  # a cell without a fit, a single spike
    fits[1, 1] = [-0.2, 0.2], [5.0]  # one segment: no slope before its first break, or none after its last
    w = spark.createDataFrame([(*k, t) for k, v in windows.items() for t in v], "cell long, trigger long, repeat long, t double").repartition(3)
    f = spark.createDataFrame([(*k, *v) for k, v in fits.items()], "cell long, trigger long, breaks array<double>, slopes array<double>")
    found = {(r["cell"], r["trigger"], r["repeat"]): (r["n"], r["early"], r["first_spike"], r["posterior"]) for r in latency.first_spikes(w, f, ["cell"], -0.2, 0.05).collect()}
    want = plain_first_spikes(windows, fits, -0.2, 0.05)
    assert found.keys() == want.keys()
    for k, (n, early, first, post) in want.items():
        assert found[k][:3] == (n, early, first), k
        assert found[k][3] == (None if post is None else pytest.approx(post, abs=1e-12)), k
    assert sum(v[2] is not None for v in want.values()) > 40 and any(v[1] for v in want.values())


def test_first_spikes_find_the_planted_change(spark):
    rows = []
    for repeat in range(30):
        rows += [("a", 0, repeat, float(t)) for t in (*rng.uniform(-0.2, 0.08, rng.poisson(0.28 * 5)), 0.08, *np.sort(rng.uniform(0.08, 0.2, 12)))]
    w = spark.createDataFrame(rows, "cell string, trigger long, repeat long, t double")
    counts = histograms.psth(w, "t", 0.005, 0.2, ["cell", "trigger"], start=-0.2)
    curve = histograms.cumulative(counts, ["cell", "trigger"]).withColumn("x", -0.2 + (F.col("bin") + 1) * 0.005)
    fits = segments.piecewise(curve, "x", "cumulative", ["cell", "trigger"]).withColumn("slopes", F.transform("slopes", lambda m: m / 30))
    r = latency.first_spike_summary(latency.first_spikes(w, fits, ["cell"], -0.2, 0.02), ["cell"]).first()
    assert abs(r["median"] - 0.08) < 0.01 and r["repeats"] == 30


def test_first_spikes_of_nothing(spark):
    w = spark.createDataFrame([], "cell long, trigger long, repeat long, t double")
    f = spark.createDataFrame([], "cell long, trigger long, breaks array<double>, slopes array<double>")
    assert latency.first_spikes(w, f, ["cell"], -0.2, 0.05).isEmpty()


# -- segments


def line_error(t, v):
    if len(t) < 2 or np.ptp(t) == 0:
        return float(((v - v.mean()) ** 2).sum())
    return float(((v - np.polyval(np.polyfit(t, v, 1), t)) ** 2).sum())


@pytest.mark.parametrize("n", [6, 9, 12])
def test_knots_equal_exhaustive_search(n):
    t, v = np.sort(rng.uniform(0, 10, n)), rng.normal(size=n).cumsum()
    for k, cuts in enumerate(segments.knots(t, v, 4), 1):
        error = lambda c: sum(line_error(t[a:b], v[a:b]) for a, b in itertools.pairwise([0, *c, n]))
        every = [c for c in itertools.combinations(range(2, n - 1), k - 1) if all(b - a >= 2 for a, b in itertools.pairwise([0, *c, n]))]
        assert len(cuts) == k - 1 and error(cuts) == pytest.approx(min(map(error, every)), abs=1e-9)


def test_piecewise_recovers_up_to_nine_segments(spark):
    inner, slopes = [6, 14, 20, 27, 35, 41, 50, 56], [0, 5, -3, 8, 0, -6, 4, 0, 9]
    x = np.arange(65.0)
    y = sum(m * (np.clip(x, a, b) - a) for m, a, b in zip(slopes, [0, *inner], [*inner, 64], strict=True)) + 1.0
    rows = [("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("a", None, 1.0), ("a", 3.0, None), ("b", 1.0, 1.0), ("c", 1.0, 0.0), ("c", 2.0, 0.0), ("c", 3.0, 0.0), ("c", 4.0, 0.0)]
    found = segments.piecewise(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()
    assert [r["g"] for r in found] == ["a"] and found[0]["segments"] == 9
    assert np.allclose(found[0]["breaks"], [0, *inner, 64], atol=1) and found[0]["ssr"] < 30
    assert found[0]["start"] == pytest.approx(56, abs=1)


def test_two_segments_equal_weighted_fits(spark):
    x, y = np.arange(40.0), np.concatenate([np.linspace(0, 3, 22), np.linspace(3, 30, 18)]) + rng.normal(0, 0.3, 40)

    def fit(t, v, w):
        slope, at = np.polyfit(t, v, 1, w=np.sqrt(w))
        return float(((v - slope * t - at) ** 2).sum()), slope

    tried = {}
    for i in range(10, 30):
        one, two = fit(x[:i], y[:i], np.logspace(-6, 0, i)), fit(x[i:], y[i:], np.logspace(0, -6, 40 - i))
        tried[i] = one[0] + two[0], one[1], two[1]
    best = min(tried, key=lambda i: tried[i][0])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("b", 1.0, 1.0)], "g string, x double, y double")
    found = {r["g"]: r for r in segments.two_segments(df, "x", "y", ["g"], decades=6).collect()}
    assert found["a"]["split"] == best and (found["a"]["sse"], found["a"]["slope_before"], found["a"]["slope_after"]) == pytest.approx(tried[best], rel=1e-4)
    assert found["b"]["split"] is None and found["b"]["sse"] is None


# -- signals


def test_on_off_index_equals_full_correlation(spark):
    n, interval = 60, 8
    triggers = np.zeros(n, int)
    triggers[::16] = 1
    cells = {c: rng.poisson(0.4, n) for c in range(5)} | {5: np.zeros(n, int)}
    hist = spark.createDataFrame([("a", c, i, int(x)) for c, v in cells.items() for i, x in enumerate(v)], "g string, cell long, bin long, count long")
    onsets = spark.createDataFrame([("a", int(i), 1) for i in np.flatnonzero(triggers)] + [("b", 0, 1)], "g string, bin long, n long")
    found = {r["cell"]: (r["on"], r["off"], r["index"]) for r in signals.on_off_index(hist, onsets, ["g"], ["g", "cell"], interval).collect()}
    for c, v in cells.items():
        half = np.correlate(triggers, v, "full")[n - 1 :]
        on, off = half[: interval // 2].max(), half[interval - 1 : interval + interval // 2].max()
        assert found[c] == (on, off, (off - on) / (off + on) if on and off else None)


def test_sine_fit_recovers_planted_sines(spark):
    x = np.linspace(0, 10, 200)
    rows = [("a", float(t), float(3 * np.sin(2 * np.pi * 0.63 * t + 1) + 0.5 + e)) for t, e in zip(x, rng.normal(0, 0.05, 200), strict=True)]
    rows += [("b", float(t), float(np.sin(2 * np.pi * 1.31 * t - 2))) for t in x] + [("c", 1.0, 2.0), ("a", None, 1.0)]
    found = {r["g"]: r for r in signals.sine_fit(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"], [0.1 * k for k in range(1, 20)]).collect()}
    assert set(found) == {"a", "b"}
    for g, want in {"a": (0.63, 3, 1, 0.5), "b": (1.31, 1, -2, 0)}.items():
        r = found[g]
        assert (r["hertz"], r["amplitude"], r["phase"], r["offset"]) == pytest.approx(want, abs=0.03)
    assert found["b"]["sse"] < 0.05


def test_welch_equals_averaged_periodograms(spark):
    v = {g: rng.normal(size=100) + 3 * np.sin(2 * np.pi * 12.5 * np.arange(100) / 100) for g in "ab"}
    df = spark.createDataFrame([(g, i, float(x)) for g, s in v.items() for i, x in enumerate(s)] + [("c", 3, 1.0)], "g string, bin long, count double").repartition(4)
    found = {}
    for r in signals.welch(df, ["g"], 100.0, 32).orderBy("k").collect():
        found.setdefault(r["g"], []).append(r["power"])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    for g, s in v.items():
        parts = [np.abs(np.fft.rfft((s[a : a + 32] - s[a : a + 32].mean()) * window)) ** 2 / (100 * (window**2).sum()) for a in range(0, 69, 16)]
        want = np.mean(parts, axis=0) * np.r_[1, np.full(15, 2), 1]
        assert np.allclose(found[g], want) and int(np.argmax(found[g])) == 4
    assert set(found) == {"a", "b"}


# -- regressions


KNOWN = [(0.5, 2.0, 3.0, 0.6875), (0.1, 0.5, 0.5, 2 / math.pi * math.asin(math.sqrt(0.1))), (0.9, 5.0, 0.5, None), (0.0, 1.0, 1.0, 0.0), (1.0, 1.0, 1.0, 1.0), (0.3, 1.0, 1.0, 0.3), (0.999, 400.0, 0.5, None), (1e-6, 30.0, 0.5, None)]


def test_incomplete_beta(spark):
    df = spark.createDataFrame([(x, a, b) for x, a, b, _ in KNOWN], "x double, a double, b double")
    found = [r[0] for r in df.select(regress.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect()]
    for got, (x, a, b, want) in zip(found, KNOWN, strict=True):
        if want is None:  # the integral by substitution t = u^2 at the end where b = 1/2 is singular
            u = np.linspace(math.sqrt(1 - x), 1, 2_000_001)
            area = np.trapezoid(2 * (1 - u * u) ** (a - 1), u)
            want = area * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        assert got == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert spark.createDataFrame([(None,)], "x double").select(regress.incomplete_beta(F.col("x"), F.lit(1.0), F.lit(2.0))).first()[0] is None


def test_line_p_values(spark):
    # p of r = 0.878 with n = 5 and of r = 0.632 with n = 10: the tabled 5 % points; n = 2 and constants have none
    rows = [("n2", 1.0, 1.0), ("n2", 2.0, 5.0), *[("flat", float(i), 1.0) for i in range(5)], *[("steep", 1.0, float(i)) for i in range(5)], ("one", 1.0, None)]
    x = np.arange(5.0) - 2
    e = np.array([1.0, -2, 0, 2, -1])
    y = 0.8783 * x / np.linalg.norm(x) + math.sqrt(1 - 0.8783**2) * e / np.linalg.norm(e)
    rows += [("five", float(a), float(b)) for a, b in zip(x, y, strict=True)]
    found = {r["g"]: r for r in regress.line(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", ["g"]).collect()}
    assert found["five"]["p"] == pytest.approx(0.05, abs=2e-4) and found["five"]["r2"] == pytest.approx(0.8783**2)
    assert all(found[g]["p"] is None for g in ("n2", "flat", "steep", "one"))


def test_lasso_equals_descent_on_rows(spark):
    n, width = 300, 6
    x = rng.normal(size=(n, width))
    x[:, 3] = 2.0  # constant
    y = x @ np.array([2.0, 0, -1.0, 0, 0, 0.5]) + 1.0 + rng.normal(0, 0.5, n)
    rows = [("a", i, [float(v) for v in r], float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [("a", 999, [1.0] * width, None), ("a", 998, [math.nan] * width, 1.0), ("b", 1, [1.0] * width, 2.0)]
    df = spark.createDataFrame(rows, "g string, key long, x array<double>, y double").repartition(4)
    folds = {r["key"]: r["f"] for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(5)).alias("f")).collect()}
    found = {r["g"]: r for r in regress.lasso_cv(df, "x", "y", ["g"], "key").collect()}

    def plain(a, b, penalty):
        beta, mx, my = np.zeros(width), a.mean(0), b.mean()
        a, b = a - mx, b - my
        for _ in range(2000):
            for k in range(width):
                scale = (a[:, k] ** 2).mean()
                if scale > 1e-12:
                    rho = (a[:, k] * (b - a @ beta + a[:, k] * beta[k])).mean()
                    beta[k] = np.sign(rho) * max(abs(rho) - penalty, 0) / scale
        return beta, my - mx @ beta

    of = np.array([folds[i] for i in range(n)])
    top = np.abs(((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0)).max()
    grid = top * np.logspace(0, -3, 50)

    def error(penalty):
        total = 0.0
        for f in range(5):
            beta, at = plain(x[of != f], y[of != f], penalty)
            total += ((y[of == f] - x[of == f] @ beta - at) ** 2).mean()
        return total

    near = [j for j in range(50) if math.isclose(grid[j], found["a"]["penalty"], rel_tol=1e-9)]
    assert len(near) == 1 and all(error(grid[j]) >= error(grid[near[0]]) - 1e-9 for j in (max(0, near[0] - 4), max(0, near[0] - 1), min(49, near[0] + 1), min(49, near[0] + 4)))
    beta, at = plain(x, y, found["a"]["penalty"])
    assert np.allclose(found["a"]["coefficients"], beta, atol=1e-6) and found["a"]["intercept"] == pytest.approx(at, abs=1e-6) and found["a"]["n"] == n
    solved, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), np.delete(x, 3, axis=1)]), y, rcond=None)
    assert np.allclose(np.delete(found["a"]["linear"], 3), solved[1:], atol=1e-8) and found["a"]["linear_r2"] >= found["a"]["r2"] > 0.8
    assert found["b"]["n"] == 1 and found["b"]["coefficients"] == [0.0] * width and found["b"]["r2"] is None


def test_bootstrap_repeats_and_covers(spark):
    v = rng.normal(10, 2, 400)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("a", 999, None), ("b", 5, 3.0)]
    df = spark.createDataFrame(rows, "g string, key long, v double")
    one, two = (sorted(map(tuple, regress.bootstrap(d, "v", ["g"], ["key"], 400).collect())) for d in (df.repartition(1), df.repartition(7)))
    assert [g for g, *_ in one] == ["a", "b"] and np.allclose([x[1:] for x in one], [x[1:] for x in two], rtol=1e-12)
    half = 1.96 * v.std() / 20
    assert one[0][1] == pytest.approx(v.mean() - half, abs=0.06) and one[0][2] == pytest.approx(v.mean() + half, abs=0.06)
    assert one[1][1:] == (3.0, 3.0)


# -- raw channels


@pytest.mark.parametrize("interleaved", [False, True])
def test_raw_channel_is_split_by_bytes(spark, tmp_path, interleaved):
    v = rng.integers(-(2**15), 2**15, 1001).astype("<i2")
    v.tofile(f"{tmp_path}/a.dat")
    (v[:3]).tofile(f"{tmp_path}/b.dat")
    open(f"{tmp_path}/c.dat", "wb").close()
    with open(f"{tmp_path}/b.dat", "ab") as f:
        f.write(b"x")  # half a sample
    df = raw.raw_channel(spark, str(tmp_path), interleaved, range_bytes=130)
    assert df.rdd.getNumPartitions() == 17  # 16 ranges of the first file and one of the second
    found = {}
    for r in df.orderBy("path", "frame").collect():
        found.setdefault(r["path"][-5:], []).append((r["frame"], r["voltage"]))
    wide = lambda s: np.maximum(s[: len(s) // 2 * 2 : 2], s[1::2]) if interleaved else s
    assert found == {n: list(enumerate(map(int, wide(s)))) for n, s in (("a.dat", v), ("b.dat", v[:3]))}
    with pytest.raises(Exception, match="none"):
        raw.raw_channel(spark, f"{tmp_path}/none.dat").count()
