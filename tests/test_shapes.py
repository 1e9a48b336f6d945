"""Warped templates and clusters, linkage, silhouettes, wavelets, expressions, as-of joins and small helpers against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spiketide.operators import features, histograms, latency, linkage, models, predicates, tables, triggers, warping, wavelets
from spiketide.plans.session import Recordings
from spiketide.sources import tables as sources

rng = np.random.default_rng(4)


# -- warping


def test_distances_equal_the_plain_recurrence():
    rows, shape = rng.normal(size=(20, 12)), rng.normal(size=12)
    for band in (0, 2, 12):
        assert np.allclose(warping.distances(rows, shape, band), [models.warped(r, shape, band) for r in rows])
        assert (warping.envelope_bound(rows, shape, band) <= warping.distances(rows, shape, band) + 1e-12).all()


def windows(signal, template, band):
    shape = warping.scaled(np.array([template]))[0]
    cut = warping.scaled(np.lib.stride_tricks.sliding_window_view(np.array(signal, float), len(shape)))
    return [models.warped(w, shape, band) for w in cut]


@pytest.mark.parametrize("stretch", [7, 512])
def test_template_matches_equal_no_pruning(spark, monkeypatch, stretch):
    monkeypatch.setattr(warping, "STRETCH", stretch)
    template = [0.0, 1.0, 3.0, 1.0, 0.0]
    signals = {"a": rng.poisson(2, 60).tolist(), "b": [0, 0, 1, 3, 1, 0, 0, 5, 5, 5, 5, 5], "short": [1, 2], "flat": [3] * 9}
    rows = [(g, i, v) for g, s in signals.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, bin long, count int").repartition(3)
    want = {g: windows(s, template, 1) for g, s in signals.items() if len(s) >= 5}
    for prune in (True, False):
        found = sorted((r["g"], r["place"], round(r["distance"], 9)) for r in warping.template_matches(df, ["g"], "bin", "count", template, 1, most=0.8, prune=prune).collect())
        assert found == sorted((g, i, round(d, 9)) for g, v in want.items() for i, d in enumerate(v) if d <= 0.8)
        best = {r["g"]: (r["place"], r["distance"]) for r in warping.template_matches(df, ["g"], "bin", "count", template, 1, prune=prune).collect()}
        assert best.keys() == want.keys()
        for g, v in want.items():
            assert best[g][1] == pytest.approx(min(v)) and best[g][0] == int(np.argmin(np.round(v, 9)))


def test_warped_kmeans_finds_shifted_shapes(spark):
    t = np.arange(24)
    shapes = [np.exp(-((t - 8) ** 2) / 6), np.exp(-((t - 6) ** 2) / 3) - np.exp(-((t - 17) ** 2) / 3), np.zeros(24)]
    rows = [(30 * c + i, c, (np.roll(s, int(rng.integers(-1, 2))) + rng.normal(0, 0.02, 24)).tolist()) for c, s in enumerate(shapes) for i in range(15)]
    df = spark.createDataFrame([*rows, (999, 9, None)], "k long, c int, v array<double>").repartition(4)
    found, centres = warping.warped_kmeans(df, "k", "v", 3, band=4)
    own = {r["k"]: r["cluster"] for r in found.collect()}
    assert len(own) == 45 and len(centres) == 3
    assert {frozenset(k for k, c in own.items() if c == x) for x in range(3)} == {frozenset(k for k, c, _ in rows if c == x) for x in range(3)}
    again, _ = warping.warped_kmeans(df.repartition(1), "k", "v", 3, band=4)
    assert {r["k"]: r["cluster"] for r in again.collect()} == own
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "k long, v array<double>")
    assert {r["cluster"] for r in warping.warped_kmeans(same, "k", "v", 3)[0].collect()} == {0}
    assert warping.warped_kmeans(df.filter("false"), "k", "v", 3)[0].isEmpty()


# -- linkage


def plain_linkage(points, clusters):
    groups = [[i] for i in range(len(points))]
    far = lambda a, b: max(np.linalg.norm(points[i] - points[j]) for i in a for j in b)
    while len(groups) > clusters:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_complete_linkage_equals_brute_force(spark):
    points = rng.normal(size=(40, 3))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(100, points[0].tolist()), (101, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    for clusters in (1, 4, 11):
        own = {r["k"]: r["cluster"] for r in linkage.complete_linkage(df, "k", "v", clusters=clusters).collect()}
        assert own.pop(100) == own[0] and 101 not in own
        assert {frozenset(k for k, c in own.items() if c == x) for x in own.values()} == plain_linkage(points, clusters)
    heights = [h for _, _, h in linkage.chain(points)]
    assert heights == sorted(heights) and len(heights) == 39
    low = {r["cluster"] for r in linkage.complete_linkage(df, "k", "v", height=heights[20]).collect()}
    assert len(low) == 20
    assert linkage.complete_linkage(df.filter("false"), "k", "v", clusters=2).isEmpty()


def test_linkage_of_summaries_and_silhouettes(spark):
    centres = np.array([[0, 0], [20, 0], [0, 20], [21, 1]])
    rows = [(100 * c + i, (m + rng.normal(0, 0.3, 2)).tolist(), c) for c, m in enumerate(centres) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>, c int")
    own = {r["k"]: r["cluster"] for r in linkage.complete_linkage(df, "k", "v", clusters=3, most=20).collect()}
    groups = {frozenset(k // 100 for k, c in own.items() if c == x) for x in set(own.values())}
    assert groups == {frozenset({0}), frozenset({1, 3}), frozenset({2})}
    labels = df.select("k", F.col("c").alias("cluster"))
    found = {r["cluster"]: (r["n"], r["silhouette"]) for r in linkage.silhouette(df, labels, "k", "v").collect()}
    v, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    means = np.array([v[c == x].mean(0) for x in range(4)])
    d = np.linalg.norm(v[:, None] - means, axis=2)
    for x in range(4):
        a, b = d[c == x, x], np.delete(d[c == x], x, axis=1).min(1)
        assert found[x] == (60, pytest.approx(((b - a) / np.maximum(a, b)).mean()))
    one = linkage.silhouette(df, df.select("k", F.lit(0).alias("cluster")), "k", "v").first()
    assert one["n"] == 240 and one["silhouette"] is None


# -- wavelets


def test_bank_equals_direct_sums():
    x, scales = rng.normal(size=64), np.array([5.0, 9.0, 16.0])
    t = np.arange(-400, 401)
    for s, row in zip(scales, wavelets.bank(x, scales), strict=True):
        psi = np.exp(2j * np.pi * wavelets.CENTRE * t / s - (t / s) ** 2 / wavelets.BANDWIDTH) / math.sqrt(math.pi * wavelets.BANDWIDTH)
        want = [abs((x * np.conj(psi[400 - b : 464 - b])).sum()) / math.sqrt(s) for b in range(64)]
        assert np.allclose(row, want, atol=0.02 * max(want))


def test_low_pass_gain():
    fs, n = 300.0, 3000
    t = np.arange(n) / fs
    for hertz, want in ((5.0, 1.0), (30.0, 1 / math.sqrt(2)), (60.0, 0.0)):
        out = wavelets.low_pass(np.sin(2 * np.pi * hertz * t), 30.0, fs)
        assert np.abs(out[n // 2 :]).max() == pytest.approx(want, abs=0.02)


def test_planted_chirps_are_recovered(spark):
    fs, n = 100.0, 1500
    t = np.arange(n) / fs
    hertz = 1.0 + t  # 1 to 16 Hz
    phase = 2 * np.pi * np.cumsum(hertz) / fs
    strong = np.where(hertz < 9, 3.0, 0.1) * np.sin(phase) + rng.normal(0, 0.05, n)
    late = np.exp(-(((hertz - 12) / 1.0) ** 2)) * 4 * np.sin(phase)
    rows = [("strong", strong.tolist()), ("late", late.tolist()), ("flat", [1.0] * n), ("short", [1.0, 2.0]), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    found = {r["g"]: r for r in wavelets.chirp_features(df, ["g"], "v", hertz.tolist(), fs, scales=120, widest=256.0, reach=10, average=50).collect()}
    assert found["late"]["frequency"] == pytest.approx(12, abs=0.8) and abs(found["late"]["shift"]) <= 3
    assert found["strong"]["frequency"] < 9.5 and found["strong"]["threshold_frequency"] == pytest.approx(9, abs=1.5)
    assert found["strong"]["power_max"] > found["late"]["power_max"] * 0.3 and 0 < found["strong"]["power_ratio"]
    assert all(found[g]["power_max"] is None for g in ("flat", "short", "none"))


# -- expressions


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", -1.0), (3, None, 2.0)], "i int, `the name` string, x double")
    ask = lambda text, **values: sorted(r["i"] for r in predicates.query(df, text, **values).collect())
    assert ask("i == 2") == [2] and ask("i in [1, 3] and x > 0.6") == [3] and ask("-1 <= x < 1") == [1, 2]
    assert ask("`the name` == 'b' or i == @k", k=3) == [2, 3] and ask("i in @many", many=(1, 2)) == [1, 2]
    assert ask("~(i == 1) & (x > 0)") == [3] and ask("i not in [1]") == [2, 3] and ask("i == [1, 2]") == [1, 2]
    assert ask("not i * 2 - 1 == 3") == [1, 3] and ask("i % 2 == 1") == [1, 3]
    for bad in ("i.size > 1", "len(i) > 1", "__import__('os')", "i in 3", "i < [1]"):
        with pytest.raises((ValueError, KeyError)):
            ask(bad)
    with pytest.raises(KeyError):
        ask("i == @missing")


# -- joins and numbers


def test_asof_equals_a_plain_version(spark, monkeypatch):
    left = [(g, int(t), i) for i, (g, t) in enumerate(zip(rng.choice(["a", "b", "c"], 300, p=[0.9, 0.05, 0.05]), rng.integers(0, 500, 300), strict=True))]
    left += [("a", None, 900), (None, 7, 901), ("new", 5, 902), ("a", -50, 903), ("a", 10_000, 904)]
    right = [(g, int(t), float(v)) for g, t, v in zip(rng.choice(["a", "b"], 80, p=[0.9, 0.1]), rng.integers(100, 400, 80), rng.normal(size=80), strict=True)]
    right += [(None, 5, 1.0), ("a", None, 9.0), ("b", 399, None)]

    def plain(g, t):
        known = [(u, v) for h, u, v in right if h == g and u is not None and t is not None and u <= t]
        if not known:
            return None
        last = max(u for u, _ in known)
        return max((v for u, v in known if u == last and v is not None), default=None)

    a = spark.createDataFrame([(str(g) if g is not None else None, t, i) for g, t, i in left], "g string, t long, i long").repartition(3)
    b = spark.createDataFrame([(str(g) if g is not None else None, t, v) for g, t, v in right], "g string, t long, v double").repartition(3)
    for stretches in (1, 7, 256):
        monkeypatch.setattr(tables, "STRETCHES", stretches)
        found = {r["i"]: r["v"] for r in tables.asof(a, b, ["g"], "t", ["v"]).collect()}
        assert found == {i: plain(g, t) for g, t, i in left}
    assert {r["v"] for r in tables.asof(a, b.filter("false"), ["g"], "t", ["v"]).collect()} == {None}


def test_group_numbers_count_every_key_once(spark):
    rows = [(int(x), str(y)) for x, y in zip(rng.integers(0, 40, 500), rng.integers(0, 9, 500), strict=True)] + [(None, "z"), (None, "z")]
    found = tables.group_numbers(spark.createDataFrame(rows, "a long, b string").repartition(5), ["a", "b"]).collect()
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(found) == len(rows) and {(r["a"], r["b"]): r["group"] for r in found} == {k: i for i, k in enumerate(order)}


def test_random_onsets_are_near_own_ones(spark):
    onsets = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("b", 50.0), ("c", None)], "g string, onset double")
    one, two = (sorted(map(tuple, triggers.random_onsets(d, ["g"], 200, 5.0).select("g", "repeat", "onset").collect())) for d in (onsets, onsets.repartition(4)))
    assert one == two and len(one) == 400 and {g for g, *_ in one} == {"a", "b"}
    own = {"a": (0.0, 100.0), "b": (50.0,)}
    gaps = [min((o - x for x in own[g]), key=abs) for g, _, o in one]
    assert all(-5 <= x < 5 for x in gaps) and min(gaps) < -4 and max(gaps) > 4
    assert 60 < sum(o > 50 for g, _, o in one if g == "a") < 140
    events = spark.createDataFrame([("a", float(t)) for t in range(-10, 111)], "g string, time double")
    met = latency.trigger_windows(events, triggers.random_onsets(onsets, ["g"], 20, 5.0), ["g"], "time", -1.0, 1.0).collect()
    assert met and all(-1 < r["t"] < 1 for r in met)


# -- small helpers


def test_detrend_in_parts_and_tuning(spark):
    x = np.arange(20.0)
    y = np.where(x < 8, 3 * x, 100 - 2 * x)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)], "g string, x double, y double")
    assert all(abs(r["residual"]) < 1e-9 for r in features.detrended_in_parts(df, "y", "x", ["g"], [8.0]).collect())
    rows = spark.createDataFrame([("a", 0, 2.0), ("a", 0, 4.0), ("a", 1, 6.0), ("b", 0, 0.0)], "g string, position long, v double")
    assert sorted(map(tuple, features.tuning(rows, ["g"], "position", "v").collect())) == [("a", 0, "on", 0.5), ("a", 1, "off", 1.0), ("b", 0, "on", None)]


def test_psth_export_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.2), ("a", 1.6), ("b", 0.7)], "g string, t double")
    hist = histograms.psth(rows, "t", 0.5, 2.5, ["g"], start=0.0)
    sources.write_psth(hist, ["g"], f"{tmp_path}/p", 0.5)
    again = sources.read_psth(spark, f"{tmp_path}/p", ["g"])
    assert sorted(map(tuple, again.select("g", "bin", "count").collect())) == sorted(map(tuple, hist.collect()))
    assert {r["bin"]: r["time"] for r in again.collect()} == {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.5}
    assert [r["values"] for r in histograms.stacked(hist, ["g"]).orderBy("g").collect()] == [[1, 0, 0, 1], [0, 1, 0, 0]]


def test_stimulus_subset(spark):
    spikes = spark.createDataFrame([("a", 1, 5)], "recording string, cell_index long, times long")
    cells = spark.createDataFrame([("a", 1, 0), ("a", 1, 1)], "recording string, cell_index long, stimulus_index int")
    stimuli = spark.createDataFrame([("a", 0, "fff"), ("a", 1, "chirp")], "recording string, stimulus_index int, stimulus_name string")
    r = Recordings(spikes, cells, stimuli)
    one = r.stimulus_subset(names=["chirp"])
    assert [x["stimulus_index"] for x in one.frames["stimuli"].collect()] == [1] == [x["stimulus_index"] for x in one.frames["cells"].collect()]
    assert r.stimulus_subset(indices=[0, 1]).frames["cells"].count() == 2 == r.stimulus_subset().frames["stimuli"].count()
    assert r.stimulus_subset(names=["fff"], indices=[1]).frames["stimuli"].isEmpty()


@pytest.mark.parametrize("most", [3, 10_000])
def test_nearest_centroid_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(features, "MOST_LABELS", most)
    v, label = rng.normal(size=(90, 4)), np.r_[np.zeros(20, int), rng.integers(1, 12, 70)]
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (x, c) in enumerate(zip(v, label, strict=True))] + [(99, None, [0.0] * 4)], "k long, label int, v array<double>")
    found = {r["k"]: (r["label"], r["distance"]) for r in features.nearest_centroid(df, "v", "label", 0, "k").collect()}
    names = sorted(set(label) - {0})
    far = np.linalg.norm(v[:20, None] - np.array([v[label == c].mean(0) for c in names]), axis=2)
    assert found.keys() == set(range(20))
    assert all(found[i] == (names[int(far[i].argmin())], pytest.approx(far[i].min())) for i in range(20))
    assert features.nearest_centroid(df.filter("label = 0"), "v", "label", 0, "k").isEmpty()
