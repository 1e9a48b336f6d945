import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spiketide.functions import values
from spiketide.operators import align, changepoint, features, histograms, models, predicates, tables, triggers


def stimuli(spark, triggers, logic=2, recordings=("a",), begin=100):
    rows = [(r, 0, "fff", begin, begin + triggers[-1], triggers, [b - a for a, b in zip(triggers, triggers[1:], strict=False)], logic, 1, 10.0) for r in recordings]
    return spark.createDataFrame(rows, "recording string, stimulus_index int, stimulus_name string, begin_fr long, end_fr long, trigger_fr_relative array<long>, trigger_int array<long>, stimulus_repeat_logic int, stimulus_repeat_sublogic int, sampling_freq double")


def spikes(spark, times, recording="a", cell=1):
    return spark.createDataFrame([(recording, cell, t) for t in times], "recording string, cell_index long, times long")


def places(df, logic=2):
    return {r["times"]: r["repeat"] * logic + r["trigger"] for r in df.collect()}


def test_trigger_edges(spark):
    s, stim = spikes(spark, [101, 110, 111, 120, 139, 140]), stimuli(spark, [0, 10, 20, 30, 40])
    assert [k for _, k in sorted(places(align.triggered(s, stim, seconds=False)).items())] == [0, 1, 1, 2, 3, 3]
    assert [k for _, k in sorted(places(align.triggered(s, stim, seconds=False, legacy=True)).items())] == [0, 0, 1, 1, 3, 3]


def test_window_edges_and_copies(spark):
    s = spikes(spark, [100, 101, 101, 140, 141])
    assert sorted(r["times"] for r in align.triggered(s, stimuli(spark, [0, 20, 40]), seconds=False).collect()) == [101, 140]


@pytest.mark.parametrize("logic", [1, 2, 3])
def test_partial_repeats(spark, logic):
    found = align.triggered(spikes(spark, range(101, 151)), stimuli(spark, [0, 10, 20, 30, 40, 50], logic), seconds=False).collect()
    assert len(found) == 50 and max(r["repeat"] for r in found) == 4 // logic
    assert all(0 <= r["times_triggered"] <= 10 * logic for r in found)


def test_bucketed_join_equals_broadcast(spark):
    s = spikes(spark, range(90, 150)).union(spikes(spark, range(100, 130), "b"))
    stim = stimuli(spark, [0, 10, 20, 30, 40], recordings=("a", "b"))
    one = sorted(map(tuple, align.triggered(s, stim).collect()))
    assert one == sorted(map(tuple, align.triggered(s, stim, dim_rows=10**9).collect()))


def test_recordings_are_independent(spark):
    a, b = spikes(spark, [105, 115]), spikes(spark, [106], "b")
    stim = stimuli(spark, [0, 10, 20], recordings=("a", "b"))
    both = sorted(map(tuple, align.triggered(a.union(b), stim).collect()))
    assert both == sorted([*map(tuple, align.triggered(a, stim).collect()), *map(tuple, align.triggered(b, stim).collect())])


@pytest.mark.parametrize("width", [0.05, 0.1, 0.3])
def test_psth_equals_numpy(spark, width):
    edges = np.arange(0, 3, width)
    t = np.concatenate([edges, edges + 1e-9, np.random.default_rng(0).uniform(-1, 4, 500)])
    found = histograms.psth(spark.createDataFrame([(float(x),) for x in t], "t double"), "t", width, 3.0).orderBy("bin").collect()
    assert [r["count"] for r in found] == np.histogram(t, edges)[0].tolist()


def test_psth_of_groups(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 9.0)], "g string, t double")
    found = histograms.psth(df, "t", 0.5, 2.0, ["g"]).collect()
    assert len(found) == 6 and sum(r["count"] for r in found if r["g"] == "b") == 0


def test_conditions(spark):
    df = spark.createDataFrame([("20px_20Hz", 0.2), ("fff", -1.0), ("chirp", 5.0)], "name string, qi double")
    ask = lambda *b: sorted(r["name"] for r in predicates.where(df, list(b)).collect())
    assert ask({"name": "20px_20Hz"}) == ["20px_20Hz"]
    assert ask({"qi": "> -1.5", "name": ["fff", "chirp"]}) == ["chirp", "fff"]
    assert ask({"qi": ">= 5"}, {"name": "!= chirp"}) == ["20px_20Hz", "chirp", "fff"]
    assert ask({"qi": "> 1e-1"}) == ["20px_20Hz", "chirp"] and len(ask()) == 3


def test_binary_and_quality(spark):
    df = spark.createDataFrame([("a", r, t) for r in range(4) for t in (0.1, 0.5)] + [("b", 0, 0.1)], "cell string, repeat long, t double")
    signal = histograms.binary(df, "t", 0.01, 1.0, 4, ["cell"])
    assert signal.count() == 2 * 4 * 100 and signal.filter("value = 1").count() == 9
    assert {r["cell"] for r in histograms.reject_single(df, ["cell"]).collect()} == {"a"}
    rng = np.random.default_rng(0)
    rows = [("c", r, i, int(rng.random() < 0.2)) for r in range(5) for i in range(200)]
    got = histograms.quality_index(spark.createDataFrame(rows, "cell string, repeat long, index long, value int"), ["cell"]).first()["qi"]
    m = np.array([[v for _, q, _, v in rows if q == r] for r in range(5)], float)
    smooth = np.array([np.convolve(x, histograms.kernel(), "valid") for x in m])
    assert got == pytest.approx(smooth.mean(0).var() / smooth.var(0).mean()) and histograms.kernel().sum() == pytest.approx(1)


def test_peaks_keep_their_distance(spark):
    counts = [0, 5, 0, 9, 0, 0, 0, 0, 7, 0]
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(counts)], "g string, bin long, count long")
    assert [r["bin"] for r in histograms.local_peaks(df, ["g"], 3).orderBy("bin").collect()] == [3, 8]


def test_upsert(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    right = spark.createDataFrame([(1, None), (2, "z"), (3, "w")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(left, right, ["k"], ["v"]).collect())) == [(1, "x"), (2, "z")]


def test_trigger_arrays(spark):
    stim = stimuli(spark, [0, 10, 25, 35, 50])
    times = {r["position"]: r["seconds"] for r in triggers.trigger_times(stim).collect()}
    assert times == {0: 1.0, 1: 1.5} and triggers.trigger_times(stim, "min").count() == 2
    assert stim.select(triggers.split_triggers(F.col("trigger_fr_relative"), 1)).first()[0] == [0, 5, 10, 17, 25, 30, 35, 42, 50]
    assert [r["trigger_end"] for r in triggers.find_ends(stim).orderBy("k").collect()] == [10, 25, 35, 50]
    assert triggers.repeats(stim).first()["nr_repeats"] == 2


def test_trigger_detection(spark):
    volts = [9, 0, 9, 0, 9, 9, 9, 0, 9, 9]
    channel = spark.createDataFrame([("a", i, v) for i, v in enumerate(volts)], "c string, frame long, voltage int")
    assert [tuple(r) for r in triggers.detect(channel, ["c"]).collect()] == [("a", 4, 3)]


def test_change_point(spark):
    t = np.cumsum(np.r_[np.full(10, 2.0), np.full(30, 0.1)])
    df = spark.createDataFrame([("a", float(x)) for x in t], "g string, t double")
    post = changepoint.posterior(df, ["g"], "t", 0.5, 10.0)
    i, n = np.arange(1, len(t)), len(t)
    log = i * np.log(0.5) - 0.5 * t[:-1] + (n - i) * np.log(10.0) - 10.0 * (t[-1] - t[:-1])
    want = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    got = [r["posterior"] for r in post.orderBy("candidate").collect()]
    assert np.allclose(got, want) and sum(got) == pytest.approx(1)
    ci = changepoint.credible_interval(post, ["g"]).first()
    assert ci["low"] <= t[9] <= ci["high"]


def test_values(spark):
    df = spark.createDataFrame([("#f0a", "LED_560_on", "200ms"), ("ffffff", "dark", "x")], "c string, n string, p string")
    found = df.select(values.luminance(F.col("c")).alias("l"), values.wavelength(F.col("n")).alias("w"), values.frequency_of(F.col("p")).alias("f")).collect()
    assert found[0]["l"] == pytest.approx(0.2126 * 255 + 0.0722 * 170) and found[1]["l"] == pytest.approx(255)
    assert [r["w"] for r in found] == [560, None] and found[0]["f"] == pytest.approx(5) and found[1]["f"] is None
    assert values.frequency("4us") == pytest.approx(250_000)
    with pytest.raises(ValueError):
        values.frequency("5h")


def test_direction_uses_own_angles(spark):
    df = spark.createDataFrame([("a", 90, 3.0), ("a", 270, 1.0)], "g string, angle int, w double")
    r = features.direction_vector(df, "angle", "w", ["g"]).first()
    assert r["magnitude"] == pytest.approx(0.5) and r["direction"] == pytest.approx(90)
    assert df.select(values.sector(F.lit(350)).alias("s")).first()["s"] == 0


def test_fill(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "i int, v int")
    assert [r[0] for r in df.select(tables.filled("v", Window.partitionBy().orderBy("i"))).collect()] == [5, 5, 5, 7]


def test_fits(spark):
    x = np.arange(60.0)
    y = np.where(x < 30, x, 30 + 5 * (x - 30))
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")
    kinds = models.relationship(df.withColumn("w", F.lit(1.0)), "x", "y", "w", ["g"]).first()
    assert kinds["kind"] == "linear" and kinds["r2"] > 0.8
    assert models.warped(np.array([0.0, 1, 2]), np.array([0.0, 1, 1, 2]), 2) == 0


def test_seeded_draws_repeat(spark):
    seg = spark.createDataFrame([("a", 0.0, 10.0, 2.0), ("b", 0.0, 10.0, 0.0)], "g string, start double, end double, rate double")
    one, two = (sorted(map(tuple, models.poisson_trains(seg, ["g"]).collect())) for _ in range(2))
    assert one == two and len(one) > 5 and {g for g, _ in one} == {"a"}


def test_density_takes_values_beyond_the_points(spark):
    v = np.concatenate([np.linspace(0, 100, 201), np.linspace(101, 130, 300)])
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.arange(0, 101, 2.0)
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1)
    found = sorted(map(tuple, features.density(spark.createDataFrame([(float(i),) for i in v], "v double"), "v", 51, 0.0, 100.0).collect()))
    assert np.allclose([d for _, d in found], want / want.max(), atol=0.01)


def test_spearman_ties_and_nulls(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 2.0, None), ("a", 3.0, 9.0), ("a", 4.0, 5.0), ("b", 1.0, 1.0)]
    found = {r["g"]: r for r in features.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    want = np.corrcoef([1.5, 1.5, 3, 4], [1.5, 1.5, 4, 3])[0, 1]
    assert found["a"]["r"] == pytest.approx(want) and found["a"]["n"] == 4 and found["b"]["n"] == 1


def test_random_latencies_repeat_and_stay_in_reach(spark):
    e = spark.createDataFrame([("a", 10), ("a", 50), ("b", 99)], "g string, t long")
    one, two = (sorted(map(tuple, triggers.random_latencies(e, e, ["g"], "t", 30, 0, 100, 20).collect())) for _ in range(2))
    assert one == two and len(one) == 60 and all(0 <= r[2] < 100 for r in one)
    times = {"a": [10, 50], "b": [99]}
    for g, _, at, latency in one:
        later = [t - at for t in times[g] if 0 <= t - at <= 20]
        assert latency == (min(later) if later else None)


def test_interleaved_and_nearest(spark):
    df = spark.createDataFrame([([0.0, 2.0], [1.0, 4.0], 6.0), ([], [], None)], "s array<double>, e array<double>, x double")
    rows = df.select(triggers.interleaved(F.col("s"), F.col("e"), 3.0).alias("f"), values.nearest(F.col("x"), [5.0, 7.0, 6.5]).alias("n")).collect()
    assert rows[0]["f"] == [0, 3, 6, 12, 16] and rows[0]["n"] == 2 and rows[1]["f"] is None and rows[1]["n"] is None


def test_triples():
    assert predicates.triples(["a", "b"], 1, "all") == [{"recording": "a", "stimulus_index": 1}, {"recording": "b", "stimulus_index": 1}]
    with pytest.raises(ValueError):
        predicates.triples(["a", "b"], [1, 2, 3], "all")


def test_shift_vectors_need_both_conditions(spark):
    df = spark.createDataFrame([(1, "x", [0.0, 0.0]), (1, "y", [3.0, 4.0]), (2, "x", [1.0, 1.0])], "k long, c string, v array<double>")
    assert [(r["k"], r["shift"], r["length"]) for r in features.shift_vectors(df, "k", "c", "v", "x", "y").collect()] == [(1, [3.0, 4.0], 5.0)]
    assert features.centroid_distance(df, "c", "v", "x", "y", []).first()["distance"] == pytest.approx(math.hypot(2.5, 3.5))
