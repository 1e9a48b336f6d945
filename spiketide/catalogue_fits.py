"""Registered queries: first spikes, segments, correlations with triggers, spectra, regressions, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _DAILY, _HIST, _STIM, CELL, SPIKES, W, _daily, _trig, query
from .operators import features, histograms, latency, linkage, predicates, regress, segments, signals, tables, triggers, warping, wavelets
from .plans import fixture
from .plans.fixture import table

# -- first spikes after triggers

RESPONSE = [*CELL, "stimulus_index"]
BREAKS, LOW, HIGH, STD = [-6.0, -1.0, 1.0, 6.0], -6.0, 6.0, 2.0
_WINDOWS = _STIM + """,
onsets AS (SELECT recording, stimulus_index, k % logic AS trigger, k // logic AS repeat, (begin_fr + x) / 3600.0::DOUBLE AS onset FROM (SELECT *, unnest(tr) AS x, unnest(range(len(tr))) AS k FROM s)),
windows AS (SELECT recording, cell_index, stimulus_index, trigger, repeat, t FROM (SELECT p.recording, p.cell_index, stimulus_index, trigger, repeat, p.times / 3600.0::DOUBLE - onset AS t FROM spikes p JOIN onsets USING (recording)) WHERE t > -6 AND t < 6)"""
_FITS = _WINDOWS + """,
fits AS (SELECT recording, cell_index, stimulus_index, trigger, [-6.0, -1.0, 1.0, 6.0]::DOUBLE[] AS b, [count(*) FILTER (t < -1) / 25.0::DOUBLE, count(*) FILTER (t >= -1 AND t < 1) / 10.0::DOUBLE, count(*) FILTER (t >= 1) / 25.0::DOUBLE] AS m FROM windows GROUP BY ALL),
own AS (SELECT recording, cell_index, stimulus_index, median(b[list_position(m, list_max(m))]) AS own FROM fits GROUP BY ALL),
mid AS (SELECT median(own) AS start FROM own),
cuts AS (SELECT fits.*, start, arg_min(i, (abs(b[i + 1] - own), i)) OVER (PARTITION BY recording, cell_index, stimulus_index, trigger) AS pos, i FROM fits JOIN own USING (recording, cell_index, stimulus_index), mid, range(4) t(i)),
means AS (SELECT recording, cell_index, stimulus_index, trigger, start, list_avg(m[1:pos]) AS x, list_avg(m[pos + 1:]) AS y FROM cuts WHERE i = 0),
rates AS (SELECT recording, cell_index, stimulus_index, trigger, start, CASE WHEN x <= 0 THEN 1.0 ELSE x END AS before, CASE WHEN y <= 0 THEN 2.2250738585072014e-308 ELSE y END AS after FROM means)"""


def _onsets(spark, d):
    s = fixture.derived(spark, d)
    each = s.select("recording", "stimulus_index", "begin_fr", "stimulus_repeat_logic", F.posexplode("trigger_fr_relative").alias("k", "x"))
    logic = F.col("stimulus_repeat_logic")
    return each.select("recording", "stimulus_index", (F.col("k") % logic).cast("long").alias("trigger"), F.floor(F.col("k") / logic).cast("long").alias("repeat"), ((F.col("begin_fr") + F.col("x")) / 3600.0).alias("onset"))


def _windows(spark, d):
    events = fixture.spikes(spark, d).select("recording", "cell_index", (F.col("times") / 3600.0).alias("times"))
    return latency.trigger_windows(events, _onsets(spark, d), ["recording"], "times", LOW, HIGH).select(*RESPONSE, "trigger", "repeat", "t")


def _fits(windows):
    return latency.segment_rates(windows, RESPONSE, BREAKS, 5)


@query(_WINDOWS + " SELECT recording, cell_index, stimulus_index, trigger, repeat, round(t, 8) AS t FROM windows")
def onset_windows(spark, d):
    return _windows(spark, d).withColumn("t", F.round("t", 8))


@query(_FITS + " SELECT recording, cell_index, stimulus_index, trigger, round(before, 8) AS before, round(after, 8) AS after, start FROM rates")
def response_rates(spark, d):
    return latency.rates(_fits(_windows(spark, d)), RESPONSE).withColumns({"before": F.round("before", 8), "after": F.round("after", 8)})


_FIRST_SPIKES = _FITS + """,
e AS (SELECT *, t + 6 AS c, row_number() OVER (g ORDER BY t) AS i, count(*) OVER g AS n, max(t + 6) OVER g AS cn, min(t) OVER g < 0 AS early FROM windows WINDOW g AS (PARTITION BY recording, cell_index, stimulus_index, trigger, repeat)),
l AS (SELECT e.*, start, CASE WHEN i < n THEN i * ln(before) - before * c + (n - i) * ln(after) - after * (cn - c) END AS joint, CASE WHEN i < n THEN (n - i) * ln(after) - after * (cn - c) END AS two FROM e LEFT JOIN rates USING (recording, cell_index, stimulus_index, trigger)),
p AS (SELECT *, exp(-0.5 * ((t - start) / 2.0) ** 2) * exp(joint - max(joint) OVER (PARTITION BY recording, cell_index, stimulus_index, trigger, repeat)) AS posterior FROM l),
b AS (SELECT *, CASE WHEN early THEN posterior ELSE two END AS score FROM p),
f AS (SELECT recording, cell_index, stimulus_index, trigger, repeat, count(*) AS n, bool_or(early) AS early, arg_max({'t': t, 'p': posterior}, (score, -i)) FILTER (score IS NOT NULL) AS best FROM b GROUP BY ALL)"""


@query(_FIRST_SPIKES + " SELECT recording, cell_index, stimulus_index, trigger, repeat, n, early, round(best.t, 6) AS first_spike, round(best.p, 6) AS posterior FROM f")
def first_spike_posterior(spark, d):
    w = _windows(spark, d)
    found = latency.first_spikes(w, _fits(w), RESPONSE, LOW, STD)
    return found.withColumns({"first_spike": F.round("first_spike", 6), "posterior": F.round("posterior", 6)})


@query(_FIRST_SPIKES + " SELECT recording, cell_index, stimulus_index, trigger, count(*) AS repeats, round(median(best.t), 6) AS median, round(avg(best.p), 6) AS sure FROM f WHERE best IS NOT NULL GROUP BY ALL")
def first_spike_summary(spark, d):
    w = _windows(spark, d)
    found = latency.first_spike_summary(latency.first_spikes(w, _fits(w), RESPONSE, LOW, STD), RESPONSE)
    return found.withColumns({"median": F.round("median", 6), "sure": F.round("sure", 6)})


@query()
def first_spike_fitted(spark, d):
    """The same with breaks and slopes of lines fitted to the cumulative counts of each trigger."""
    w = _windows(spark, d)
    counts = histograms.psth(w, "t", 0.25, HIGH, [*RESPONSE, "trigger"], start=LOW)
    curve = histograms.cumulative(counts, [*RESPONSE, "trigger"]).withColumn("x", LOW + (F.col("bin") + 1) * 0.25)
    fits = tables.stored(segments.piecewise(curve, "x", "cumulative", [*RESPONSE, "trigger"]))
    return latency.first_spikes(w, fits.withColumn("slopes", F.transform("slopes", lambda m: m / 5)), RESPONSE, LOW, STD)


# -- segments


def _curve(spark, d):
    return histograms.cumulative(histograms.psth(_trig(spark, d), "times_triggered", 0.5, 24.0, CELL), CELL)


@query()
def piecewise_fit(spark, d):
    return segments.piecewise(_curve(spark, d), "bin", "cumulative", CELL)


@query(W + """, g AS (SELECT DISTINCT recording, cell_index, i AS bin FROM trig, range(47) t(i)), c AS (SELECT recording, cell_index, least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY ALL),
h AS (SELECT recording, cell_index, bin AS j, sum(coalesce(n, 0)) OVER (PARTITION BY recording, cell_index ORDER BY bin)::DOUBLE AS v FROM g LEFT JOIN c USING (recording, cell_index, bin)),
x AS (SELECT h.*, i, j >= i AS late, 10 ** (CASE WHEN j < i THEN -20 + 20.0::DOUBLE * j / (i - 1) ELSE -20.0::DOUBLE * (j - i) / (46 - i) END) AS w FROM h, range(10, 37) s(i)),
m AS (SELECT *, sum(w * j) OVER k / sum(w) OVER k AS mt, sum(w * v) OVER k / sum(w) OVER k AS mv, sum(w) OVER k AS sw FROM x WINDOW k AS (PARTITION BY recording, cell_index, i, late)),
l AS (SELECT recording, cell_index, i, late, sum(w * (j - mt) * (v - mv)) / sum(w * (j - mt) * (j - mt)) AS s, sum((v - mv) * (v - mv)) AS bb, sum((j - mt) * (v - mv)) AS ab, sum((j - mt) * (j - mt)) AS aa FROM m GROUP BY ALL),
e AS (SELECT recording, cell_index, i, round(sum(bb - 2 * s * ab + s * s * aa), 6) AS sse FROM l GROUP BY ALL)
SELECT recording, cell_index, round(min(sse), 3) AS sse FROM e GROUP BY ALL""")
def two_segment_fit(spark, d):
    return segments.two_segments(_curve(spark, d), "bin", "cumulative", CELL).select(*CELL, F.round("sse", 3).alias("sse"))


# -- signals


@query(_STIM + """, o AS (SELECT recording, (begin_fr + x) // 3600 AS bin, count(*) AS n FROM (SELECT recording, begin_fr, unnest(tr) AS x FROM s) GROUP BY ALL), h AS (SELECT recording, cell_index, times // 3600 AS bin, count(*) AS c FROM spikes GROUP BY ALL),
p AS (SELECT recording, cell_index, lag, sum(c * n) AS p FROM h JOIN o USING (recording), range(18) t(lag) WHERE o.bin = h.bin + lag GROUP BY ALL),
m AS (SELECT recording, cell_index, coalesce(max(p) FILTER (lag < 6), 0) AS a, coalesce(max(p) FILTER (lag >= 11), 0) AS b FROM (SELECT DISTINCT recording, cell_index FROM h) LEFT JOIN p USING (recording, cell_index) GROUP BY ALL)
SELECT recording, cell_index, CAST(a AS BIGINT) AS on, CAST(b AS BIGINT) AS off, CASE WHEN a <> 0 AND b <> 0 THEN round((b - a) / (b + a)::DOUBLE, 8) END AS index FROM m""".replace("AS on,", 'AS "on",'))
def on_off_index(spark, d):
    hour = lambda t: F.floor(t / 3600).cast("long").alias("bin")
    hist = fixture.spikes(spark, d).groupBy(*CELL, hour(F.col("times"))).agg(F.count("*").alias("count"))
    flat = fixture.derived(spark, d).select("recording", "begin_fr", F.explode("trigger_fr_relative").alias("x"))
    onsets = flat.groupBy("recording", hour(F.col("begin_fr") + F.col("x"))).agg(F.count("*").alias("n"))
    return signals.on_off_index(hist, onsets, ["recording"], CELL, 12).withColumn("index", F.round("index", 8))


@query("WITH " + SPIKES + """, h AS (SELECT recording, times // 21600 AS bin, count(*)::DOUBLE AS v FROM spikes GROUP BY ALL), z AS (SELECT recording, max(bin) + 1 AS size FROM h GROUP BY 1),
g AS (SELECT recording, k AS segment FROM z, range(200) t(k) WHERE k * 8 + 16 <= size AND EXISTS (SELECT 1 FROM h WHERE h.recording = z.recording AND h.bin >= k * 8 AND h.bin < k * 8 + 16)),
x AS (SELECT g.recording, segment, j, coalesce(v, 0) AS v FROM g CROSS JOIN range(16) t(j) LEFT JOIN h ON h.recording = g.recording AND h.bin = segment * 8 + j),
w AS (SELECT recording, segment, j, (v - avg(v) OVER (PARTITION BY recording, segment)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM x),
f AS (SELECT recording, segment, k, sum(v * cos(2 * pi() * j * k / 16)) AS re, sum(v * sin(2 * pi() * j * k / 16)) AS im FROM w, range(9) t(k) GROUP BY ALL)
SELECT recording, k, k * 4.0::DOUBLE / 16 AS hertz, round(avg((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / (4.0 * 6.0), 5) AS power FROM f GROUP BY ALL""")
def welch_spectrum(spark, d):
    hist = fixture.spikes(spark, d).groupBy("recording", F.floor(F.col("times") / 21600).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return signals.welch(hist, ["recording"], 4.0, 16).withColumn("power", F.round("power", 5))


_SINE = """, {name} AS (SELECT recording, f, avg(n) AS my, avg(c) AS mc, avg(s) AS ms, avg(n * n) - avg(n) * avg(n) AS yy, avg(c * c) - avg(c) * avg(c) AS cc, avg(s * s) - avg(s) * avg(s) AS ss, avg(c * s) - avg(c) * avg(s) AS cs, avg(n * c) - avg(n) * avg(c) AS yc, avg(n * s) - avg(n) * avg(s) AS ys, count(*) AS m
FROM (SELECT recording, f, n::DOUBLE AS n, cos(2 * pi() * f * day) AS c, sin(2 * pi() * f * day) AS s FROM h JOIN {grid} USING (recording)) GROUP BY ALL),
{name}_ab AS (SELECT *, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS a, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b FROM {name} WHERE cc * ss - cs * cs > 1e-12),
{name}_best AS (SELECT recording, arg_min({{'f': f, 'a': a, 'b': b, 'o': my - a * mc - b * ms, 'e': greatest((yy - a * yc - b * ys) * m, 0)}}, (greatest((yy - a * yc - b * ys) * m, 0), f)) AS x FROM {name}_ab GROUP BY 1)"""


@query(_DAILY + ", g1 AS (SELECT DISTINCT recording, k * 0.02::DOUBLE AS f FROM h, range(1, 25) t(k))" + _SINE.format(name="r1", grid="g1") + ", g2 AS (SELECT recording, x.f - 0.02 + k * 0.005 AS f FROM r1_best, range(9) t(k) WHERE x.f - 0.02 + k * 0.005 > 0)" + _SINE.format(name="r2", grid="g2") + " SELECT recording, round(x.f, 6) AS hertz, round(sqrt(x.a * x.a + x.b * x.b), 4) AS amplitude, round(x.o, 4) AS offset, round(x.e, 3) AS sse FROM r2_best")
def sine_fit(spark, d):
    found = signals.sine_fit(_daily(spark, d), "day", "n", ["recording"], [k * 0.02 for k in range(1, 25)], rounds=1)
    return found.select("recording", F.round("hertz", 6).alias("hertz"), F.round("amplitude", 4).alias("amplitude"), F.round("offset", 4).alias("offset"), F.round("sse", 3).alias("sse"))


# -- regressions and bootstraps


@query("""WITH g AS (SELECT user_id, regr_slope(value, event_id) AS slope, regr_r2(value, event_id) AS r2, regr_count(value, event_id) AS n FROM events GROUP BY 1),
a AS (SELECT *, n - 2 AS nu, atan(sqrt(r2 / (1 - r2))) AS t0 FROM g WHERE n > 2 AND r2 < 1),
q AS (SELECT user_id, slope, r2, n, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * cos(t0 + k * (pi() / 2 - t0) / 2000) ** (nu - 1)) * (pi() / 2 - t0) / 6000 * 2 / exp(lgamma(0.5) + lgamma(nu / 2.0) - lgamma((nu + 1) / 2.0)) AS p FROM a, range(2001) s(k) GROUP BY user_id, slope, r2, n, nu, t0)
SELECT user_id, round(slope, 8) AS slope, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n, round(p, 5) AS p FROM q""")
def ols_p(spark, d):
    found = regress.line(table(spark, d, "events"), "value", "event_id", ["user_id"]).filter("p is not null")
    return found.select("user_id", F.round("slope", 8).alias("slope"), F.round("r2", 6).alias("r2"), "n", F.round("p", 5).alias("p"))


@query()
def lasso(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 16).alias("x"), F.get("embedding", F.lit(63)).alias("y"))
    return regress.lasso_cv(rows, "x", "y", ["label"], "vec_id")


_WEIGHT = " + ".join(f"CAST(u >= {int(p * 2**32)} AS BIGINT)" for p in regress.POISSON)


@query(f"""WITH r AS (SELECT user_id, value, draw, CAST('0x' || substr(md5('1:' || event_id || ':' || (draw // 4)), 8 * (draw % 4) + 1, 8) AS BIGINT) AS u FROM events, range(200) t(draw)),
m AS (SELECT user_id, draw, sum(value * ({_WEIGHT})) / nullif(sum({_WEIGHT}), 0) AS mean FROM r GROUP BY ALL)
SELECT user_id, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m GROUP BY 1""")
def bootstrap_ci(spark, d):
    found = regress.bootstrap(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 200)
    return found.select("user_id", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


# -- nulls, filters, matrices


@query(_WINDOWS + """,
own AS (SELECT recording, stimulus_index, list_sort(list(onset)) AS o FROM onsets GROUP BY ALL),
draws AS (SELECT recording, stimulus_index, r AS repeat, o, md5('1:' || recording || ':' || stimulus_index || ':' || r) AS h FROM own, range(20) t(r)),
null_onsets AS (SELECT recording, stimulus_index, repeat, o[CAST('0x' || substr(h, 1, 8) AS BIGINT) % len(o) + 1] + (CAST('0x' || substr(h, 9, 8) AS BIGINT) / 2147483648.0::DOUBLE - 1.0) * 5.0 AS onset FROM draws)
SELECT recording, cell_index, stimulus_index, repeat, round(t, 8) AS t FROM (SELECT p.recording, p.cell_index, n.stimulus_index, n.repeat, p.times / 3600.0::DOUBLE - n.onset AS t FROM spikes p JOIN null_onsets n USING (recording)) WHERE t > -6 AND t < 6""")
def random_onset_windows(spark, d):
    events = fixture.spikes(spark, d).select("recording", "cell_index", (F.col("times") / 3600.0).alias("times"))
    null = triggers.random_onsets(_onsets(spark, d), ["recording", "stimulus_index"], 20, 5.0)
    return latency.trigger_windows(events, null, ["recording"], "times", LOW, HIGH).select(*RESPONSE, "repeat", F.round("t", 8).alias("t"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus IN ('F', 'P') AND o_totalprice > 2 * 40000 AND o_totalprice <= 150000) OR NOT (o_custkey % 3 <> 0 OR o_orderstatus = 'O')")
def expression_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    text = "(o_orderstatus in @wanted and 2 * 40000 < o_totalprice <= @most) or ~((o_custkey % 3 != 0) | (o_orderstatus == 'O'))"
    return predicates.query(o, text, wanted=["F", "P"], most=150_000).drop("o_custkey")


@query(_DAILY + ", p AS (SELECT *, (day >= 8)::INT + (day >= 17)::INT AS part FROM h), l AS (SELECT recording, part, regr_slope(n, day) AS s, regr_intercept(n, day) AS i FROM p GROUP BY ALL) SELECT recording, day, n, round(n - (s * day + i), 5) AS residual FROM p JOIN l USING (recording, part)")
def detrend_parts(spark, d):
    return features.detrended_in_parts(_daily(spark, d), "n", "day", ["recording"], [8, 17]).withColumn("residual", F.round("residual", 5))


@query(_HIST + " SELECT recording, array_to_string(list(count ORDER BY bin), ',') AS counts FROM h GROUP BY 1")
def psth_matrix(spark, d):
    hist = histograms.psth(_trig(spark, d), "times_triggered", 0.25, 24.0, ["recording"])
    return histograms.stacked(hist, ["recording"]).select("recording", F.array_join(F.col("values").cast("array<string>"), ",").alias("counts"))


@query(W + ", c AS (SELECT recording, cell_index, repeat, trigger, count(*) AS n FROM frames GROUP BY ALL), m AS (SELECT recording, trigger, avg(n) AS m FROM c GROUP BY ALL) SELECT recording, trigger, CASE WHEN trigger % 2 = 0 THEN 'on' ELSE 'off' END AS phase, round(m / max(m) OVER (PARTITION BY recording), 8) AS tuning FROM m")
def tuning_on_off(spark, d):
    counts = _trig(spark, d, seconds=False).groupBy(*CELL, "repeat", "trigger").agg(F.count("*").alias("n"))
    return features.tuning(counts, ["recording"], "trigger", "n").withColumn("tuning", F.round("tuning", 8))


# -- shapes and clusters


@query()
def template_match(spark, d):
    """Of each recording the windows of its counts by quarter days that look like a rise and fall."""
    hist = fixture.spikes(spark, d).groupBy("recording", F.floor(F.col("times") / 21600).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return warping.template_matches(hist, ["recording"], "bin", "count", [0.0, 0.2, 0.7, 1.0, 0.7, 0.2, 0.0], band=2, most=0.9)


@query()
def chirp_power(spark, d):
    hist = histograms.psth(_trig(spark, d), "times_triggered", 0.25, 24.0, [*CELL, "repeat"])
    rows = histograms.stacked(hist, [*CELL, "repeat"])
    return wavelets.chirp_features(rows, [*CELL, "repeat"], "values", [0.1 + 1.4 * k / 94 for k in range(95)], 4.0, scales=60, widest=32.0, reach=20, average=16)


@query()
def warped_clusters(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("v"))
    return warping.warped_kmeans(rows, "vec_id", "v", 3, band=2, rounds=3)[0]


@query()
def linkage_clusters(spark, d):
    return linkage.complete_linkage(table(spark, d, "embeddings"), "vec_id", "embedding", clusters=6, most=128)


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, list(a ORDER BY k) AS mean FROM (SELECT label, k, avg(x) AS a FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS k FROM e) GROUP BY ALL) GROUP BY 1), f AS (SELECT vec_id, e.label, min(list_distance(v, mean)) FILTER (m.label = e.label) AS a, min(list_distance(v, mean)) FILTER (m.label <> e.label) AS b FROM e, m GROUP BY ALL) SELECT CAST(label AS INTEGER) AS cluster, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM f GROUP BY 1")
def silhouette(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", F.col("label").cast("int").alias("cluster"))
    return linkage.silhouette(e, labels, "vec_id", "embedding").withColumn("silhouette", F.round("silhouette", 6))
