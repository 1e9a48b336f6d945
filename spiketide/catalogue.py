"""The registered queries of the library and the same results as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import values
from .operators import align, changepoint, features, histograms, models, predicates, tables, triggers
from .plans import fixture
from .plans.fixture import table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def take(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return take


SPIKES = "spikes AS (SELECT 'rec_' || (user_id % 3) AS recording, user_id AS cell_index, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS times, value FROM events)"
HITS = SPIKES + """,
stim AS (SELECT CAST(i AS INTEGER) AS stimulus_index, i * 518400 AS b, ['fff', 'chirp', 'csteps', 'fff', 'chirp'][i + 1] AS stimulus_name FROM range(5) t(i)),
hits AS (SELECT DISTINCT recording, cell_index, stimulus_index, times, times - b AS rel, least((times - b) // 43200, 9) AS k FROM spikes JOIN stim ON times > b AND times <= b + 432000),
frames AS (SELECT recording, cell_index, stimulus_index, times, rel AS times_relative, k % 2 AS trigger, k // 2 AS repeat, rel - 86400 * (k // 2) AS times_triggered FROM hits),
trig AS (SELECT recording, cell_index, stimulus_index, times / 3600.0::DOUBLE AS times, times_relative / 3600.0::DOUBLE AS times_relative, trigger, repeat, times_triggered / 3600.0::DOUBLE AS times_triggered FROM frames)"""
W = "WITH " + HITS + "\n"


def _trig(spark, d, seconds=True, **options) -> DataFrame:
    return align.triggered(fixture.spikes(spark, d), fixture.stimuli(spark), seconds=seconds, dim_rows=fixture.STIMULUS_ROWS, **options)


# -- alignment


@query(W + "SELECT * FROM trig")
def triggered_spikes(spark, d):
    return _trig(spark, d)


@query(W + "SELECT * FROM frames")
def triggered_frames(spark, d):
    return _trig(spark, d, seconds=False)


@query(W + ", leg AS (SELECT *, (rel - 1) // 43200 AS j FROM hits) SELECT recording, cell_index, stimulus_index, times, rel AS times_relative, j % 2 AS trigger, j // 2 AS repeat, rel - 86400 * (j // 2) AS times_triggered FROM leg")
def triggered_legacy_open_closed(spark, d):
    return _trig(spark, d, seconds=False, legacy=True)


@query(W + """, n AS (SELECT recording, cell_index, stimulus_index, count(*) AS nr FROM hits GROUP BY ALL),
c AS (SELECT recording, cell_index, stimulus_index, CAST(CASE WHEN nr % 2 = 0 THEN nr END AS BIGINT) AS nr, stimulus_name AS label, nr / 4.0::DOUBLE AS qi FROM n JOIN stim USING (stimulus_index) WHERE (cell_index + stimulus_index) % 3 <> 0)
SELECT f.*, CASE WHEN c.cell_index IS NULL THEN 0 ELSE nr END AS nr, coalesce(label, '') AS label, coalesce(qi, 0.0) AS qi FROM frames f LEFT JOIN c USING (recording, cell_index, stimulus_index)""")
def triggered_carry(spark, d):
    t = _trig(spark, d, seconds=False)
    counts = t.groupBy("recording", "cell_index", "stimulus_index").agg(F.count("*").alias("nr")).filter((F.col("cell_index") + F.col("stimulus_index")) % 3 != 0)
    named = counts.join(fixture.stimuli(spark).select("recording", "stimulus_index", F.col("stimulus_name").alias("label")), ["recording", "stimulus_index"])
    cells = named.withColumns({"qi": F.col("nr") / 4.0, "nr": F.when(F.col("nr") % 2 == 0, F.col("nr"))})
    return align.carry(t, cells, ["nr", "label", "qi"])


@query(W + "SELECT * FROM frames WHERE (recording = 'rec_1' AND repeat >= 2) OR stimulus_index IN (0, 3)")
def triggered_filter_dnf(spark, d):
    return predicates.where(_trig(spark, d, seconds=False), [{"recording": "rec_1", "repeat": ">= 2"}, {"stimulus_index": [0, 3]}])


@query("WITH " + HITS + ", n AS (SELECT recording, cell_index, stimulus_index, count(*) AS n FROM spikes JOIN stim ON times > b AND times <= b + 432000 GROUP BY ALL), g AS (SELECT DISTINCT recording, cell_index FROM spikes) SELECT g.recording, g.cell_index, stim.stimulus_index, stimulus_name, coalesce(n, 0) AS nr_of_spikes FROM g CROSS JOIN stim LEFT JOIN n ON n.recording = g.recording AND n.cell_index = g.cell_index AND n.stimulus_index = stim.stimulus_index")
def cell_stimulus_counts(spark, d):
    return align.cell_counts(fixture.spikes(spark, d), fixture.stimuli(spark))


@query("WITH " + SPIKES + ", o AS (SELECT row_number() OVER (ORDER BY recording) - 1 AS k, recording FROM (SELECT DISTINCT recording FROM spikes)) SELECT recording, cell_index, CAST(times AS DOUBLE) - [0.0, 10.0, 20.0][k + 1] AS aligned FROM spikes JOIN o USING (recording)")
def align_on_condition(spark, d):
    rows = fixture.spikes(spark, d).select("recording", "cell_index", F.col("times").cast("double").alias("aligned"))
    return align.align_on_condition(rows, "recording", [0.0, 10.0, 20.0], "aligned")


@query(W + "SELECT recording, cell_index, stimulus_index, times, CAST(k AS BIGINT) AS k FROM hits")
def asof_join(spark, d):
    return _trig(spark, d, seconds=False).select("recording", "cell_index", "stimulus_index", "times", (F.col("repeat") * fixture.LOGIC + F.col("trigger")).alias("k"))


@query("WITH " + SPIKES + ", w AS (SELECT j AS window_id, j * 250000 AS low, j * 250000 + 400000 AS high FROM range(10) t(j)) SELECT window_id, recording, count(*) AS n FROM spikes JOIN w ON times > low AND times < high GROUP BY ALL")
def range_overlap_join(spark, d):
    windows = spark.range(10, numPartitions=1).select(F.col("id").alias("window_id"), (F.col("id") * 250_000).alias("low"), (F.col("id") * 250_000 + 400_000).alias("high"))
    return fixture.spikes(spark, d).join(F.broadcast(windows), (F.col("times") > F.col("low")) & (F.col("times") < F.col("high"))).groupBy("window_id", "recording").agg(F.count("*").alias("n"))


# -- counts and aggregates


@query(W + "SELECT recording, stimulus_index, count(*) AS n FROM frames GROUP BY ALL")
def count_spikes(spark, d):
    return _trig(spark, d, seconds=False).groupBy("recording", "stimulus_index").agg(F.count("*").alias("n"))


@query(W + "SELECT stimulus_index, trigger, count(DISTINCT cell_index) AS cells FROM frames GROUP BY ALL")
def unique_by_condition(spark, d):
    return _trig(spark, d, seconds=False).groupBy("stimulus_index", "trigger").agg(F.countDistinct("cell_index").alias("cells"))


@query(W + "SELECT recording, cell_index, array_to_string(list_sort(list(times_triggered)), ',') AS times FROM frames GROUP BY ALL")
def collect_arrays(spark, d):
    rows = _trig(spark, d, seconds=False).groupBy("recording", "cell_index").agg(F.array_sort(F.collect_list("times_triggered")).alias("a"))
    return rows.select("recording", "cell_index", F.array_join(F.col("a").cast("array<string>"), ",").alias("times"))


@query(W + "SELECT recording, cell_index, count(*) FILTER (times_triggered > 0 AND times_triggered < 6) AS c0, count(*) FILTER (times_triggered > 12 AND times_triggered < 18) AS c1 FROM trig WHERE (times_triggered > 0 AND times_triggered < 6) OR (times_triggered > 12 AND times_triggered < 18) GROUP BY ALL")
def sum_spikes(spark, d):
    return tables.sum_spikes(_trig(spark, d), "times_triggered", [0.0, 12.0], 6.0, ["recording", "cell_index"])


@query("WITH " + SPIKES + " SELECT recording, cell_index, count(*) AS n, round(log10(count(*)), 8) AS log_n FROM spikes GROUP BY ALL")
def log_totals(spark, d):
    return fixture.spikes(spark, d).groupBy("recording", "cell_index").agg(F.count("*").alias("n"), F.round(F.log10(F.count("*")), 8).alias("log_n"))


@query("WITH " + SPIKES + " SELECT recording, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 6) AS sigma, round(median(value), 6) AS median, round(stddev(value), 6) AS sd FROM spikes GROUP BY ALL")
def robust_sigma(spark, d):
    return fixture.spikes(spark, d).groupBy("recording").agg(F.round(tables.robust_sigma("value"), 6).alias("sigma"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev("value"), 6).alias("sd"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY ALL")
def weighted_average(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tables.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("price"))


@query("SELECT l_quantity, round(sum(n) OVER (ORDER BY l_quantity) / sum(n) OVER (), 8) AS ecdf FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def ecdf(spark, d):
    steps = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))  # as many rows as there are values
    return steps.select("l_quantity", F.round(F.sum("n").over(Window.orderBy("l_quantity")) / F.sum("n").over(Window.partitionBy()), 8).alias("ecdf"))


@query("WITH " + SPIKES + " SELECT recording, min_by(cell_index, (value, cell_index)) AS least, max_by(cell_index, (value, cell_index)) AS most FROM spikes GROUP BY ALL")
def arg_extremes(spark, d):
    key = F.struct("value", "cell_index")
    return fixture.spikes(spark, d).groupBy("recording").agg(F.min_by("cell_index", key).alias("least"), F.max_by("cell_index", key).alias("most"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 8) AS share FROM events GROUP BY ALL")
def value_proportions(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("event_type", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query("WITH v AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS dim FROM embeddings) SELECT label, dim, round(avg(v::DOUBLE), 6) AS mean FROM v GROUP BY ALL")
def group_mean_vectors(spark, d):
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    return flat.groupBy("label", F.col("p").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# -- joins and sets


@query("WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS others FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT user_id, clicks, others FROM a FULL JOIN b USING (user_id)")
def align_concat(spark, d):
    e = table(spark, d, "events")
    some = lambda f, name: e.filter(f).groupBy("user_id").agg(F.count("*").alias(name))
    return tables.align_concat([some("event_type = 'click'", "clicks"), some("event_type <> 'click'", "others")], ["user_id"])


@query("SELECT c_custkey, coalesce(n, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey")
def upsert_update(spark, d):
    new = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return tables.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_intersect(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_except(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    return c.join(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s")), "nation", "full_outer")


@query("SELECT n_name, c FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) RIGHT JOIN nation ON c_nationkey = n_nationkey")
def right_outer(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_name", "c")


@query("SELECT user_id, event_type FROM events WHERE value > 50 UNION ALL SELECT user_id, event_type FROM events WHERE value <= 50")
def union_all(spark, d):
    e = table(spark, d, "events")
    return e.filter("value > 50").select("user_id", "event_type").unionByName(e.filter("value <= 50").select("user_id", "event_type"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 90")
def union_distinct(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").union(e.filter("value > 90").select("user_id")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT n_name, r_name, 0 AS n FROM nation CROSS JOIN region")
def cross_grid(spark, d):
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(table(spark, d, "region").select("r_name"))).withColumn("n", F.lit(0))


@query("WITH m AS (SELECT label, list(a ORDER BY k) AS mean FROM (SELECT label, k, avg(v::DOUBLE) AS a FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS k FROM embeddings WHERE label <> 0) GROUP BY 1, 2) GROUP BY 1), t AS (SELECT vec_id, m.label, list_distance(embedding::DOUBLE[], mean) AS dist FROM embeddings e, m WHERE e.label = 0) SELECT vec_id, arg_min(label, dist) AS label, round(min(dist), 6) AS distance FROM t GROUP BY 1")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return features.nearest_centroid(e, "embedding", "label", 0, "vec_id").withColumn("distance", F.round("distance", 6))


# -- histograms

_BIN = "CAST(floor({t} / 0.5) AS BIGINT)"


@query(W + ", g AS (SELECT i AS bin FROM range(47) t(i)), c AS (SELECT least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY 1) SELECT bin, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (bin)")
def psth_global(spark, d):
    return histograms.psth(_trig(spark, d), "times_triggered", 0.5, 24.0)


@query(W + ", g AS (SELECT DISTINCT recording, cell_index, i AS bin FROM trig, range(47) t(i)), c AS (SELECT recording, cell_index, least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY ALL) SELECT recording, cell_index, bin, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (recording, cell_index, bin)")
def psth_by_cell(spark, d):
    return histograms.psth(_trig(spark, d), "times_triggered", 0.5, 24.0, ["recording", "cell_index"])


@query(W + ", g AS (SELECT DISTINCT recording, i AS bin FROM trig, range(47) t(i)), c AS (SELECT recording, least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY ALL), u AS (SELECT recording, count(DISTINCT cell_index) AS cells FROM trig GROUP BY 1) SELECT recording, bin, round(coalesce(n, 0) / cells / 0.5, 6) AS rate FROM g LEFT JOIN c USING (recording, bin) JOIN u USING (recording)")
def psth_rate(spark, d):
    t = _trig(spark, d)
    cells = t.groupBy("recording").agg(F.countDistinct("cell_index").alias("cells"))
    return histograms.psth(t, "times_triggered", 0.5, 24.0, ["recording"]).join(cells, "recording").select("recording", "bin", F.round(F.col("count") / F.col("cells") / 0.5, 6).alias("rate"))


@query(W + ", g AS (SELECT DISTINCT recording, i AS bin FROM trig, range(47) t(i)), c AS (SELECT recording, least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY ALL) SELECT recording, bin, coalesce(n, 0) AS count, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY recording ORDER BY bin) AS BIGINT) AS cumulative FROM g LEFT JOIN c USING (recording, bin)")
def psth_cumulative(spark, d):
    return histograms.cumulative(histograms.psth(_trig(spark, d), "times_triggered", 0.5, 24.0, ["recording"]), ["recording"])


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS count FROM lineitem, r GROUP BY 1")
def hist_autorange(spark, d):
    return histograms.autorange(table(spark, d, "lineitem"), "l_extendedprice", 40)


@query("WITH " + SPIKES + ", b AS (SELECT times // 3600 AS bin, count(*) AS n FROM spikes GROUP BY 1), z AS (SELECT bin, n, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS z FROM b) SELECT bin - 1 AS low, bin + 1 AS high, n, round(z, 6) AS z FROM z WHERE z > 2")
def wave_zscore(spark, d):
    counts = fixture.spikes(spark, d).groupBy(F.floor(F.col("times") / 3600).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return tables.rescaled(counts, "n").filter("z > 2").select((F.col("bin") - 1).alias("low"), (F.col("bin") + 1).alias("high"), "n", F.round("z", 6).alias("z"))


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def hist2d(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("long").alias("x"), F.floor(F.col("l_discount") * 100 / 2).cast("long").alias("y")).agg(F.count("*").alias("n"))


_BINARY = ", h AS (SELECT DISTINCT recording, cell_index, repeat, CAST(floor(times_triggered / 2.0) AS BIGINT) AS index FROM trig WHERE times_triggered < 24 AND repeat < 5), u AS (SELECT DISTINCT recording, cell_index FROM trig), g AS (SELECT recording, cell_index, r AS repeat, i AS index FROM u, range(5) a(r), range(12) b(i)), bin AS (SELECT g.*, CAST(h.index IS NOT NULL AS TINYINT) AS value FROM g LEFT JOIN h USING (recording, cell_index, repeat, index))"
CELL = ["recording", "cell_index"]


def _binary(spark, d):
    return histograms.binary(_trig(spark, d), "times_triggered", 2.0, 24.0, 5, CELL)


@query(W + _BINARY + " SELECT * FROM bin")
def binary_signal(spark, d):
    return _binary(spark, d)


@query(W + ", p AS (SELECT recording, cell_index FROM frames GROUP BY ALL HAVING count(*) = 1 OR count(DISTINCT repeat) = 1) SELECT * FROM frames WHERE (recording, cell_index) NOT IN (SELECT (recording, cell_index) FROM p)")
def reject_single(spark, d):
    return histograms.reject_single(_trig(spark, d, seconds=False), CELL)


@query(W + _BINARY + ", a AS (SELECT recording, cell_index, index, avg(value) AS m, var_pop(value) AS v FROM bin GROUP BY ALL) SELECT recording, cell_index, round(var_pop(m) / nullif(avg(v), 0), 6) AS qi FROM a GROUP BY ALL")
def quality_ratio(spark, d):
    return histograms.variance_ratio(_binary(spark, d), CELL).withColumn("qi", F.round("qi", 6))


_TAPS = ", ".join(repr(t) for t in histograms.kernel(fs=200.0).tolist())
_FINE = ", h AS (SELECT DISTINCT recording, cell_index, repeat, CAST(floor(times_triggered / 0.25) AS BIGINT) AS index FROM trig WHERE times_triggered < 24 AND repeat < 5), u AS (SELECT DISTINCT recording, cell_index FROM trig), g AS (SELECT recording, cell_index, r AS repeat, i AS index FROM u, range(5) a(r), range(96) b(i)), bin AS (SELECT g.*, CAST(h.index IS NOT NULL AS DOUBLE) AS value FROM g LEFT JOIN h USING (recording, cell_index, repeat, index))"


@query(W + _FINE + f", k AS (SELECT unnest([{_TAPS}]::DOUBLE[]) AS w, unnest(range(8)) AS j), c AS (SELECT recording, cell_index, repeat, index - 7 AS index, sum(value * w) AS value FROM (SELECT recording, cell_index, repeat, index + j AS index, value, w FROM bin, k) GROUP BY ALL HAVING count(*) = 8), a AS (SELECT recording, cell_index, index, avg(value) AS m, var_pop(value) AS v FROM c GROUP BY ALL) SELECT recording, cell_index, round(var_pop(m) / nullif(avg(v), 0), 6) AS qi FROM a GROUP BY ALL")
def quality_index(spark, d):
    signal = histograms.binary(_trig(spark, d), "times_triggered", 0.25, 24.0, 5, CELL)
    return histograms.quality_index(signal, CELL, fs=200.0).withColumn("qi", F.round("qi", 6))


_HIST = W + ", g AS (SELECT DISTINCT recording, i AS bin FROM trig, range(95) t(i)), c AS (SELECT recording, least(CAST(floor(times_triggered / 0.25) AS BIGINT), 94) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.75 GROUP BY ALL), h AS (SELECT recording, bin, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (recording, bin))"
_PEAKS = _HIST.replace("WITH ", "WITH RECURSIVE ", 1) + """, t0 AS (SELECT *, CAST(count <> lag(count, 1, count) OVER o AS INTEGER) AS turn, stddev_pop(count) OVER (PARTITION BY recording) AS sd FROM h WINDOW o AS (PARTITION BY recording ORDER BY bin)),
t1 AS (SELECT *, sum(turn) OVER (PARTITION BY recording ORDER BY bin) AS run FROM t0), t2 AS (SELECT recording, run, min(bin) AS a, max(bin) AS b, any_value(count) AS count, any_value(sd) AS sd FROM t1 GROUP BY recording, run),
t3 AS (SELECT *, lag(count) OVER o AS before, lead(count) OVER o AS after FROM t2 WINDOW o AS (PARTITION BY recording ORDER BY run)),
tops AS (SELECT recording, (a + b) // 2 AS bin, count, row_number() OVER (PARTITION BY recording ORDER BY count DESC, a) AS r FROM t3 WHERE count > before AND count > after AND count >= sd),
kept AS (SELECT DISTINCT recording, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS bins FROM h UNION ALL SELECT kept.recording, tops.r, CASE WHEN len(list_filter(bins, lambda x: abs(x - tops.bin) < 5)) > 0 THEN bins ELSE list_append(bins, tops.bin) END FROM kept JOIN tops ON tops.recording = kept.recording AND tops.r = kept.r + 1),
peaks AS (SELECT recording, tops.bin, tops.count FROM (SELECT recording, arg_max(bins, r) AS bins FROM kept GROUP BY 1) JOIN tops USING (recording) WHERE list_contains(bins, tops.bin))"""


def _peaks(spark, d):
    return histograms.local_peaks(histograms.psth(_trig(spark, d), "times_triggered", 0.25, 24.0, ["recording"]), ["recording"], 5)


@query(_PEAKS + " SELECT * FROM peaks")
def peaks_local_max(spark, d):
    return _peaks(spark, d)


# -- intervals and windows

_ISI = "WITH " + SPIKES + ", i AS (SELECT recording, cell_index, times, times - lag(times) OVER (PARTITION BY recording, cell_index ORDER BY times) AS isi FROM spikes)"


@query(_ISI + " SELECT * FROM i WHERE isi > 0")
def isi(spark, d):
    return tables.intervals_between(fixture.spikes(spark, d).select("recording", "cell_index", "times"), "times", CELL)


@query(_ISI + " SELECT recording, CAST(floor(log10(isi) * 4) AS BIGINT) AS bin, count(*) AS n FROM i WHERE isi > 0 GROUP BY ALL")
def isi_hist(spark, d):
    return isi(spark, d).groupBy("recording", F.floor(F.log10("isi") * 4).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH " + SPIKES + ", h AS (SELECT recording, times // 86400 AS day, count(*) AS n FROM spikes GROUP BY ALL) SELECT recording, day, n, round(avg(n) OVER (PARTITION BY recording ORDER BY day ROWS 4 PRECEDING), 6) AS moving FROM h QUALIFY row_number() OVER (PARTITION BY recording ORDER BY day) >= 5")
def moving_average(spark, d):
    return features.moving_average(_daily(spark, d), "n", "day", ["recording"], 5).withColumn("moving", F.round("moving", 6))


def _daily(spark, d):
    return fixture.spikes(spark, d).groupBy("recording", F.floor(F.col("times") / 86400).cast("long").alias("day")).agg(F.count("*").alias("n"))


_DAILY = "WITH " + SPIKES + ", h AS (SELECT recording, times // 86400 AS day, count(*) AS n FROM spikes GROUP BY ALL)"


@query(_DAILY + ", l AS (SELECT recording, regr_slope(n, day) AS s, regr_intercept(n, day) AS i FROM h GROUP BY 1) SELECT recording, day, n, round(n - (s * day + i), 5) AS residual FROM h JOIN l USING (recording)")
def detrend(spark, d):
    return features.detrended(_daily(spark, d), "n", "day", ["recording"]).withColumn("residual", F.round("residual", 5))


@query(_DAILY + " SELECT recording, day, n, round((n - min(n) OVER w) / nullif(max(n) OVER w - min(n) OVER w, 0)::DOUBLE, 6) AS minmax, round((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 6) AS z FROM h WINDOW w AS (PARTITION BY recording)")
def rescaled(spark, d):
    return tables.rescaled(_daily(spark, d), "n", ["recording"]).withColumns({"minmax": F.round("minmax", 6), "z": F.round("z", 6)})


@query(_DAILY + " SELECT a.recording, CAST(l AS BIGINT) AS lag, CAST(sum(a.n * b.n) AS BIGINT) AS product FROM h a, range(10) t(l), h b WHERE a.recording = b.recording AND b.day = a.day + l GROUP BY ALL")
def autocorrelation(spark, d):
    return features.autocorrelation(_daily(spark, d).select("recording", F.col("day").alias("bin"), F.col("n").alias("count")), ["recording"], 10)


@query("WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ffill_bfill(spark, d):
    x = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return x.select("event_id", tables.filled("v", Window.partitionBy("user_id").orderBy("event_id")).alias("v"))


@query("WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, n, (dense_rank() OVER (ORDER BY l_returnflag) - 1) * (SELECT count(DISTINCT l_linestatus) FROM lineitem) + dense_rank() OVER (ORDER BY l_linestatus) - 1 AS idx FROM g")
def map_index(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return tables.linear_index(g, ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS total, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def group_positions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy("o_custkey")).alias("total"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k % 2 = 1")
def every_second(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k % 2 = 1").drop("k")


# -- triggers

_STIM = "WITH " + SPIKES + """,
slots AS (SELECT recording, CAST((times - 1) // 518400 AS INTEGER) AS stimulus_index, ((times - 1) % 518400) // 43200 AS slot, min(times) AS t FROM spikes WHERE times > 0 AND (times - 1) // 518400 < 5 AND (times - 1) % 518400 < 432000 GROUP BY ALL),
every AS (SELECT recording, stimulus_index, list(t ORDER BY t) AS t FROM slots GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT recording, stimulus_index, ['fff', 'chirp', 'csteps', 'fff', 'chirp'][stimulus_index + 1] AS stimulus_name, t[1] AS begin_fr, t[-1] AS end_fr, list_transform(t, lambda x: x - t[1]) AS tr, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS ti, stimulus_index % 3 + 1 AS logic, stimulus_index % 2 + 1 AS sub FROM every)"""
_TRIGGER_TIMES = _STIM + """, e AS (SELECT recording, stimulus_index, logic, sub, len(ti) // logic AS reps, unnest(ti) AS frames, unnest(range(len(ti))) AS k FROM s),
per AS (SELECT recording, stimulus_index, sub, k % logic AS place, avg(frames) AS f1, max(frames) AS f2, min(frames) AS f3 FROM e WHERE k < reps * logic GROUP BY ALL),
tt AS (SELECT recording, stimulus_index, CAST(place * sub + p AS BIGINT) AS position, f1 / sub / 3600.0::DOUBLE AS mean_s, f2 / sub / 3600.0::DOUBLE AS max_s, f3 / sub / 3600.0::DOUBLE AS min_s FROM per, range(2) t(p) WHERE p < sub)"""


@query(_TRIGGER_TIMES + " SELECT recording, stimulus_index, position, round(mean_s, 8) AS mean_s, round(max_s, 8) AS max_s, round(min_s, 8) AS min_s FROM tt")
def trigger_times(spark, d):
    each = [triggers.trigger_times(fixture.derived(spark, d), how).select("recording", "stimulus_index", "position", F.round("seconds", 8).alias(f"{how}_s")) for how in ("mean", "max", "min")]
    return tables.align_concat(each, ["recording", "stimulus_index", "position"])


@query(_TRIGGER_TIMES + " SELECT recording, stimulus_index, round(sum(mean_s), 8) AS duration FROM tt GROUP BY ALL")
def stim_duration(spark, d):
    return triggers.stimulus_duration(fixture.derived(spark, d)).withColumn("duration", F.round("duration", 8))


@query(_STIM + ", e AS (SELECT recording, stimulus_index, logic, unnest(ti) AS frames, unnest(tr[1:len(ti)]) AS onset, unnest(range(len(ti))) AS k FROM s) SELECT recording, stimulus_index, k, onset + min(frames) OVER (PARTITION BY recording, stimulus_index, k % logic) AS trigger_end FROM e")
def find_ends(spark, d):
    return triggers.find_ends(fixture.derived(spark, d))


@query(_STIM + " SELECT recording, stimulus_index, CAST((len(tr) - 1) // logic AS BIGINT) AS nr_repeats FROM s")
def nr_repeats(spark, d):
    return triggers.repeats(fixture.derived(spark, d)).select("recording", "stimulus_index", "nr_repeats")


@query(_STIM + ", e AS (SELECT recording, stimulus_index, flatten(list_transform(range(1, len(tr) + 1), lambda i: CASE WHEN i = len(tr) THEN [tr[i]] ELSE [tr[i], (tr[i] + tr[i + 1]) // 2] END)) AS f FROM s) SELECT recording, stimulus_index, unnest(range(len(f))) AS k, unnest(f) AS frame FROM e")
def split_triggers(spark, d):
    s = fixture.derived(spark, d).select("recording", "stimulus_index", F.posexplode(triggers.split_triggers(F.col("trigger_fr_relative"), 1)).alias("k", "frame"))
    return s.withColumn("k", F.col("k").cast("long"))


@query(_STIM + " SELECT recording, stimulus_index, unnest(range(0, end_fr - begin_fr, 7200)) AS frame FROM s")
def add_trigger_interval(spark, d):
    return fixture.derived(spark, d).select("recording", "stimulus_index", F.explode(triggers.regular_triggers(F.col("end_fr") - F.col("begin_fr"), F.lit(7200))).alias("frame"))


@query(_PEAKS + """, slots AS (SELECT recording, ((times - 1) % 518400) // 43200 AS slot, min(times) AS t FROM spikes WHERE times > 0 AND times <= 432000 GROUP BY ALL),
iv AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY t) - 1 AS position, (lead(t) OVER (PARTITION BY recording ORDER BY t) - t) / 43200.0::DOUBLE AS seconds FROM slots),
st AS (SELECT recording, position, round_even(coalesce(sum(seconds) OVER (PARTITION BY recording ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0) AS start FROM iv WHERE seconds IS NOT NULL),
own AS (SELECT p.recording, p.bin, any_value(count) AS count, arg_min(position, (abs(p.bin * 0.25 - start), position)) AS position FROM peaks p JOIN st USING (recording) GROUP BY p.recording, p.bin)
SELECT st.recording, CAST(st.position AS BIGINT) AS position, coalesce(height, 0) AS height FROM st LEFT JOIN (SELECT recording, position, arg_max(count, bin) AS height FROM own GROUP BY ALL) USING (recording, position)""")
def response_peaks(spark, d):
    first = fixture.derived(spark, d).filter("stimulus_index = 0")
    onsets = first.select("recording", F.posexplode(F.transform("trigger_int", lambda x: x / F.lit(43_200.0))).alias("position", "seconds")).withColumn("position", F.col("position").cast("long"))
    return histograms.peak_heights(_peaks(spark, d), onsets, ["recording"], 0.25)


@query(W + "SELECT repeat, CASE WHEN repeat < 4 THEN ['dark', 'light'][repeat % 2 + 1] ELSE '' END AS label, count(*) AS n FROM frames GROUP BY ALL")
def repeat_category(spark, d):
    return _trig(spark, d, seconds=False).groupBy("repeat", triggers.category(F.col("repeat"), ["dark", "light"], 2).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id // 16 AS slot, CAST(max(value * 100) AS BIGINT) AS voltage FROM events GROUP BY 1")
def downsample_max(spark, d):
    channel = table(spark, d, "events").select(F.col("event_id").alias("frame"), (F.col("value") * 100).alias("voltage"))
    return triggers.downsample(channel, 16).select("slot", F.bround("voltage").cast("long").alias("voltage"))


@query("""WITH c AS (SELECT user_id, event_id AS frame, value AS v FROM events), h AS (SELECT *, CAST(v > (min(v) OVER p + max(v) OVER p) / 2 AS INTEGER) AS high, min(frame) OVER p AS f0, max(frame) OVER p AS f1 FROM c WINDOW p AS (PARTITION BY user_id)),
t AS (SELECT *, CAST(high <> coalesce(lag(high) OVER o, -1) AS INTEGER) AS turn FROM h WINDOW o AS (PARTITION BY user_id ORDER BY frame)), i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM t)
SELECT user_id, min(frame) AS frame, count(*) AS width FROM i WHERE high = 1 GROUP BY user_id, island HAVING count(*) >= 2 AND min(frame) > any_value(f0) AND max(frame) < any_value(f1)""")
def trigger_detect(spark, d):
    channel = table(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), F.col("value").alias("voltage"))
    return triggers.detect(channel, ["user_id"])


# -- change points and first spikes

_POST = W + """, e AS (SELECT recording, cell_index, times_triggered AS t, row_number() OVER (PARTITION BY recording, cell_index ORDER BY times_triggered) AS i, count(*) OVER (PARTITION BY recording, cell_index) AS n, max(times_triggered) OVER (PARTITION BY recording, cell_index) AS tn FROM trig),
l AS (SELECT *, i * ln(0.5) - 0.5 * t + (n - i) * ln(2.0) - 2.0 * (tn - t) AS l FROM e WHERE i < n), w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY recording, cell_index)) AS w FROM l),
p AS (SELECT recording, cell_index, t AS candidate, w / sum(w) OVER (PARTITION BY recording, cell_index) AS posterior FROM w)"""


def _posterior(spark, d):
    return changepoint.posterior(_trig(spark, d), CELL, "times_triggered", 0.5, 2.0)


@query(_POST + " SELECT recording, cell_index, candidate, round(posterior, 6) AS posterior FROM p")
def changepoint_posterior(spark, d):
    return _posterior(spark, d).withColumn("posterior", F.round("posterior", 6))


@query(_POST + ", c AS (SELECT *, round(sum(posterior) OVER (PARTITION BY recording, cell_index ORDER BY candidate ROWS UNBOUNDED PRECEDING), 9) AS cdf FROM p) SELECT recording, cell_index, coalesce(min(candidate) FILTER (cdf >= 0.025), max(candidate)) AS low, coalesce(min(candidate) FILTER (cdf >= 0.975), max(candidate)) AS high FROM c GROUP BY ALL")
def credible_interval(spark, d):
    return changepoint.credible_interval(_posterior(spark, d), CELL)


@query(W + ", w AS (SELECT recording, cell_index, times_triggered AS t, times_triggered - lag(times_triggered, 1, 0) OVER (PARTITION BY recording, cell_index ORDER BY times_triggered) AS x FROM trig) SELECT recording, cell_index, min(t) AS change FROM w WHERE 2 * exp(-2 * x) / (2 * exp(-2 * x) + 0.1 * exp(-0.1 * x)) > 0.9 GROUP BY ALL")
def single_rate_changepoint(spark, d):
    return changepoint.single_rate(_trig(spark, d), CELL, "times_triggered", 2.0, 0.1, 0.9)


_FIRST = W + ", f AS (SELECT recording, cell_index, trigger, repeat, min(times_triggered) AS first_spike, count(*) AS spikes FROM trig WHERE times_triggered > 1 AND times_triggered < 20 GROUP BY ALL)"


def _first(spark, d):
    return changepoint.first_spikes(_trig(spark, d), [*CELL, "trigger", "repeat"], "times_triggered", 1.0, 20.0)


@query(_FIRST + " SELECT * FROM f")
def first_spike(spark, d):
    return _first(spark, d)


@query(_FIRST + " SELECT recording, cell_index, trigger, round(median(first_spike), 6) AS median, round(avg(first_spike), 6) AS mean, count(*) AS n FROM f GROUP BY ALL")
def first_spike_stats(spark, d):
    return _first(spark, d).groupBy(*CELL, "trigger").agg(F.round(F.median("first_spike"), 6).alias("median"), F.round(F.avg("first_spike"), 6).alias("mean"), F.count("*").alias("n"))


# -- features

_ANGLES = "WITH a AS (SELECT user_id, (event_id % 8) * 45 AS angle, value AS w FROM events), s AS (SELECT user_id, sum(w * cos(radians(angle))) AS x, sum(w * sin(radians(angle))) AS y, sum(w) AS n FROM a GROUP BY 1)"


def _angles(spark, d):
    return table(spark, d, "events").select("user_id", ((F.col("event_id") % 8) * 45).alias("angle"), F.col("value").alias("w"))


@query(_ANGLES + " SELECT user_id, round(sqrt(x * x + y * y) / n, 5) AS magnitude FROM s")
def direction_vector(spark, d):
    return features.direction_vector(_angles(spark, d), "angle", "w", ["user_id"]).select("user_id", F.round("magnitude", 5).alias("magnitude"))


@query(_ANGLES + ", r AS (SELECT user_id, n, n * least(1.0, sqrt(x * x + y * y) / n * (radians(22.5) / sin(radians(22.5)))) AS big FROM s) SELECT user_id, round(big * big / n, 4) AS z, round(exp(sqrt(1 + 4 * n + 4 * (n * n - big * big)) - (1 + 2 * n)), 4) AS p FROM r")
def circular_rayleigh(spark, d):
    return features.rayleigh(_angles(spark, d), "angle", "w", ["user_id"], 45).select("user_id", F.round("z", 4).alias("z"), F.round("p", 4).alias("p"))


_ON = W + ", c AS (SELECT recording, cell_index, count(*) FILTER (trigger = 0) AS on_count, count(*) FILTER (trigger = 1) AS off_count FROM frames GROUP BY ALL)"


@query(_ON + " SELECT recording, cell_index, coalesce((on_count - off_count) / nullif(on_count + off_count, 0), 0.0) AS polarity FROM c")
def polarity_index(spark, d):
    wide = _trig(spark, d, seconds=False).groupBy(*CELL).agg(F.count(F.when(F.col("trigger") == 0, 1)).alias("on"), F.count(F.when(F.col("trigger") == 1, 1)).alias("off"))
    return wide.select(*CELL, features.polarity(F.col("on"), F.col("off")).alias("polarity"))


@query("SELECT vec_id, round((s - 2 * m) / s, 5) AS narrowness FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)")
def tuning_narrowness(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(features.narrowness(F.col("embedding").cast("array<double>")), 5).alias("narrowness"))


@query(_DAILY + ", e AS (SELECT recording, day // 7 AS epoch, day % 7 AS pos, n FROM h) SELECT recording, epoch, max(n) AS maxima, arg_max(pos, n * 100 - pos) AS argmax, avg(CAST(n = 0 AS INTEGER)) AS sparsity, median(n) AS median, CAST(sum(n) AS BIGINT) AS total, round(sum(CASE WHEN pos < 3 THEN n ELSE 0 END) / sum(n), 6) AS transience FROM e GROUP BY ALL")
def epoch_features(spark, d):
    hist = _daily(spark, d).select("recording", F.col("day").alias("bin"), F.col("n").alias("count"))
    return features.epochs(hist, ["recording"], 7).withColumn("transience", F.round("transience", 6))


@query("WITH g AS (SELECT p_partkey, 350 + 5 * p_size AS peak, 300 + p_partkey % 400 AS wavelength FROM part), x AS (SELECT *, peak / wavelength::DOUBLE AS x, 0.8795 + 0.0459 * exp(-((peak - 300) ** 2) / 11940) AS a FROM g) SELECT p_partkey, CAST(peak AS INTEGER) AS peak, CAST(wavelength AS BIGINT) AS wavelength, round(1 / (exp(69.7 * (a - x)) + exp(28 * (0.922 - x)) + exp(-14.9 * (1.104 - x)) + 0.674) + 0.26 * exp(-(((wavelength - (189 + 0.315 * peak)) / (-40.5 + 0.195 * peak)) ** 2)), 6) AS absorption FROM x")
def opsin_template(spark, d):
    p = table(spark, d, "part").select("p_partkey", (350 + 5 * F.col("p_size")).cast("int").alias("peak"), (300 + F.col("p_partkey") % 400).cast("long").alias("wavelength"))
    return p.withColumn("absorption", F.round(values.opsin(F.col("wavelength"), F.col("peak")), 6))


@query(W + ", c AS (SELECT recording, trigger, count(*) AS n FROM trig WHERE times_triggered % 12 < 6 GROUP BY ALL) SELECT recording, trigger, round(n / max(n) OVER (PARTITION BY recording)::DOUBLE, 6) AS tuning FROM c")
def tuning_curve(spark, d):
    c = _trig(spark, d).filter(F.col("times_triggered") % 12 < 6).groupBy("recording", "trigger").agg(F.count("*").alias("n"))
    return c.select("recording", "trigger", F.round(F.col("n") / F.max("n").over(Window.partitionBy("recording")), 6).alias("tuning"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def ols_r2(spark, d):
    return features.ols(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_tax), 6) AS pt FROM lineitem")
def corr_matrix(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("qp"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("qd"), F.round(F.corr("l_extendedprice", "l_tax"), 6).alias("pt"))


@query("WITH n AS (SELECT count(*) AS n, stddev(value) AS sd FROM events), a AS (SELECT CAST(round(value / (100.0 / 50)) AS BIGINT) AS pos, count(*) AS c FROM events GROUP BY 1), k AS (SELECT i, sum(c * exp(-0.5 * ((i - pos) / (sd * power(n, -0.2) / 2.0)) ** 2)) AS d FROM a, n, range(51) t(i) GROUP BY 1) SELECT i * 2.0 AS x, round(d / max(d) OVER (), 6) AS density FROM k")
def kde_scott(spark, d):
    return features.density(table(spark, d, "events"), "value", 51, 0.0, 100.0).select(F.col("x"), F.round("density", 6).alias("density"))


# -- values, lists and reshaping


@query("SELECT event_id, round(0.5 * exp((event_id % 81) / 10.0::DOUBLE / 8.0 * ln(8.0 / 0.5)), 8) AS frequency FROM events")
def chirp_signal(spark, d):
    return table(spark, d, "events").select("event_id", F.round(values.chirp_frequency(F.col("event_id") % 81 / 10.0, 8.0, 0.5, 8.0), 8).alias("frequency"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INTEGER) AS number FROM part")
def regex_wavelength(spark, d):
    return table(spark, d, "part").select("p_partkey", values.wavelength(F.col("p_brand")).alias("number"))


@query("WITH h AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS c FROM part) SELECT p_partkey, round(0.2126 * CAST(CAST('0x' || substr(c, 1, 2) AS INTEGER) AS DOUBLE) + 0.7152 * CAST(CAST('0x' || substr(c, 3, 2) AS INTEGER) AS DOUBLE) + 0.0722 * CAST(CAST('0x' || substr(c, 5, 2) AS INTEGER) AS DOUBLE), 4) AS luminance FROM h")
def hex_luminance(spark, d):
    colour = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6))
    return table(spark, d, "part").select("p_partkey", F.round(values.luminance(colour), 4).alias("luminance"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round(1000.0 / p_size, 6) WHEN 1 THEN round(1.0 / p_size, 6) END AS hertz FROM part")
def time_string_freq(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("h")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", F.round(values.frequency_of(text), 6).alias("hertz"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS level FROM lineitem")
def when_chain(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(q < 10, "low").when(q < 30, "mid").otherwise("high").alias("level"))


@query("SELECT event_id, CASE WHEN value > 50 THEN value ELSE 0.0 END AS v FROM events")
def null_nan_fill(spark, d):
    v = F.when(F.col("value") > 50, F.col("value")).otherwise(F.when(F.col("event_id") % 2 == 0, float("nan")))
    return table(spark, d, "events").select("event_id", F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0)).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS mean, greatest(l_discount, l_tax) AS most FROM lineitem")
def horizontal_stats(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(values.mean_of(F.col("l_discount"), F.col("l_tax")), 6).alias("mean"), F.greatest("l_discount", "l_tax").alias("most"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top, round((embedding[2]::DOUBLE - embedding[1]::DOUBLE), 6) AS d0, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def list_functions(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", values.arg_max(e).alias("top"), F.round(F.get(values.differences(e), F.lit(0)), 6).alias("d0"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT s_suppkey, unnest(['bal', 'nation']) AS name, unnest([s_acctbal, s_nationkey::DOUBLE]) AS v FROM supplier")
def unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["bal", "nation"], "name", "v")


@query("SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v, unnest(list_reverse(embedding))::DOUBLE AS r FROM embeddings")
def explode_zip(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("v"), F.reverse("embedding").alias("r"))).alias("k", "z"))
    return z.select("vec_id", F.col("k").cast("long").alias("k"), F.col("z.v").cast("double").alias("v"), F.col("z.r").cast("double").alias("r"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_custkey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in "FOP"])


@query("SELECT event_id, (CAST(floor((event_id * 7 % 360 + 22.5) / 45) AS BIGINT) * 45) % 360 AS sector FROM events")
def angle_sector(spark, d):
    return table(spark, d, "events").select("event_id", values.sector(F.col("event_id") * 7 % 360).alias("sector"))


# -- selections, as-of joins, weighted histograms


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('F', 'P')")
def column_filters(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return predicates.chosen(o, {"o_totalprice": (50_000, 150_000), "o_orderstatus": ["F", "P"], "o_orderkey": "all"})


@query(_STIM + " SELECT recording, stimulus_index, stimulus_name FROM s WHERE stimulus_name IN ('fff', 'chirp')")
def stimulus_names(spark, d):
    return triggers.indices_of(fixture.derived(spark, d), ["fff", "chirp"])


@query("WITH r AS (SELECT user_id, event_id AS t, value AS v FROM events WHERE event_type = 'click') SELECT e.event_id, e.user_id, r.v FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.event_id >= r.t")
def asof_events(spark, d):
    e = table(spark, d, "events")
    right = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("t"), F.col("value").alias("v"))
    left = e.filter("event_type <> 'click'").select("event_id", "user_id", F.col("event_id").alias("t"))
    return tables.asof(left, right, ["user_id"], "t", ["v"]).select("event_id", "user_id", "v")


@query("WITH k AS (SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events), g AS (SELECT user_id, unnest(range(50, 1000, 100))::DOUBLE AS x FROM (SELECT DISTINCT user_id FROM events)), j AS (SELECT g.user_id, g.x, a.x AS ax, a.y AS ay FROM g ASOF LEFT JOIN k a ON g.user_id = a.user_id AND g.x >= a.x), b AS (SELECT j.*, k.x AS bx, k.y AS by_ FROM j ASOF LEFT JOIN k ON j.user_id = k.user_id AND j.x <= k.x) SELECT user_id, x, round(CASE WHEN ax = x THEN ay ELSE ay + (by_ - ay) * (x - ax) / (bx - ax) END, 6) AS y FROM b")
def interp_linear(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("x"), F.col("value").alias("y"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(50), F.lit(950), F.lit(100))).alias("x"))
    return tables.interpolated(e, grid, ["user_id"], "x", "y").withColumn("y", F.round("y", 6))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority, o_custkey) - 1 AS place FROM orders")
def ngroup(spark, d):
    return tables.group_numbers(table(spark, d, "orders"), ["o_orderpriority", "o_custkey"], "place").select("o_orderkey", "place")


@query("SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5('1:' || event_id), 1, 8) AS BIGINT) < 1288490188")
def random_sample(spark, d):
    return tables.sampled(table(spark, d, "events"), "event_id", 0.3).select("event_id", "user_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' ELSE event_type END AS event_type FROM events")
def value_replace(spark, d):
    return tables.replaced(table(spark, d, "events"), "event_type", {"click": "on", "view": "off"}).select("event_id", "event_type")


@query("SELECT user_id, min(g) AS width FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) WHERE g > 0 GROUP BY 1")
def infer_bin(spark, d):
    return tables.bin_width(table(spark, d, "events"), "event_id", ["user_id"])


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_fill_join(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return tables.left_filled(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], 0)


@query("SELECT l_returnflag, CAST(floor(l_quantity / 5.0) AS BIGINT) AS bin, round(sum(l_tax) / any_value(t) / 5.0, 8) AS weight FROM lineitem JOIN (SELECT l_returnflag, sum(l_tax) AS t FROM lineitem WHERE l_quantity < 50 GROUP BY 1) USING (l_returnflag) WHERE l_quantity < 50 GROUP BY ALL")
def psth_weighted(spark, d):
    return histograms.weighted(table(spark, d, "lineitem"), "l_quantity", "l_tax", 5.0, 50.0, ["l_returnflag"], density=True).withColumn("weight", F.round("weight", 8))


@query("SELECT l_returnflag, l_quantity, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(w) OVER (PARTITION BY l_returnflag), 8) AS ecdf FROM (SELECT l_returnflag, l_quantity, sum(l_discount) AS w FROM lineitem GROUP BY ALL)")
def ecdf_weighted(spark, d):
    return histograms.weighted_ecdf(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]).withColumn("ecdf", F.round("ecdf", 8))


@query("WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT user_id, CAST(coalesce(least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS BIGINT) AS bin, count(*) AS count FROM events JOIN r USING (user_id) GROUP BY ALL")
def hist_by_group(spark, d):
    return histograms.group_ranges(table(spark, d, "events"), "value", 10, ["user_id"])


@query(W + ", g AS (SELECT DISTINCT recording, cell_index, repeat, i AS bin FROM trig, range(47) t(i)), c AS (SELECT recording, cell_index, repeat, least(CAST(floor(times_triggered / 0.5) AS BIGINT), 46) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 23.5 GROUP BY ALL) SELECT recording, cell_index, repeat, bin, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (recording, cell_index, repeat, bin)")
def psth_by_cell_repeat(spark, d):
    return histograms.psth(_trig(spark, d), "times_triggered", 0.5, 24.0, [*CELL, "repeat"])


@query(W + ", g AS (SELECT DISTINCT recording, cell_index, i AS bin FROM trig, range(24) t(i)), c AS (SELECT recording, cell_index, least(CAST(floor(times_triggered) AS BIGINT), 23) AS bin, count(*) AS n FROM trig WHERE times_triggered <= 24 GROUP BY ALL), h AS (SELECT recording, cell_index, bin, coalesce(n, 0)::DOUBLE AS n FROM g LEFT JOIN c USING (recording, cell_index, bin)), x AS (SELECT a.recording, a.cell_index, a.n AS x, b.n AS y FROM h a JOIN h b ON a.recording = b.recording AND a.cell_index = b.cell_index AND b.bin = a.bin + 12 AND a.bin < 12), m AS (SELECT recording, cell_index, count(*) * sum(x * y) - sum(x) * sum(y) AS c, count(*) * sum(x * x) - sum(x) * sum(x) AS vx, count(*) * sum(y * y) - sum(y) * sum(y) AS vy FROM x GROUP BY ALL) SELECT recording, cell_index, round(c / nullif(sqrt(vx * vy), 0), 6) AS r FROM m")
def on_off_correlation(spark, d):
    hist = histograms.psth(_trig(spark, d), "times_triggered", 1.0, 25.0, CELL)
    return features.halves_correlation(hist, CELL, 12).withColumn("r", F.round("r", 6))


@query("WITH c(a) AS (VALUES ('l_discount'), ('l_extendedprice'), ('l_quantity')), p AS (SELECT x.a, y.a AS b FROM c x, c y), m AS (SELECT corr(l_discount, l_extendedprice) AS de, corr(l_discount, l_quantity) AS dq, corr(l_extendedprice, l_quantity) AS eq, count(*) AS n FROM lineitem) SELECT a, b, round(CASE WHEN a = b THEN 1.0 WHEN 'l_quantity' NOT IN (a, b) THEN de WHEN 'l_extendedprice' NOT IN (a, b) THEN dq ELSE eq END, 6) AS r, n FROM p, m")
def corr_long(spark, d):
    return features.correlations(table(spark, d, "lineitem"), ["l_discount", "l_extendedprice", "l_quantity"]).withColumn("r", F.round("r", 6))


@query("SELECT l_returnflag, round(corr(l_discount, l_tax), 6) AS r, round(avg(abs(l_discount - l_tax)) / sqrt(2), 6) AS off_diagonal FROM lineitem GROUP BY 1")
def diagonal(spark, d):
    return features.diagonal_offset(table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"]).select("l_returnflag", F.round("r", 6).alias("r"), F.round("offset", 6).alias("off_diagonal"))


@query(W + "SELECT recording, cell_index, times, CAST([1, 0][trigger + 1] AS INTEGER) AS trigger FROM frames")
def trigger_remap(spark, d):
    return triggers.remapped(_trig(spark, d, seconds=False).select("recording", "cell_index", "times", "trigger"), "trigger", [1, 0])


@query(_STIM + ", g AS (SELECT recording, stimulus_index, end_fr - begin_fr AS n FROM s), f AS (SELECT recording, stimulus_index, n, CAST(ceil(unnest(range(CAST(ceil(n * 0.17::DOUBLE / 3600.0) AS BIGINT) + 1)) * 3600.0::DOUBLE / 0.17::DOUBLE) AS BIGINT) AS frame FROM g) SELECT recording, stimulus_index, frame FROM f WHERE frame < n")
def refresh_grid(spark, d):
    return fixture.derived(spark, d).select("recording", "stimulus_index", F.explode(triggers.refresh_grid(F.col("end_fr") - F.col("begin_fr"), F.col("sampling_freq"), 0.17)).alias("frame"))


@query("SELECT vec_id, min(v) AS least, arg_min(k, v) AS at_sample FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings) GROUP BY 1")
def waveform_minimum(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    return z.groupBy("vec_id").agg(F.min("v").alias("least"), F.min_by("k", F.struct("v", "k")).cast("long").alias("at_sample"))


@query("SELECT event_id, round(sin(2 * pi() * (0.5 * k / 60.0 + 0.59375 * (k / 60.0) * (k / 60.0))), 6) AS v, round(0.5 + 1.1875 * (k / 60.0), 6) AS hertz FROM (SELECT event_id, (event_id % 480)::DOUBLE AS k FROM events)")
def chirp_generator(spark, d):
    t = F.col("event_id") % 480 / 60.0
    return table(spark, d, "events").select("event_id", F.round(values.chirp_value(t, 8.0, 0.5, 10.0), 6).alias("v"), F.round(0.5 + 1.1875 * t, 6).alias("hertz"))


@query("SELECT event_id, CAST(list_position(g, list_min(g)) - 1 AS BIGINT) AS trigger FROM (SELECT event_id, list_transform([0.0, 12.0, 30.0, 75.0], lambda p: abs(value - p::DOUBLE)) AS g FROM events)")
def nearest_trigger(spark, d):
    return table(spark, d, "events").select("event_id", values.nearest(F.col("value"), [0.0, 12.0, 30.0, 75.0]).alias("trigger"))


@query("WITH s AS (SELECT user_id, list_sort(list(event_id::DOUBLE)) AS s FROM events GROUP BY 1), f AS (SELECT user_id, flatten(list_transform(s, lambda x: [x, x + 0.5])) AS f FROM s), c AS (SELECT user_id, list_append(f, f[-1] + (f[-1] - f[1]) / (len(f) - 1)) AS f FROM f) SELECT user_id, array_to_string(list_transform(f, lambda x: CAST(floor(x * 4.0) AS BIGINT)), ',') AS frames FROM c")
def interleaved_triggers(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("event_id").cast("double"))).alias("s"))
    frames = triggers.interleaved(F.col("s"), F.transform("s", lambda x: x + 0.5), 4.0)
    return s.select("user_id", F.array_join(frames.cast("array<string>"), ",").alias("frames"))


@query(_STIM + " SELECT recording, stimulus_index, begin_fr AS begin, end_fr AS end, tr[1] AS first, array_to_string(tr[2:], ',') AS rest, logic FROM s")
def stimulus_info(spark, d):
    return triggers.stimulus_info(fixture.derived(spark, d)).withColumn("rest", F.array_join(F.col("rest").cast("array<string>"), ","))


@query("WITH g AS (SELECT user_id, CAST(draw AS INTEGER) AS draw, CAST('0x' || substr(md5('1:' || user_id || ':' || draw), 1, 8) AS BIGINT) % 1000 AS at FROM (SELECT DISTINCT user_id FROM events), range(20) t(draw)), e AS (SELECT user_id, event_id AS next FROM events) SELECT g.user_id, g.draw, g.at, CASE WHEN e.next - g.at <= 400 THEN e.next - g.at END AS latency FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.at <= e.next")
def random_trigger_null(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return triggers.random_latencies(e, e, ["user_id"], "event_id", 20, 0, 1000, 400)


@query("WITH s AS (SELECT s_suppkey, i, [0.0, 2.0, 5.0][i + 1]::DOUBLE AS s, [s_nationkey::DOUBLE, 1.5::DOUBLE, -1.0::DOUBLE][i + 1] AS m, [2.0, 3.0, 4.0][i + 1]::DOUBLE AS l, [0.0::DOUBLE, 2.0 * s_nationkey, 2.0 * s_nationkey + 4.5][i + 1]::DOUBLE AS b FROM supplier, range(3) t(i)) SELECT s_suppkey, CAST(i AS INTEGER) AS segment, CAST(k AS INTEGER) AS point, round(s + l * k / 9, 6) AS x, round(b + m * (l * k / 9), 6) AS y FROM s, range(10) p(k)")
def line_data(spark, d):
    arrays = {"s": [0.0, 2.0, 5.0], "m": [F.col("s_nationkey").cast("double"), 1.5, -1.0], "l": [2.0, 3.0, 4.0]}
    lines = table(spark, d, "supplier").select("s_suppkey", *[F.array(*[v if isinstance(v, Column) else F.lit(v) for v in a]).alias(n) for n, a in arrays.items()])
    return changepoint.line_data(lines, ["s_suppkey"], "s", "m", "l").withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(W + "SELECT * FROM frames WHERE (recording = 'rec_0' AND stimulus_index = 1) OR (recording = 'rec_2' AND stimulus_index IN (0, 3))")
def selection_triples(spark, d):
    return predicates.where(_trig(spark, d, seconds=False), predicates.triples(["rec_0", "rec_2"], [1, [0, 3]], "all"))


@query("SELECT user_id, median(value) AS middle, max(event_id) AS last, round(stddev_samp(value), 6) AS spread FROM events GROUP BY 1")
def pluggable_aggregates(spark, d):
    measures = {"middle": (F.median, "value"), "last": (F.max, "event_id"), "spread": (lambda c: F.round(F.stddev_samp(c), 6), "value")}
    return tables.summarised(table(spark, d, "events"), ["user_id"], measures)


@query("WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS r, count(*) AS n FROM r GROUP BY 1")
def spearman(spark, d):
    return features.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", F.round("r", 6))


def _pairs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 2).cast("long").alias("cell"), (F.col("vec_id") % 2).alias("part"), F.col("embedding").cast("array<double>").alias("v"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings) SELECT a.vec_id // 2 AS cell, round(sqrt(sum((b.v - a.v) * (b.v - a.v))), 5) AS length FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.k = b.k WHERE a.vec_id % 2 = 0 GROUP BY 1")
def shift_vectors(spark, d):
    return features.shift_vectors(_pairs(spark, d), "cell", "part", "v", 0, 1).select("cell", F.round("length", 5).alias("length"))


@query("WITH e AS (SELECT label, vec_id % 2 AS part, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings), m AS (SELECT label, k, avg(v) FILTER (part = 1) - avg(v) FILTER (part = 0) AS g FROM e GROUP BY ALL) SELECT label, round(sqrt(sum(g * g)), 6) AS distance FROM m GROUP BY 1")
def centroid_distance(spark, d):
    return features.centroid_distance(_pairs(spark, d), "part", "v", 0, 1, ["label"]).withColumn("distance", F.round("distance", 6))


# -- models: rows only


@query()
def classify_relationship(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.dayofyear("o_orderdate").alias("x"), F.col("o_totalprice").alias("y"), F.lit(1.0).alias("w"))
    return models.relationship(rows, "x", "y", "w", ["o_custkey"])


@query()
def poisson_train(spark, d):
    segments = table(spark, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"), F.lit(0.5).alias("rate"))
    return models.poisson_trains(segments, ["user_id"])


@query()
def dtw_template(spark, d):
    return models.template_distance(table(spark, d, "embeddings"), "vec_id", "embedding", [0.1 * (i % 8) for i in range(64)])


@query()
def pca(spark, d):
    return models.components(table(spark, d, "embeddings"), "vec_id", "embedding", 4)


@query()
def group_pca(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return models.group_components(e, "vec_id", ["a", "b"], 4, 2)


@query()
def kmeans(spark, d):
    return models.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def gmm_bic(spark, d):
    return models.mixture_bic(models.components(table(spark, d, "embeddings"), "vec_id", "embedding", 4), "scores", [2, 3])


from . import catalogue_fits, catalogue_sessions  # noqa: E402, F401  register more queries
