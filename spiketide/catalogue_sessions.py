"""Registered queries: sessions of recordings, streams, sources and further signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue import _BINARY, _POST, CELL, SPIKES, W, _binary, _trig, query
from .operators import changepoint, histograms, models, tables
from .plans import fixture
from .plans.fixture import table
from .plans.session import Recordings
from .sources import tables as sources
from .streaming import live

# -- sessions

_CELLS = ", cells AS (SELECT g.recording, g.cell_index, stim.stimulus_index, stimulus_name, (SELECT count(*) FROM hits h WHERE h.recording = g.recording AND h.cell_index = g.cell_index AND h.stimulus_index = stim.stimulus_index) AS n FROM (SELECT DISTINCT recording, cell_index FROM spikes) g, stim)"


def _recordings(spark, d) -> Recordings:
    t = _trig(spark, d, seconds=False)
    counts = t.groupBy("recording", "cell_index", "stimulus_index").agg(F.count("*").alias("n"))
    stimuli = fixture.stimuli(spark)
    grid = fixture.spikes(spark, d).select(*CELL).distinct().join(stimuli.select("recording", "stimulus_index", "stimulus_name"), "recording")
    cells = tables.left_filled(grid, counts, ["recording", "cell_index", "stimulus_index"], 0)
    return Recordings(fixture.spikes(spark, d).select("recording", "cell_index", "times"), cells, stimuli)


@query(W + _CELLS + "SELECT f.* FROM frames f JOIN cells c USING (recording, cell_index, stimulus_index) WHERE (n > 8 AND stimulus_name = 'fff') OR f.recording = 'rec_2'")
def session_triggered(spark, d):
    return _recordings(spark, d).triggered([{"n": "> 8", "stimulus_name": "fff"}, {"recording": "rec_2"}], seconds=False)


@query(W + _CELLS + "SELECT f.*, CASE WHEN n > 8 THEN 'rich' ELSE 'poor' END AS kind FROM frames f JOIN cells c USING (recording, cell_index, stimulus_index) WHERE stimulus_index IN (1, 4)")
def session_view(spark, d):
    """A view of cells marks the others, and its mark is carried to the spikes of a subset of stimuli."""
    r = _recordings(spark, d)
    r.frames["cells"] = r.frames["cells"].withColumn("kind", F.when(F.col("n") > 8, "rich").otherwise("poor"))
    return r.stimulus_subset(names=["chirp"]).triggered(seconds=False, carry=["kind"])


@query(W + ", v AS (SELECT DISTINCT recording, cell_index FROM frames WHERE repeat = 4 AND trigger = 1) SELECT c.recording, c.cell_index, c.stimulus_index, CASE WHEN v.cell_index IS NULL THEN 'out' ELSE 'in' END AS late FROM (SELECT DISTINCT recording, cell_index, stimulus_index FROM spikes, stim) c LEFT JOIN v USING (recording, cell_index)")
def session_mark(spark, d):
    r = _recordings(spark, d)
    r.mark(_trig(spark, d, seconds=False).filter("repeat = 4 and trigger = 1"), "late", "in", "out")
    return r.frames["cells"].select("recording", "cell_index", "stimulus_index", "late")


@query(W + "SELECT * FROM frames WHERE recording = 'rec_1'")
def session_chunk(spark, d):
    return _recordings(spark, d).chunk(1, 1, seconds=False)


@query(W + "SELECT recording, cell_index, stimulus_index, count(*) AS n FROM frames WHERE recording <> 'rec_0' GROUP BY ALL")
def session_add_remove(spark, d):
    r = _recordings(spark, d)
    other = Recordings(*[df.filter("recording = 'rec_1'") for df in (r.spikes, r.frames["cells"], r.frames["stimuli"])])
    both = r.remove("rec_0").remove("rec_1").add(other)
    return both.triggered(seconds=False).groupBy("recording", "cell_index", "stimulus_index").agg(F.count("*").alias("n"))


@query(W + ", q AS (SELECT recording, cell_index, round(avg(value), 6) AS mean FROM spikes WHERE cell_index % 2 = 0 GROUP BY ALL) SELECT c.recording, c.cell_index, c.stimulus_index, mean FROM (SELECT DISTINCT recording, cell_index, stimulus_index FROM spikes, stim) c LEFT JOIN q USING (recording, cell_index)")
def session_column(spark, d):
    r = _recordings(spark, d)
    r.set_column(fixture.spikes(spark, d).filter("cell_index % 2 = 0").groupBy(*CELL).agg(F.round(F.avg("value"), 6).alias("mean")), "mean")
    return r.frames["cells"].select("recording", "cell_index", "stimulus_index", "mean")


@query(W + "SELECT recording, stimulus_index, count(*) AS n FROM frames GROUP BY ALL")
def session_saved(spark, d):
    """A session is written to the shared folder and loaded again before it is analysed."""
    path = f"{tables.shared_folder(spark)}/session-{uuid.uuid4().hex}"
    _recordings(spark, d).save(path)
    return Recordings.load(spark, path).analyse("all", seconds=False).groupBy("recording", "stimulus_index").agg(F.count("*").alias("n"))


# -- sources


@query("WITH " + SPIKES + " SELECT recording, cell_index, times FROM spikes WHERE cell_index % 3 = 1")
def spikes_written(spark, d):
    """Spikes written by recording and read again; a waveform column stays where it is."""
    path = f"{tables.shared_folder(spark)}/spikes-{uuid.uuid4().hex}"
    sources.write_spikes(fixture.spikes(spark, d).filter("cell_index % 3 = 1").withColumnRenamed("value", "waveform"), path)
    return sources.spikes(spark, path)


@query("WITH " + SPIKES + " SELECT recording, cell_index, count(*) AS nr_of_spikes, min(times) AS begin_fr FROM spikes GROUP BY ALL")
def old_columns(spark, d):
    old = fixture.spikes(spark, d).groupBy("recording", F.col("cell_index").alias("Cell index")).agg(F.count("*").alias("Nr of Spikes"), F.min("times").alias("Begin_Fr"))
    return sources.modernised(old)


@query("SELECT user_id AS cell_index, round(avg(value), 6) AS centres_x, round(avg(event_id), 4) AS centres_y FROM events GROUP BY 1")
def cell_centres(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cell_index"), F.col("value").alias("x"), F.col("event_id").alias("y"))
    return sources.centres(e).select("cell_index", F.round("centres_x", 6).alias("centres_x"), F.round("centres_y", 4).alias("centres_y"))


@query("WITH " + SPIKES + " SELECT recording, count(*) AS n, min(times) AS first FROM spikes GROUP BY ALL")
def read_by_suffix(spark, d):
    """The events as csv, read again by the suffix of the path."""
    path = f"{tables.shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    fixture.spikes(spark, d).select("recording", "cell_index", "times").write.csv(path, header=True)
    return sources.read(spark, path).groupBy("recording").agg(F.count("*").alias("n"), F.min(F.col("times").cast("long")).alias("first"))


# -- streams


def _folder(spark) -> str:
    return f"{tables.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    stream = live.follow(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.landed(live.window_counts(stream, "ts", ["event_type"], "1 day"), _folder(spark), "complete").select("event_type", F.to_date("start").alias("day"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_bursts(spark, d):
    stream = live.follow(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.landed(live.bursts(stream, "ts", ["user_id"], "6 hours"), _folder(spark), "complete").select("user_id", F.unix_micros("start").alias("start"), "n")


@query(W + "SELECT recording, cell_index, stimulus_index, count(*) AS n, CAST(sum(times_triggered) AS BIGINT) AS total FROM frames GROUP BY ALL")
def stream_triggered(spark, d):
    events = live.follow(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    spikes = events.select(F.concat(F.lit("rec_"), F.col("user_id") % fixture.RECORDINGS).alias("recording"), F.col("user_id").alias("cell_index"), F.floor(micros / 1_000_000).alias("times"))
    rows = live.landed(live.triggered(spikes, fixture.stimuli(spark), fixture.STIMULUS_ROWS), _folder(spark))
    return rows.groupBy("recording", "cell_index", "stimulus_index").agg(F.count("*").alias("n"), F.round(F.sum(F.col("times_triggered") * fixture.FS)).cast("long").alias("total"))


# -- signals


@query(W + _BINARY + " SELECT recording, cell_index, repeat, string_agg(CAST(value AS VARCHAR), '' ORDER BY index) AS bits FROM bin GROUP BY ALL")
def binary_arrays(spark, d):
    rows = histograms.binary_arrays(_binary(spark, d), CELL)
    return rows.select(*CELL, "repeat", F.array_join(F.col("values").cast("array<string>"), "").alias("bits"))


@query(W + _BINARY + ", k AS (SELECT unnest([0.25, 0.5, 0.25]::DOUBLE[]) AS w, unnest(range(3)) AS j) SELECT recording, cell_index, repeat, index - 2 AS index, sum(value * w) AS value FROM (SELECT recording, cell_index, repeat, index + j AS index, value, w FROM bin, k) GROUP BY ALL HAVING count(*) = 3")
def smoothed_repeats(spark, d):
    return histograms.smoothed(_binary(spark, d), CELL, [0.25, 0.5, 0.25])


@query(_POST + ", q AS (SELECT *, exp(-0.5 * ((candidate - 9) / 3.0) ** 2) * posterior AS w FROM p) SELECT recording, cell_index, candidate, round(w / nullif(sum(w) OVER (PARTITION BY recording, cell_index), 0), 6) AS posterior FROM q")
def changepoint_prior(spark, d):
    return changepoint.posterior(_trig(spark, d), CELL, "times_triggered", 0.5, 2.0, tau=9.0, std=3.0).withColumn("posterior", F.round("posterior", 6))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings), s AS (SELECT vec_id, k, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM v WINDOW w AS (PARTITION BY k)) SELECT vec_id, round(sum(z * z), 5) AS energy FROM s GROUP BY 1")
def scaled_vectors(spark, d):
    scaled = models.standardised(table(spark, d, "embeddings"), "vec_id", "embedding")
    return scaled.select("vec_id", F.round(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x), 5).alias("energy"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT v AS t FROM e WHERE vec_id = 0) SELECT vec_id, round(list_distance(v, t), 6) AS euclidean, round(1 - list_cosine_similarity(v, t), 6) AS cosine FROM e, t")
def vector_distances(spark, d):
    e = table(spark, d, "embeddings")
    return models.distances_from(e, "vec_id", "embedding", e.filter("vec_id = 0")).select("vec_id", F.round("euclidean", 6).alias("euclidean"), F.round("cosine", 6).alias("cosine"))
