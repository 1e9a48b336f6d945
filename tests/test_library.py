"""Queries against their SQL, sessions, sources and streams."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spiketide import catalogue
from spiketide.plans import fixture
from spiketide.plans.session import Recordings
from spiketide.sources import tables as sources
from spiketide.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9) or (a != a and b != b)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(map(tuple, got.select(*want.columns).collect()), key=str)
    b = sorted(want.fetchall(), key=str)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _recordings(spark):
    spikes = fixture.spikes(spark, SF).select("recording", "cell_index", "times")
    stimuli = fixture.stimuli(spark)
    return Recordings(spikes, catalogue.queries()["cell_stimulus_counts"](spark, SF), stimuli)


def test_session(spark, tmp_path):
    r = _recordings(spark)
    every = r.triggered().count()
    assert every == catalogue.queries()["triggered_spikes"](spark, SF).count()
    assert sum(r.chunk(1, i).count() for i in range(3)) == every
    r.set_column(spark.createDataFrame([("rec_0", 0, 0.5)], "recording string, cell_index long, qi double"), "qi")
    assert r.triggered([{"qi": "> 0.3"}], carry=["qi"]).select("cell_index", "qi").distinct().collect() == [(0, 0.5)]
    r.mark(r.frames["cells"].filter("cell_index = 0"), "kind", "in", "out")
    assert {x[0] for x in r.frames["cells"].filter("kind = 'in'").select("cell_index").collect()} == {0}
    r.save(f"{tmp_path}/s")
    again = Recordings.load(spark, f"{tmp_path}/s")
    assert again.analyse("all").count() == every
    with pytest.raises(ValueError):
        r.add(again)
    with pytest.raises(ValueError):
        r.delete("cells")
    assert r.remove("rec_0").triggered().filter("recording = 'rec_0'").count() == 0
    broken = Recordings(r.spikes, r.frames["cells"], r.frames["stimuli"].filter("stimulus_index > 0"))
    with pytest.raises(ValueError):
        broken.triggered()


def test_sources(spark, tmp_path):
    np.array([5, 1, 2, 7, 3], "<i2").tofile(f"{tmp_path}/x.dat")
    assert [r["voltage"] for r in sources.read(spark, f"{tmp_path}/x.dat").orderBy("frame").collect()] == [5, 1, 2, 7, 3]
    assert [r["voltage"] for r in sources.raw_channel(spark, f"{tmp_path}/x.dat", True).orderBy("frame").collect()] == [5, 7]
    with pytest.raises(NotImplementedError):
        sources.read(spark, "x.h5")
    df = sources.from_arrays(spark.createDataFrame([(1, [3, 4]), (2, [])], "cell_index int, spiketimes array<int>"), "r")
    sources.write_spikes(df, f"{tmp_path}/p")
    assert sorted(tuple(r) for r in sources.spikes(spark, f"{tmp_path}/p").collect()) == [("r", 1, 3), ("r", 1, 4)]
    assert sources.modernised(spark.createDataFrame([(1,)], "Begin_Fr int")).columns == ["begin_fr"]


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def finish(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    counts = finish(live.window_counts(stream(), "ts", ["event_type"], "1 day"), "w", "complete")
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/in").count()
    runs = finish(live.bursts(stream(), "ts", ["user_id"], "1 hour"), "b", "complete")
    assert runs.agg(F.sum("n")).first()[0] == 1000
    spikes = stream().select(F.concat(F.lit("rec_"), F.col("user_id") % 3).alias("recording"), F.col("user_id").alias("cell_index"), (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))).alias("us"))
    aligned = live.triggered(spikes.select("recording", "cell_index", F.floor(F.col("us") / 1_000_000).alias("times")), fixture.stimuli(spark), fixture.STIMULUS_ROWS)
    assert finish(aligned, "t", "append").count() == catalogue.queries()["triggered_spikes"](spark, SF).count()
