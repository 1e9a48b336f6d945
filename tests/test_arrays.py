"""Array files by ranges of rows, and sorter folders made of them."""

import numpy as np
import pytest

from spiketide.sources import arrays
from spiketide.sources import tables as sources

rng = np.random.default_rng(6)


@pytest.mark.parametrize("values", [rng.integers(-5, 99, 1000), rng.normal(size=(37, 3)).astype("f4"), rng.integers(0, 2, (6, 2, 2)).astype(bool), np.zeros((0, 4)), np.arange(5, dtype=">u2"), np.array(7.5)])
def test_array_files_are_split_by_rows(spark, tmp_path, values):
    np.save(f"{tmp_path}/a.npy", values)
    df = arrays.array_file(spark, f"{tmp_path}/a.npy", range_bytes=256)
    rows = values.reshape(len(values), int(np.prod(values.shape[1:]))) if values.ndim else values.reshape(1, 1)
    assert df.rdd.getNumPartitions() == max(1, -(-len(rows) // max(1, 256 // max(1, rows[:1].nbytes)))) if len(rows) else True
    assert [(r["row"], r["values"]) for r in df.orderBy("row").collect()] == [(i, r.tolist() if rows.dtype != bool else r.astype(int).tolist()) for i, r in enumerate(rows)]


def test_array_files_that_are_refused(spark, tmp_path):
    np.save(f"{tmp_path}/o.npy", np.array([{}, None], object), allow_pickle=True)
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(rng.normal(size=(3, 4))))
    (tmp_path / "x.npy").write_bytes(b"something else")
    for name, why in (("o", "objects"), ("f", "column order"), ("x", "not an array")):
        with pytest.raises(Exception, match=why):
            sources.read(spark, f"{tmp_path}/{name}.npy").count()


def test_sorter_folder(spark, tmp_path):
    n = 300
    times, clusters, places = np.sort(rng.integers(0, 10**6, (n, 1)), axis=0), rng.choice([0, 2, 7], n), rng.normal(size=(n, 2))
    for name, v in (("spike_times", times), ("spike_clusters", clusters)):
        np.save(f"{tmp_path}/{name}.npy", v)
    spikes, centres = arrays.sorted_spikes(spark, str(tmp_path), "r", range_bytes=512)
    assert all(r["centres_x"] is None for r in centres.collect())
    np.save(f"{tmp_path}/spike_positions.npy", places)
    spikes, centres = arrays.sorted_spikes(spark, str(tmp_path), "r", range_bytes=512)
    assert sorted(map(tuple, spikes.collect())) == sorted(("r", int(c), int(t)) for c, t in zip(clusters, times[:, 0], strict=True))
    found = {r["cell_index"]: (r["centres_x"], r["centres_y"]) for r in centres.collect()}
    assert found.keys() == {0, 2, 7} and all(found[c] == pytest.approx(places[clusters == c].mean(0)) for c in found)


def test_electrodes_and_info(spark, tmp_path):
    cells = spark.createDataFrame([("r", 0, 5), ("r", 1, 9)], "recording string, cell_index long, electrode int")
    geometry = spark.createDataFrame([("r", 5, 1.0, 2.0)], "recording string, electrode int, x double, y double")
    assert sorted(map(tuple, arrays.electrode_centres(cells, geometry).collect())) == [("r", 0, 1.0, 2.0), ("r", 1, None, None)]
    (tmp_path / "info.txt").write_text("first\n17852.77\nrest\n")
    assert arrays.recording_info(spark, f"{tmp_path}/info.txt").first()["sampling_freq"] == 17852.77
