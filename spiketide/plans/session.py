"""Recordings: named cell and stimulus tables over one spike table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, predicates, tables


class Recordings:
    """One spike table, any number of cell tables and stimulus tables by name; all are keyed by recording."""

    KEPT = ("cells", "stimuli")

    def __init__(self, spikes: DataFrame, cells: DataFrame, stimuli: DataFrame):
        self.spikes = spikes
        self.frames: dict[str, DataFrame] = {"cells": cells, "stimuli": stimuli}
        self.analyses: dict[str, tuple[str, str]] = {"all": ("cells", "stimuli")}

    def triggered(self, branches: list[dict] | None = None, cells: str = "cells", stimuli: str = "stimuli", seconds: bool = True, carry: list[str] | None = None) -> DataFrame:
        """Triggered spikes of the cells that fulfil the predicate, one lazy plan for all recordings."""
        chosen = predicates.where(self.frames[cells], branches or [])
        missing = chosen.join(self.frames[stimuli], ["recording", "stimulus_index"], "left_anti")
        if not missing.isEmpty():
            raise ValueError("cells name stimuli that the stimulus table does not have")
        keys = ["recording", "cell_index", "stimulus_index"]
        dim = self.frames[stimuli].join(chosen.select("recording", "stimulus_index").distinct(), ["recording", "stimulus_index"], "left_semi")
        wanted = self.spikes.join(chosen.select("recording", "cell_index").distinct(), ["recording", "cell_index"], "left_semi")
        found = align.triggered(wanted, dim, seconds=seconds).join(chosen.select(*keys).distinct(), keys, "left_semi")
        return align.carry(found, chosen, carry) if carry else found

    def analyse(self, name: str, **options) -> DataFrame:
        cells, stimuli = self.analyses[name]
        return self.triggered(cells=cells, stimuli=stimuli, **options)

    def chunk(self, size: int, place: int, **options) -> DataFrame:
        """Triggered spikes of the place-th `size` recordings in order of name."""
        names = [r[0] for r in self.frames["stimuli"].select("recording").distinct().orderBy("recording").offset(size * place).limit(size).collect()]
        return self.triggered([{"recording": names}] if names else [{"recording": "== "}], **options)

    def add(self, other: Recordings) -> Recordings:
        """Both sets of recordings; names have to differ."""
        if not self.frames["stimuli"].join(other.frames["stimuli"], "recording", "left_semi").isEmpty():
            raise ValueError("a recording of this name is there already")
        both = Recordings(self.spikes.unionByName(other.spikes, allowMissingColumns=True), self.frames["cells"].unionByName(other.frames["cells"], allowMissingColumns=True), self.frames["stimuli"].unionByName(other.frames["stimuli"], allowMissingColumns=True))
        return both

    def remove(self, recording: str) -> Recordings:
        out = F.col("recording") != recording
        return Recordings(self.spikes.filter(out), self.frames["cells"].filter(out), self.frames["stimuli"].filter(out))

    def set_column(self, values: DataFrame, column: str, frame: str = "cells", keys: tuple[str, ...] = ("recording", "cell_index")) -> None:
        """Upsert a column; it is added first, as null, where it is missing."""
        df = self.frames[frame]
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(values.schema[column].dataType))
        self.frames[frame] = tables.upsert(df, values, list(keys), [column])

    def mark(self, view: DataFrame, column: str, inside, outside) -> None:
        """A column that tells cells of the view from the others."""
        keys = ["recording", "cell_index"]
        hit = view.select(*keys).distinct().withColumn("__hit", F.lit(True))
        self.frames["cells"] = self.frames["cells"].join(hit, keys, "left").withColumn(column, F.when(F.col("__hit"), F.lit(inside)).otherwise(F.lit(outside))).drop("__hit")

    def stimulus_subset(self, names: list[str] | None = None, indices: list[int] | None = None) -> Recordings:
        """Recordings of the stimuli of the given names or numbers only, with the cell rows that belong to them; of neither: all."""
        asked = F.lit(True)
        if names is not None:
            asked &= F.col("stimulus_name").isin(list(names))
        if indices is not None:
            asked &= F.col("stimulus_index").isin(list(indices))
        stimuli = self.frames["stimuli"].filter(asked)
        own = stimuli.select("recording", "stimulus_index").distinct()
        return Recordings(self.spikes, self.frames["cells"].join(own, ["recording", "stimulus_index"], "left_semi"), stimuli)

    def delete(self, frame: str) -> None:
        if frame in self.KEPT:
            raise ValueError(f"{frame} cannot be deleted")
        del self.frames[frame]

    def save(self, path: str) -> None:
        """Tables as parquet beside a manifest."""
        spark = self.spikes.sparkSession
        self.spikes.write.mode("overwrite").partitionBy("recording").parquet(f"{path}/spikes")
        for name, df in self.frames.items():
            df.write.mode("overwrite").parquet(f"{path}/frames/{name}")
        manifest = json.dumps({"frames": sorted(self.frames), "analyses": self.analyses})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recordings:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        frames = {name: spark.read.parquet(f"{path}/frames/{name}") for name in manifest["frames"]}
        out = cls(spark.read.parquet(f"{path}/spikes"), frames["cells"], frames["stimuli"])
        out.frames |= frames
        out.analyses = {k: tuple(v) for k, v in manifest["analyses"].items()}
        return out
