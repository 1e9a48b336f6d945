"""The rounds of op5 leave nothing in the driver that grows from round to round."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from spiketide.llm import lines


def test_guessed_sizes_stay_as_they_are(spark, monkeypatch):
    """Spark's guess of a table's size is one number of at most 64 bits after every round; it had four times the digits
    after each, so that runs of a few thousand lines filled the driver's heap."""
    run = "\n".join(f"line {i}" for i in range(100))
    docs = [(1, run), (2, "head\n" + run), (3, run + "\ntail\n" + run), (None, "line 7\nalone"), (4, None)]
    bits, plain = [], lines.suffix_levels

    def levels(rows):
        found = plain(rows)
        bits.extend(int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() for x in found)
        return found

    monkeypatch.setattr(lines, "suffix_levels", levels)
    found = lines.delete_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.select("id", "n_lines", "n_removed", "repeat_depth", F.sha2("kept", 256)).collect()), key=str) == brute.lines(docs)
    assert len(bits) == 7 and max(bits) <= 64
