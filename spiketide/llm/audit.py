"""Audit of how filters interact: what each removes, alone and in every order, from a histogram of failure masks.

A document's failures are bits of a mask. All that an order of filters does to a part of the corpus follows from how
many of its documents have each mask, so documents are read once and orders are played on at most 32 cells a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Names of the filters, in the order of their bits; E, the last, asks for equal texts and is no function of one text.
NAMES = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: A under 100 words, B under 80 % distinct words, C over 10 % of [A-Z], D any of #$%&*|."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": counts["all"] < 100, "B": 100 * counts["distinct"].cast("long") < 80 * counts["all"].cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, rows): documents counted by failure mask and by labels, at most 128 rows to a part.

    Null texts and parts are empty. A row fails E if its id is larger than the least id of its text in the table; rows
    of equal id and text do not fail E by each other, nor do rows without an id. A document is good or toxic if any
    row of labels (doc_id, quality, toxic) of its id says so; without such a row it is neither. No documents: no rows.

    Texts do not move: rows carry length and SHA-256 of theirs, which stand for it. Copies are put together before each
    shuffle by text, so a text that a third of the rows share costs a row per task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = reduce(lambda a, b: a + b, [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(text).values())])
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), bits.alias("mask"),
        F.length(text).alias("length"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = cut(rows)
    same = ["digest", "length"]
    first = rows.groupBy(*same).agg(F.min("id").alias("id")).filter("id is not null").withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = rows.join(first, [*same, "id"], "left").join(known, "id", "left")
    copy = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 1 << NAMES.index("E")).otherwise(0)
    return told.groupBy("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("rows"))


def steps(spark: SparkSession, names: str = NAMES) -> DataFrame:
    """(filter_order, step, bit, before): every order of the filters and step in it, the filter's bit and those of the
    filters before it. Its size is that of the factorial of the names."""
    rows = [("".join(order), k + 1, 1 << names.index(name), sum(1 << names.index(x) for x in order[:k])) for order in permutations(names) for k, name in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def orders(histogram: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the counts
    of masks(); a row for every part, order of the filters and step in it.

    A filter meets what the ones before it left. redundant: it fails documents that were gone already. unique_fails: it
    alone fails them. shapley: what it removes, summed over all orders; of k filters that fail a document each is the
    first in a k-th of the orders.
    """
    plan = steps(histogram.sparkSession, names)
    mask, n = F.col("mask"), F.col("rows")
    masked = plan.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    fails, gone = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    roles = masked.select(
        "filter_order", "step", "mask", (~fails & ~gone).alias("kept"), (fails & ~gone).alias("removed"), (fails & gone).alias("redundant"), (mask == F.col("bit")).alias("alone"),
        F.when(fails, F.floor(F.lit(factorial(len(names))) / F.bit_count(mask))).otherwise(0).cast("long").alias("orders"),
    )
    total = lambda when: F.sum(F.when(when, n).otherwise(0)).alias
    met = histogram.join(F.broadcast(roles), "mask").groupBy("part", "filter_order", "step")
    return met.agg(
        total(F.col("kept"))("kept"), total(F.col("removed"))("removed"), total(F.col("redundant"))("redundant"), total(F.col("alone"))("unique_fails"),
        total(F.col("removed") & (F.col("good") == 1))("good_lost"), total(F.col("removed") & (F.col("toxic") == 1))("toxic_lost"), F.sum(n * F.col("orders")).alias("shapley"),
    )
