"""Mixing sources to target weights with hash-random order and distributed prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Weights of the sources in code-point order, null last, repeated.
WEIGHTS = (3, 1, 2)
#: Rows that a slice of a source holds on average; slices of a source are ranges of the random key.
SLICE_ROWS = 512
#: Slices that are summed up in one go: blocks of them are as few as this allows.
BLOCK_SLICES = 1 << 14
_KEY_SPAN = 1 << 32


def words_in(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> and target: `share` of all sizes dealt by weight, none above `most` times its
    source's size; the excess is reshared by weight until none is above.

    Sources fill in the order of size by weight, so the level at which the rest share equally is a closed form of
    running sums: with k sources full, level = (total - their caps) / weight of the rest. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    dealt = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = dealt.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.lit(most) * F.col("source_size"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return levels.select(
        "source", "source_size",
        F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(last * F.col("weight")).cast("double").alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each row the mix takes.

    A source's rows are ordered by the MD5 of seed and id, of null ids that of seed and text, ties by id and size; whole epochs are taken first, then rows
    in that order until the source's budget, its target rounded, is met exactly, the last row in part. Rows of no
    words take none. Null sources are one source, the last. Reruns agree whatever the partitioning. Rows equal in id
    and size are interchangeable. Empty tables give no rows.

    A source may hold any share of the rows: it is cut into ranges of the random key, summed per range, and only the
    ranges' totals are accumulated per source.
    """
    text_key = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit(""))))  # null ids are spread as well
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), text_key.alias("text_key"))
    rows = cut(rows.withColumns({
        "key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.col("text_key")))),
        "of": F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")),
    }).drop("text_key"))
    slices = max(1, rows.count() // SLICE_ROWS)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(_KEY_SPAN)).cast("long")
    rows = rows.withColumn("slice", part)
    sums = rows.groupBy("of", "slice").agg(F.sum("size").alias("sum"), F.first("source").alias("source"))
    goal = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    budget = F.round(F.col("target")).cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.select(
        F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")).alias("of"),
        "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"),
    )
    # prefix sums in two levels: of slices within a block of them, and of the blocks of a source
    sums = sums.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
    ahead = lambda by, *of: Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("of", "block").agg(F.sum("sum").alias("sum"))
    blocks = blocks.select("of", "block", F.coalesce(F.sum("sum").over(ahead("block", "of")), F.lit(0)).alias("base"))
    inner = sums.select("of", "block", "slice", F.coalesce(F.sum("sum").over(ahead("slice", "of", "block")), F.lit(0)).alias("in_block"))
    starts = inner.join(blocks, ["of", "block"]).select("of", "slice", (F.col("base") + F.col("in_block")).alias("start")).join(goal, "of")
    within = Window.partitionBy("of", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    final = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["of", "slice"])
    cutoff = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("inside")))
    return final.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cutoff).cast("long").alias("taken"))


def apply(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as often as the mix takes them, columns as they were: taken words by size, rounded up.

    Rows of equal id and size are told apart by their order of text alone (its hash, then itself), so reruns agree on which of
    them comes more often. Rows without words, null texts included, are left out; null ids match each other. Empty tables give no rows."""
    copies = mixed.filter("taken > 0").select("id", "size", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    nth = lambda *by: F.row_number().over(Window.partitionBy("id", "size").orderBy(*by))
    counted = copies.withColumn("nth", nth(F.col("copies").desc()))
    rows = docs.select(F.col(id_col).alias("id"), words_in(F.col(text_col)).alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.filter("size > 0").withColumn("nth", nth(F.xxhash64(F.col("row")[text_col]), F.col("row")[text_col]))
    same = rows["id"].eqNullSafe(counted["id"]) & (rows["size"] == counted["size"]) & (rows["nth"] == counted["nth"])
    return rows.join(counted, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
