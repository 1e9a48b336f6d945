"""Deletion of repeated line runs by distributed prefix doubling. DataFrame operations only.

Suffixes are positions in the line sequences of documents. Round by round a suffix is ranked by its first 1, 2, 4, ...
lines: the rank for 2k lines sorts the pairs of ranks for k lines at a position and k lines on. Suffixes with equal
rank share that many lines: they are an interval of the suffix array whose common prefixes are at least so long.
Suffixes that are alone drop out, for nothing that begins with them repeats; the rounds end when all are alone. The
intervals of the least depths that count say which places share a run; the union of the runs at a document's later
places is its maximal repeated runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import words_in
from .shared import cut_round, join_groups
from .spans import keyed, running

#: Ranges in which ranks are numbered: at most so many, so that their totals may be broadcast.
RANGES = 1 << 16
#: Ranks to a range on average.
RANGE_ROWS = 50_000
#: A repeated run goes if it has so many lines, or fewer that hold so many words.
MIN_LINES, MIN_WORDS = 4, 50
PLACE = ["did", "th", "pos"]


def _numbered(groups: DataFrame, order: list[str]) -> DataFrame:
    """(order..., n, new): the rows numbered in the sort order given; `slot` < RANGES is a range of that order. Numbering
    streams through a range; only the ranges' totals are summed up in one place."""
    totals = groups.groupBy("slot").agg(F.count("*").alias("rows"))
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("slot", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("slot").orderBy(*order)
    counted = groups.withColumn("k", F.row_number().over(within)).join(F.broadcast(starts), "slot")
    return counted.select(*order, "n", (F.col("ahead") + F.col("k") - 1).alias("new"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, pos, h, b, e): every line once for each document, its hash, and the words before and up to its end."""
    hashed = F.transform(F.split("text", "\n", -1), lambda line: F.struct(F.unhex(F.md5(line)).alias("h"), words_in(line).alias("w")))
    one = keyed(docs, id_col, text_col).select("did", "th", hashed.alias("lines")).dropDuplicates(["did", "th"])
    ends = running(F.transform("lines", lambda x: x["w"]), lambda a, b: a + b, F.lit(0).cast("long"))
    placed = F.zip_with("lines", ends, lambda x, e: F.struct(x["h"].alias("h"), (e - x["w"]).alias("b"), e.alias("e")))
    return one.select("did", "th", F.posexplode(placed).alias("pos", "x")).select("did", "th", F.col("pos").cast("long").alias("pos"), "x.h", "x.b", "x.e")


def _pairs(level: DataFrame, step: Column) -> DataFrame:
    """(did, th, pos, rank, then, b, e, d): each position of the level with the one `step` lines on."""
    after = level.select("did", "th", (F.col("pos") - step).alias("pos"), F.col("rank").alias("then"), F.col("e").alias("end"))
    return level.join(after, PLACE).select(*PLACE, "rank", "then", "b", F.col("end").alias("e"), "d")


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """lines (did, th, pos, h, b, e), each place once -> for depths d = 1, 2, 4, ... the places (did, th, pos, rank, b, e, d)
    whose first d lines occur at another place as well; the last level is not empty unless it is the first. Equal ranks
    are equal lines, and ranks sort as the MD5s of the lines do. b and e are the words of the document before and up to
    the end of these lines."""
    levels: list[DataFrame] = []
    rows, keys = lines.withColumn("d", F.lit(1).cast("long")), ["h"]
    slot = F.conv(F.hex(F.substring("h", 1, 2)), 16, 10).cast("long")
    while True:
        rows = cut_round(rows)
        groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("slot", slot)
        numbered = cut_round(_numbered(groups, keys))
        top = numbered.agg(F.max("new")).first()[0]
        if top is None and levels:
            return levels
        # depths are a column, so that every round runs the same compiled code
        levels.append(cut_round(join_groups(rows, numbered, keys).select(*PLACE, F.col("new").alias("rank"), "b", "e", "d")))
        if top is None:
            return levels
        rows, keys = _pairs(levels[-1], F.col("d")).withColumn("d", F.col("d") * 2), ["rank", "then"]
        slot = F.floor(F.col("rank") / max(RANGE_ROWS, top // RANGES + 1))


def _later_copies(levels: list[DataFrame], min_lines: int, min_words: int) -> DataFrame:
    """(did, th, pos) of the lines that later copies cover, of runs of min_lines lines, or of fewer with min_words words."""
    runs = []
    for k in range(1, min_lines + 1):
        s = k.bit_length() - 1
        if s < len(levels):
            over = k - (1 << s)
            some = _pairs(levels[s], F.lit(over)) if over else levels[s].withColumn("then", F.lit(0).cast("long"))
            runs.append((some if k == min_lines else some.filter(F.col("e") - F.col("b") >= min_words)).select(*PLACE, F.lit(k).cast("long").alias("k"), "rank", "then"))
    keys = ["k", "rank", "then"]
    every = cut_round(reduce(DataFrame.unionByName, runs))
    first = cut_round(every.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_groups(every, first, keys).filter(F.struct(*PLACE) != F.col("first"))
    own = (F.col("first.did") == F.col("did")) & (F.col("first.th") == F.col("th"))
    begin = F.when(own, F.greatest(F.col("pos"), F.col("first.pos") + F.col("k"))).otherwise(F.col("pos"))
    return later.select("did", "th", F.explode(F.sequence(begin, F.col("pos") + F.col("k") - 1)).alias("pos"))


def delete_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, repeat_depth, kept): each row's text without the later copies of repeated runs of lines.

    A run counts if it has min_lines lines, or fewer with min_words words among them. Of its places, sorted by id, hash
    of the text and line number, the first keeps it; the others lose the lines they cover, but for those that they share
    with the first place by overlapping it. repeat_depth is the last depth of the doubling, 1, 2, 4, ..., at which a
    run that begins in the document still repeats, first places included; 0 if no line does.

    Lines end at a line feed; runs are judged on the input and stay within a document. Null texts are empty and have one
    empty line. Rows equal in id and text count as one document and get equal results; null ids sort first. An empty
    table gives no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    levels = suffix_levels(_lines(docs, id_col, text_col))
    gone = _later_copies(levels, min_lines, min_words).groupBy("did", "th").agg(F.collect_set("pos").alias("gone"))
    depths = reduce(DataFrame.unionByName, [x.select("did", "th", "d") for x in levels])
    marked = gone.join(depths.groupBy("did", "th").agg(F.max("d").alias("depth")), ["did", "th"], "full_outer")
    found = rows.join(marked, ["did", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    every = F.sequence(F.lit(0).cast("long"), (F.size("lines") - 1).cast("long"))
    stay = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get("lines", i.cast("int")))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return found.select(
        "id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("repeat_depth"), kept.alias("kept"),
    )
