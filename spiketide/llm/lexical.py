"""Ranked lexical search with a tiered index: high-impact postings first, bounds on the rest, lower tiers only where
an item's ranking is not proven.

A posting's impact is what its term adds to the score of its document. Each term's postings are dealt to tiers by
impact, the best first; a term's residual is the most that a posting below a tier can have. The index is kept by
document, a row each with the terms and impacts of every tier in columns of their own, so scores are summed where the
document lies and only best lists move. A round scores with the upper tiers all documents that have a posting there.
Documents that the residuals leave a chance against the best found are scored in full. If a document without any
posting in these tiers could reach at most less than an item's k-th score, the item is proven; the others fall through
to the next round, which counts one tier more. Nothing is left below the last tier, so it proves all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import cut, prepare

#: Shares of the documents that a term's postings may number in the first tiers; one more tier holds the rest.
SHARES = (1 / 16, 1 / 4)
TIERS = len(SHARES) + 1
#: Impacts relative to a term's weight are told apart in so many steps when tiers are cut.
LEVELS = 64
#: Words of items that are searched for together; what is broadcast is bounded by it. An item with more is alone.
BLOCK_WORDS = 1 << 16
#: Cells of items by documents that are scored in one go.
CELLS = 1 << 22
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
UNIT, EXACT = 1_000_000_000, 1 << 53

#: Byte to byte: A-Z to lower case; ASCII other than letters and digits to a space; the rest stays.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces."""
    flat, at = text.translate(TERM_BYTES), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[set]]]:
    """Items as (ids, sets of terms), at most BLOCK_WORDS terms to a block where no item has more. Rows of one id are one
    item; items without an id are left out."""
    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids, sets, size = [], [], 0
    for item, text in rows.orderBy("item").toLocalIterator():
        terms = {w for piece in words(text.encode()) for w in piece}
        if ids and ids[-1] == item:
            sets[-1] |= terms
        else:
            if ids and size + len(terms) > BLOCK_WORDS:
                yield ids, sets
                ids, sets, size = [], [], 0
            ids.append(item)
            sets.append(terms)
        size += len(terms)
    if ids:
        yield ids, sets


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): number of terms of each document, and the asked ones in it with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = held.value
        for batch in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                seen, total = Counter(), 0
                for piece in words(text.as_py()):
                    total += len(piece)
                    seen.update(filter(known.__contains__, piece))
                n.append(total)
                terms += [known[w] for w in seen]
                tfs += seen.values()
                sizes.append(len(terms))
            lists = lambda v, kind, ends=sizes: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())], ["id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)


def _saturation(n: np.ndarray, at: np.ndarray, tfs: np.ndarray, count: int, length: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * count) // length
    return (UNIT * tfs) // (1000 * tfs + 20 * m[at])


def _levels(counted: DataFrame, terms: int, count: int, length: int) -> np.ndarray:
    """How many postings of each term have each level of saturation: terms x LEVELS."""

    def run(batches):
        sums = np.zeros(terms * LEVELS, np.int64)
        for batch in batches:
            at, term = _flat(batch.column(1))
            sat = _saturation(batch.column(0).to_numpy(), at, _flat(batch.column(2))[1], count, length)
            sums += np.bincount(term.astype(np.int64) * LEVELS + sat * LEVELS // 1_000_001, minlength=len(sums))
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["cell", "n"])

    rows = counted.select("n", "terms", "tfs").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(terms * LEVELS, np.int64)
    for cell, n in rows.toLocalIterator():
        out[cell] = n
    return out.reshape(terms, LEVELS)


def _weights(df: np.ndarray, count: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Plan:
    """Weights of terms, least levels of tiers and residuals below them: all that tasks need besides the index."""

    def __init__(self, levels: np.ndarray, count: int):
        upto = levels[:, ::-1].cumsum(1)[:, ::-1]  # postings of a level and above
        self.weight = _weights(upto[:, 0], count)
        least = [(upto > max(1, int(share * count))).sum(1) for share in SHARES]
        self.least = np.stack([*least, np.zeros(len(levels), int)])
        top = np.array([[np.max(np.flatnonzero(row[:to]), initial=-1) for to in at] for row, at in zip(levels, self.least.T, strict=True)], np.int64).reshape(len(levels), TIERS)
        self.residual = (self.weight[:, None] * ((top + 1) * 1_000_001 // LEVELS)).T.copy()  # tier -> term -> bound of what lies below


def _index(counted: DataFrame, plan: Plan, count: int, length: int) -> DataFrame:
    """(id, t0, i0, t1, i1, ...): a document's terms and their impacts, tier by tier; documents without any are left out."""
    held = counted.sparkSession.sparkContext.broadcast(plan)
    names = [f"{c}{k}" for k in range(TIERS) for c in "ti"]

    def run(batches):
        for batch in batches:
            n, (at, term) = batch.column(1).to_numpy(), _flat(batch.column(2))
            sat = _saturation(n, at, _flat(batch.column(3))[1], count, length)
            level, impact = sat * LEVELS // 1_000_001, held.value.weight[term] * sat
            tier = (level[None, :] < held.value.least[:, term]).sum(0)
            out = [batch.column(0)]
            for k in range(TIERS):
                mine = tier == k
                ends = pa.array(np.concatenate([[0], np.bincount(at[mine], minlength=len(n)).cumsum()]).astype(np.int32))
                out += [pa.ListArray.from_arrays(ends, pa.array(term[mine])), pa.ListArray.from_arrays(ends, pa.array(impact[mine]))]
            yield pa.RecordBatch.from_arrays(out, ["id", *names])

    kinds = ", ".join(f"{x} array<{'int' if x[0] == 't' else 'long'}>" for x in names)
    return counted.filter(F.size("terms") > 0).mapInArrow(run, f"id long, {kinds}")


def _sums(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by cell, exact: doubles hold them as they are below 2**53, or else in two halves."""
    if values.size == 0 or float(np.abs(values).sum(dtype=float)) < EXACT:
        return np.bincount(cells, values, size).astype(np.int64)
    low = values & 0xFFFFFF
    return (np.bincount(cells, values >> 24, size).astype(np.int64) << 24) + np.bincount(cells, low, size).astype(np.int64)


class Best:
    """The k best (score, id) of each item among what is added; ties by id, null ids last."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.items, self.floor, self.kept, self.more = k, items, floor.copy(), [], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.kept.append((item, score, ids, null))
        self.more += len(item)
        if self.more > 4 * self.k * self.items:
            self.prune()

    def prune(self) -> None:
        item, score, ids, null = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*self.kept) if self.kept else [[]] * 4))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])
        stay = place < self.k
        self.kept, self.more = [(item[stay], score[stay], ids[stay], null[stay])], 0


def _round(index: DataFrame, tiers: int, lists: list[np.ndarray], plan: Plan, k: int, floor: np.ndarray) -> DataFrame:
    """(item, id, score): of each task the k best documents of every item in `lists` (its terms) that have a posting in
    the first `tiers` tiers, by their full scores; those that cannot reach `floor` are left out."""
    sizes = np.array([len(x) for x in lists])
    flat, of = np.concatenate(lists) if lists else np.zeros(0, int), np.repeat(np.arange(len(lists)), sizes)
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(len(plan.weight) + 1))
    residual = plan.residual[tiers - 1]
    rest = np.array([residual[x].sum() for x in lists], np.int64)
    held = index.sparkSession.sparkContext.broadcast((of[order], starts, residual, rest, floor))

    def spread(batch, tier, starts, items):
        """(document, item, impact, term) of each posting of the tier and each item that asks for its term."""
        (at, term), (_, impact) = _flat(batch.column(1 + 2 * tier)), _flat(batch.column(2 + 2 * tier))
        n = starts[term + 1] - starts[term]
        p = np.repeat(np.arange(len(term)), n)
        inner = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        return at[p], items[starts[term[p]] + inner], impact[p], term[p]

    def run(batches):
        items, starts, residual, rest, floor = held.value
        count = len(rest)
        best = Best(count, k, floor)
        for whole in batches:
            for first in range(0, whole.num_rows, max(1, CELLS // max(1, count))):
                batch = whole.slice(first, max(1, CELLS // max(1, count)))
                size = batch.num_rows * count
                ids = batch.column(0)
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                parts = [spread(batch, t, starts, items) for t in range(tiers)]
                doc, item, impact, term = (np.concatenate(c) for c in zip(*parts, strict=True))
                cells = doc * count + item
                score, gain = _sums(cells, impact, size), _sums(cells, impact - residual[term], size)
                seen = np.bincount(cells, minlength=size) > 0
                ask = np.flatnonzero(seen & (gain.reshape(-1, count) + rest >= np.maximum(best.floor, 1)).ravel())
                if tiers < TIERS and len(ask):
                    wanted = np.zeros(size, bool)
                    wanted[ask] = True
                    for t in range(tiers, TIERS):
                        doc, item, impact, _ = spread(batch, t, starts, items)
                        cells = doc * count + item
                        score += _sums(cells[wanted[cells]], impact[wanted[cells]], size)
                ask = ask[score[ask] >= np.maximum(best.floor, 1)[ask % count]]
                best.add(ask % count, score[ask], ids[ask // count], null[ask // count])
        best.prune()
        for item, score, ids, null in best.kept:
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["item", "id", "score"])

    columns = [f"{c}{t}" for t in range(TIERS) for c in "ti"]
    return index.select("id", *columns).mapInArrow(run, "item long, id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(item, id, score, place): the k best of all tasks. A task sends k rows of an item at most, and these are cut to k in
    groups of tasks before they meet."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    best = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)
    dealt = best(found.withColumn("deal", F.spark_partition_id() % 256), "item", "deal").drop("place", "deal")
    return best(dealt, "item")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, place, id, score): each item's k best documents of a score above 0, best first, equal ones by id.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms scores for each of an item's terms, once,
    weight * (10^9 tf div (1000 tf + 20 m)) with m = 50 + 50 n N div L, of N documents with terms and L terms in all.
    Null texts have no terms. Every row is a document of its own, null ids come last among equals; rows of one item id
    are one item, items without an id or without terms have no rows. Empty tables give no rows.

    Items are searched for in blocks of BLOCK_WORDS terms, each of which reads the texts once. What is broadcast is
    bounded by a block; what moves, by tasks, items and k.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = spark.createDataFrame([], StructType([StructField("item", items.schema[item_col].dataType)])).selectExpr("item", "0 as place", "0L as id", "0L as score")
    for ids, sets in _blocks(items, item_col, item_text):
        out = out.unionByName(_block(docs, ids, sets, k, id_col, text_col, items.schema[item_col].dataType))
    return out


def _block(docs: DataFrame, ids: list, sets: list[set], k: int, id_col: str, text_col: str, kind) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    lists = [np.array(sorted(vocabulary[w] for w in s), int) for s in sets]
    counted = cut(_counted(docs, vocabulary, id_col, text_col))
    count, length = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], StructType([StructField("at", LongType()), StructField("item", kind)]))
    done, open_items, floor = [], np.arange(len(ids)) if count and vocabulary else [], np.zeros(len(ids), np.int64)
    if len(open_items):
        plan = Plan(_levels(counted, len(vocabulary), count, length), count)
        index = cut(_index(counted, plan, count, length))
    tiers = 1
    while len(open_items):
        found = cut(_merged(_round(index, tiers, [lists[i] for i in open_items], plan, k, floor[open_items]), k))
        kth = {r["item"]: r["score"] for r in found.filter(F.col("place") == k).toLocalIterator()}
        floor[open_items] = [max(floor[i], kth.get(j, 0)) for j, i in enumerate(open_items)]
        rest = np.array([plan.residual[tiers - 1][lists[i]].sum() for i in open_items])
        proven = (rest < floor[open_items]) | (tiers == TIERS)
        places = spark.createDataFrame([(int(j), int(open_items[j])) for j in np.flatnonzero(proven)], "item long, at long")
        done.append(found.join(F.broadcast(places), "item").select("at", "place", "id", "score"))
        open_items, tiers = open_items[~proven], tiers + 1
    ranked = spark.createDataFrame([], "at long, place int, id long, score long")
    for part in done:
        ranked = ranked.unionByName(part)
    return ranked.join(F.broadcast(names), "at").select("item", "place", "id", "score")
