"""Removal of byte strings that occur more than once, by suffix arrays of candidate segments.

Each start of a string of `length` bytes has an anchor, the k-gram of least hash within the string; equal strings have
equal anchors. Consecutive starts with one anchor form a segment, so a corpus falls into groups of segments by anchor
hash, and a string can only repeat within its group. Groups of one go at once. Segments of equal bytes are one segment
with a count. The distinct segments of a group meet in one task, whose suffix array puts equal strings side by side:
two-stage sorting sorts the suffixes smaller than their successors and induces the others by a scan of the buckets;
a common prefix of `length` bytes with a neighbour marks a start as repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_groups, prepare

GRAM = 32
#: Distinct segments of a group that one suffix array takes; larger groups are dealt out more finely.
MAX_GROUP = 2048
#: Bytes of the segments that are sorted at a time, and starts that are scanned at a time.
SORT_BYTES, SCAN = 1 << 19, 1 << 20
#: Starts to a block of a group too large for one array.
BLOCK = 32
_STARTS = "did long, th long, lo long, starts long"

_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    h, width = _TABLE[text], 1
    for odd in _ODD:
        h = h[:-width] * odd + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def segments(text: np.ndarray, length: int):
    """Arrays (lo, hi, anchor, offset): the starts lo..hi-1 share the anchor, which lies at lo + offset. Empty for texts
    shorter than length."""
    los, his, anchors, offsets = [], [], [], []
    for at in range(0, len(text) - length + 1, SCAN):
        part = text[at : at + SCAN + length - 1]
        h = _gram_hashes(part)
        m, w = len(part) - length + 1, length - GRAM + 1
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        point = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & _LOW).astype(np.int64)
        turn = np.flatnonzero(point[1:] != point[:-1]) + 1
        lo = np.concatenate([[0], turn])
        los.append(lo + at)
        his.append(np.append(turn, m) + at)
        anchors.append(h[point[lo]].view(np.int64))
        offsets.append(point[lo] - lo)
    if not los:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(los), np.concatenate(his), np.concatenate(anchors), np.concatenate(offsets)


def suffix_order(text: np.ndarray, begins: list[int], counts: list[int], ends: list[int], length: int) -> np.ndarray:
    """The starts begin..begin+count-1 of each piece in the order of their first `length` bytes."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[np.array(ends) - 1] = 1  # what runs into the end of a piece is sorted directly
    decided = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    active = np.zeros(n, bool)
    wanted = np.zeros(n, bool)
    for b, c in zip(begins, counts, strict=True):
        wanted[b : b + c] = True
        active[b : next_small[b + c - 1] + 1] = True
    raw = text.tobytes()
    direct = np.flatnonzero(active & small).tolist()
    direct.sort(key=lambda i: raw[i : i + length])
    direct = np.array(direct, np.int64)
    induced = active & ~small
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deal out the predecessors of the suffixes just placed; those of bucket c itself come back."""
        before = found - 1
        before = before[(found > 0)]
        before = before[induced[before]]
        char = text[before]
        for d in np.unique(char):
            if d != c:
                buckets[d].append(before[char == d])
        return before[char == c]

    for c in range(256):
        larger = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64)
        while len(larger):
            order.append(larger)
            larger = induce(larger, c)
        some = direct[cuts[c] : cuts[c + 1]]
        if len(some):
            order.append(some)
            induce(some, c)
    found = np.concatenate(order)
    return found[wanted[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to `length`; the first has 0."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        a, b = order[at - 1 : at + 4095], order[at : at + 4096]
        differ = view[a[: len(b)]] != view[b]
        out[at : at + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def repeated_starts(pieces: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs [a, b) of its first `count` starts whose string occurs at another of these starts."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    begins = [0, *ends[:-1]]
    order = suffix_order(text, begins, counts, ends, length)
    same = common_prefixes(text, order, length) >= length
    flag = np.zeros(len(text) + 1, np.int8)
    flag[order[same]] = 1
    flag[order[np.flatnonzero(same) - 1]] = 1
    out = []
    for b, c in zip(begins, counts, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag[b : b + c], [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, did, th, bytes): a row is known by id and text, equal rows by the same."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"),
        F.xxhash64(text).alias("th"), text.cast("binary").alias("bytes"),
    )


def repeats(rows: DataFrame, length: int, max_group: int = MAX_GROUP) -> DataFrame:
    """(did, th, spans): byte ranges of texts covered by strings that also start elsewhere. rows: as of _keyed()."""
    prepare(rows.sparkSession)

    def scan(batches):
        names = ["did", "th", "lo", "starts", "anchor", "off", "segment", "n"]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                lo, hi, anchor, off = segments(np.frombuffer(raw, np.uint8), length)
                if not len(lo):
                    continue
                view = memoryview(raw)
                hashes = np.array([xxhash.xxh3_64_intdigest(view[a : b + length - 1]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
                _, first, inverse, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                twice = n[inverse] > 1
                own = _merge(zip(lo[twice].tolist(), hi[twice].tolist(), strict=True))  # repeated within the text: a row by itself
                k = len(first)
                values = (
                    [did] * (k + len(own)), [th] * (k + len(own)), [*lo[first].tolist(), *(a for a, _ in own)], [*(hi - lo)[first].tolist(), *(b - a for a, b in own)],
                    [*anchor[first].tolist(), *(th ^ a for a, _ in own)], [*off[first].tolist(), *[0] * len(own)], [*hashes[first].tolist(), *[None] * len(own)], [*n.tolist(), *[2] * len(own)],
                )
                for column, some in zip(columns, values, strict=True):
                    column += some
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    found = cut(rows.select("did", "th", "bytes").mapInArrow(scan, "did long, th long, lo long, starts long, anchor long, off long, segment long, n long"))
    totals = cut(found.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).filter("total > 1").select("anchor", "rows"))
    shared = cut(join_groups(found, totals, ["anchor"], "rows").drop("rows"))
    within = shared.filter("segment is null").select("did", "th", "lo", "starts")
    kinds = shared.filter("segment is not null").groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("did", "th", "lo", "starts", "off")])
    kinds = cut(kinds)
    several = shared.filter("segment is not null")
    whole = join_groups(several, kinds.filter("n > 1").select("anchor", "segment", "rows"), ["anchor", "segment"], "rows").select("did", "th", "lo", "starts")
    groups = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1"))
    asked = join_groups(kinds.drop("rows"), groups, ["anchor"], "kinds")
    # the text side is that of the last join in remove_repeats(), so that texts are shuffled once
    pieces = asked.join(rows, ["did", "th"]).select("anchor", "id", "n", "kinds", "did", "th", "lo", "starts", "off", F.expr(f"substring(bytes, cast(lo + 1 as int), cast(starts + {length - 1} as int))").alias("piece"))
    member = F.struct("did", "th", "lo", "starts", "n", "piece", "id")
    sort = pieces.filter(F.col("kinds") <= max_group).groupBy("anchor").agg(F.collect_set(member).alias("members"))
    part = sort.select("members").mapInArrow(lambda batches: _sorted(batches, length), _STARTS)
    starts = within.unionByName(whole).unionByName(part)
    if not groups.filter(F.col("kinds") > max_group).isEmpty():
        starts = starts.unionByName(_large(pieces.filter(F.col("kinds") > max_group), length, max_group))
    return starts.groupBy("did", "th").agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("starts") + (length - 1)).alias("end"))).alias("spans"))


def _large(pieces: DataFrame, length: int, max_group: int) -> DataFrame:
    """(did, th, lo, starts) of repeated starts in groups that are too large for one array.

    Starts are dealt by blocks of BLOCK places from the anchor. All strings that begin in a block hold the same core,
    and equal strings have equal cores, so (anchor, block, core) are smaller groups. Blocks of equal bytes are counted
    before they move; what is left of a passage that very many texts share are the blocks at its ends. Where those are
    still too many, their starts are dealt out by string.
    """
    low, high = F.floor(-F.col("off") / BLOCK), F.floor((F.col("starts") - 1 - F.col("off")) / BLOCK)
    blocks = pieces.select("*", F.explode(F.sequence(low, high)).alias("b")).withColumn("at", F.col("off") + F.col("b") * BLOCK)
    blocks = blocks.withColumns({"from": F.greatest(F.lit(0), F.col("at")), "to": F.least(F.col("starts"), F.col("at") + BLOCK)})
    core = F.expr(f"substring(piece, cast(at + {BLOCK} as int), {length - BLOCK + 1})")
    part = F.expr(f"substring(piece, cast(`from` + 1 as int), cast(`to` - `from` + {length - 1} as int))")
    blocks = blocks.select(
        F.xxhash64("anchor", "b", core).alias("key"), "did", "th", (F.col("lo") + F.col("from")).alias("lo"), (F.col("to") - F.col("from")).alias("starts"), part.alias("piece"),
    ).withColumn("sub", F.xxhash64("piece"))
    blocks = cut(blocks.distinct())
    kinds = cut(blocks.groupBy("key", "sub").agg(F.count("*").alias("n")))
    whole = blocks.join(kinds.filter("n > 1"), ["key", "sub"]).select("did", "th", "lo", "starts")
    groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("key", "kinds")
    rest = blocks.dropDuplicates(["key", "sub"]).join(kinds, ["key", "sub"]).join(groups, "key")
    sort = rest.filter(F.col("kinds") <= max_group).groupBy("key").agg(F.collect_list(F.struct("did", "th", "lo", "starts", "n", "piece")).alias("members"))
    part = sort.select("members").mapInArrow(lambda batches: _sorted(batches, length), _STARTS)
    last = rest.filter(F.col("kinds") > max_group).select("did", "th", "lo", "starts", "piece")
    dealt = last.mapInArrow(lambda batches: _dealt(batches, length), "did long, th long, lo long, text_hash binary")
    strings = dealt.groupBy("text_hash").agg(F.count("*").alias("places")).filter("places > 1").select("text_hash")
    spread = dealt.join(strings, "text_hash").select("did", "th", "lo", F.lit(1).cast("long").alias("starts"))
    return whole.unionByName(part).unionByName(spread)


def _sorted(batches, length: int):
    names = ["did", "th", "lo", "starts"]
    for batch in batches:
        out: list[tuple] = []
        held, size = [], 0

        def solve(held, out):
            runs = repeated_starts([m["piece"] for m in held], [m["starts"] for m in held], length)
            for m, spans in zip(held, runs, strict=True):
                if m["n"] == 1:
                    out += [(m["did"], m["th"], m["lo"] + a, b - a) for a, b in spans]

        for row in batch.column(0):
            members = row.as_py()
            held += members
            size += sum(len(m["piece"]) for m in members)
            if size >= SORT_BYTES:
                solve(held, out)
                held, size = [], 0
        if held:
            solve(held, out)
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _dealt(batches, length: int):
    """Each start of the pieces with the hash of its string, for groups too large for one array."""
    for batch in batches:
        col = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for did, th, lo, starts, piece in zip(col["did"], col["th"], col["lo"], col["starts"], col["piece"], strict=True):
            hashes = [xxhash.xxh3_128_digest(piece[a : a + length]) for a in range(starts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([did] * starts, pa.int64()), pa.array([th] * starts, pa.int64()), pa.array(range(lo, lo + starts), pa.int64()), pa.array(hashes, pa.binary())], ["did", "th", "lo", "text_hash"]
            )


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, max_group: int = MAX_GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each row's UTF-8 bytes without those covered by a string of `length`
    bytes that also starts anywhere else in the table, the same row included; overlaps count, strings are judged on
    the input and never cross rows. kept is binary, as a cut may fall within a character; with digest it is replaced
    by kept_sha256. Null texts are empty; texts under `length` bytes stay whole; equal rows repeat each other; an
    empty table gives no rows. `length` is at least 64.
    """
    rows = _keyed(docs, id_col, text_col)
    marked = rows.join(repeats(rows, length, max_group), ["did", "th"], "left").select("id", "bytes", "spans", "did", "th")

    def run(batches):
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                cuts = _merge((x["lo"], x["end"]) for x in spans or ())
                kept, last = [], 0
                for a, b in cuts:
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]])
                out.append((i, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest() if digest else kept))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string() if digest else pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", last_name])

    last_name = "kept_sha256" if digest else "kept"
    return marked.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, {last_name} {'string' if digest else 'binary'}")
