"""SimHash near-duplicates with covering locality-sensitive hashing.

A covering family for radius r gives every bit of the fingerprint a code of r+1 bits. For each non-zero vector v of
r+1 bits there is a table; its mask keeps the bits whose code has odd parity with v. The codes of at most r differing
bits span at most r dimensions, so some v is orthogonal to all of them: in that table the pair agrees on every kept
bit. No pair within the radius is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import cut, join_groups, prepare

#: Members of a bucket that one task compares; larger buckets are dealt out as pairs of blocks of half that size.
MAX_BUCKET = 65_536
#: Shingles hashed at a time within one text.
CHUNK = 1 << 16
#: Shingles of a component that one task compares at a time, and bits of the map that tells which texts to hash again.
BLOCK_SHINGLES, BITMAP = 1 << 21, 1 << 23
#: Bits of the map that tells which rows to look up before one of each group is kept; at most 1/64 as many rows.
MARKS = 1 << 25
#: Words of the wide fingerprint; texts sampled for common shingles, and how many of these are put last.
WIDE, SAMPLED, COMMON = 8, 5_000, 200_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (256 * np.arange(8)).astype(np.int64)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks over so many bits, as signed longs; codes are dealt evenly over the bits."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, words cut at ASCII white space."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return np.zeros(0, np.uint64)
    space = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    k = min(words, len(space) + 1)
    starts = np.concatenate([[0], space + 1])[: len(space) + 2 - k]
    ends = np.append(space, len(norm))[k - 1 :]
    out = np.empty(len(starts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        part = [digest(norm[a:b], 42) for a, b in pairs]
        out[at : at + len(part)] = part
    return out


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; none: zero. A signed long."""
    if not len(hashes):
        return 0
    seen = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), CHUNK):
        lanes = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8) + _LANES
        seen += np.bincount(lanes.ravel(), minlength=2048)
    counts = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _mix(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash: one round of splitmix64 from a stream of its own."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct shingle hashes in an order that is the same for every set.

    Two sets of at least that Jaccard similarity share one of their keys: a set whose first keys are all foreign to the
    other shares too few of the rest. common: hashes to put last, the rarest of them first; any choice is exact, and
    few sets meet in a bucket if it holds the common ones.
    """
    n = len(hashes)
    count = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(common):
        order = np.argsort(common)
        at = order[np.minimum(np.searchsorted(common, hashes, sorter=order), len(common) - 1)]
        rank = np.where(common[at] == hashes, at + 1, 0)
    return hashes[np.lexsort((_mix(hashes, 99), rank))[:count]]


def common_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Hashes of the shingles in at least five of about SAMPLED different texts, the rarest first, at most COMMON."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), words)).view(np.int64))], ["h"])

    texts = docs.select(*_texts(docs, text_col))
    share = max(1, docs.count() // SAMPLED)
    some = texts.filter(F.pmod("th", F.lit(share)) == 0).dropDuplicates(["th"]).select("th", "text")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n >= 5")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) for each row. Null and empty texts have no words and fingerprint zero. Rows with equal ids stay
    apart."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(text.as_py() or b"", words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def _texts(docs: DataFrame, text_col: str) -> tuple:
    """Columns th, the hash of the text, and text as bytes; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return F.xxhash64(text).alias("th"), text.alias("text")


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(id, th, fp, node, size, wide, keys) for each row: fingerprint, and of the distinct shingles the hash, the
    number, the SimHash in 512 bits and the prefix keys. Equal shingle sets are one node."""
    common = common_shingles(docs, text_col, words)

    def run(batches):
        for batch in batches:
            fps, nodes, sizes, wides, keys = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                distinct = np.unique(hashes)
                fps.append(majority(hashes))
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes()) - 2**63)
                sizes.append(len(distinct))
                wides.append([majority(_mix(distinct, k)) for k in range(WIDE)])
                keys.append(prefix_keys(distinct, similarity, common).view(np.int64))
            longs, lists = [pa.array(x, pa.int64()) for x in (fps, nodes, sizes)], [pa.array(x, pa.list_(pa.int64())) for x in (wides, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, *lists], ["id", "th", "fp", "node", "size", "wide", "keys"])

    schema = "id long, th long, fp long, node long, size long, wide array<long>, keys array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), *_texts(docs, text_col)).mapInArrow(run, schema)


def forest(words: np.ndarray, reps: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges that join what links of at most radius bits join within a bucket: fewer than it has members.

    A node is compared with those not reached so far, which fall away quickly where a bucket is dense.
    """
    a, b = [], []
    left = np.arange(len(reps))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        stack = [seed]
        while stack and len(left):
            near = np.bitwise_count(words[left] ^ words[stack.pop()]).sum(axis=1, dtype=np.int64) <= radius
            if near.any():
                found = left[near]
                a += [int(reps[seed])] * len(found)
                b += reps[found].tolist()
                stack += found.tolist()
                left = left[~near]
    return a, b


def links(nodes: DataFrame, buckets: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) between reps that share a bucket and differ in at most radius bits.

    nodes (rep, words array<long>), buckets (bucket, rep). What a bucket returns is a spanning forest of its links, so
    no link's effect on the components is lost and no group of copies is expanded into pairs. Buckets of one are
    dropped after a count, and of buckets with the same members, known by count, ends and two 64-bit hashes, one is
    compared; a bucket above max_bucket is dealt out as pairs of blocks, which together see every pair.
    """
    prepare(nodes.sparkSession)
    marks = [F.min("rep").alias("low"), F.max("rep").alias("high"), *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"x{k}") for k in (1, 2)]]
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"), *marks).filter("n > 1")
    counts = counts.groupBy("n", "low", "high", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    block = max(1, max_bucket // 2)
    shared = buckets.join(counts, "bucket").join(nodes, "rep").withColumn("m", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    pairs = F.when(F.col("n") <= max_bucket, F.array(F.lit("0"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.concat_ws("-", F.least(own, j), F.greatest(own, j)))
    )
    groups = (
        shared.select("bucket", "rep", "words", F.explode(pairs).alias("block"))
        .groupBy("bucket", "block").agg(F.collect_list(F.struct("rep", "words")).alias("members"))
    )
    first, second = F.col("members")[0]["words"], F.col("members")[1]["words"]
    apart = F.aggregate(F.zip_with(first, second, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    groups = groups.filter((F.size("members") > 2) | ((F.size("members") == 2) & (apart <= radius)))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(batch.schema.get_field_index("members")):
                members = row.values
                reps = members.field("rep").to_numpy()
                lists = members.field("words")
                words = lists.flatten().to_numpy().view(np.uint64).reshape(len(reps), -1)
                x, y = forest(words, reps, radius)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, fp, component): component is the least id reachable over fingerprints at most radius bits apart.

    Equal fingerprints are one node, so exact copies cost nothing further. Null and empty texts have fingerprint zero
    and link like any other. Ids are longs; a row with a null id keeps its row and its links, and never names a component:
    one of null ids only is null. An empty table gives no rows; other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    prints = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)]))
    nodes, buckets = prints.select(F.col("fp").alias("rep"), F.array("fp").alias("words")), prints.select(tables.alias("bucket"), F.col("fp").alias("rep"))
    labels = connected_components(links(nodes, buckets, radius, max_bucket)).select("node", F.col("component").alias("part"))
    named = prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("part", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component"))
    return marked.join(named.join(least, "part").select("fp", "component"), "fp").select("id", "fp", "component")


def loose_bits(similarity: float) -> int:
    """Differing bits of the wide SimHash that a pair of the similarity stays within but for one in 10^9.

    Large sets differ in a share acos(2s / (1 + s)) / pi of the bits at most; sets of a few shingles, whose majorities
    are coarse, in up to 1.24 times that share (4 shingles and 5, at 0.8). Six standard deviations are added.
    """
    share = min(0.5, 1.3 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    return math.ceil(64 * WIDE * share + 6 * math.sqrt(64 * WIDE * share * (1 - share)))


def exact_forest(words: np.ndarray, sets: list[np.ndarray], nodes: np.ndarray, most: int, similarity: float) -> tuple[list, list]:
    """As forest(), of the pairs whose sorted shingle sets have at least the Jaccard similarity asked for; most: bits
    beyond which two sets need not be compared."""
    a, b = [], []
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(nodes))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        stack = [seed]
        while stack and len(left):
            at = stack.pop()
            own, n = sets[at], len(sets[at])
            least = similarity * (n + sizes[left]) / (1 + similarity) - 1e-9
            may = np.flatnonzero((np.minimum(n, sizes[left]) >= least) & (np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int64) <= most))
            linked = np.zeros(len(left), bool)
            for j in may.tolist():
                other = sets[left[j]]
                where = np.searchsorted(own, other)
                linked[j] = np.count_nonzero(own[np.minimum(where, n - 1)] == other) >= least[j]
            if linked.any():
                found = left[linked]
                a += [int(nodes[seed])] * len(found)
                b += nodes[found].tolist()
                stack += found.tolist()
                left = left[~linked]
    return a, b


def _exact_links(docs: DataFrame, marked: DataFrame, loose: DataFrame, text_col: str, words: int, most: int, similarity: float, block: int) -> DataFrame:
    """Edges (a, b) between nodes of one loose component whose shingle sets are as similar as asked for.

    Shingles are hashed again from one text of each node that has a loose link, each set travels once, and a component
    of more than `block` shingles is dealt out as pairs of blocks, which together see every pair. Before the shuffle, a
    bitmap of the wanted texts' hashes drops most of the others.
    """
    wanted = marked.groupBy("node").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("wide").alias("wide")).join(loose, "node")
    total = wanted.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(block))).cast("int").alias("m"))
    wanted = cut(wanted.join(total, "component").select("node", "th", "wide", "component", "m"))
    slot = F.pmod("th", F.lit(BITMAP))
    bits = wanted.groupBy(F.floor(slot / F.lit(64)).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[[r["at"] for r in bits]] = [r["bits"] for r in bits]

    def hash_wanted(batches):
        for batch in batches:
            th = batch.column(0).to_numpy()
            at = th % BITMAP
            keep = np.flatnonzero((bitmap[at // 64] >> (at % 64)) & 1)
            sets = [np.unique(shingle_hashes(batch.column(1)[i].as_py(), words)).view(np.int64) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(th[keep]), pa.array(sets, pa.list_(pa.int64()))], ["th", "shingles"])

    sets = docs.select(*_texts(docs, text_col)).mapInArrow(hash_wanted, "th long, shingles array<long>").dropDuplicates(["th"])
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    pairs = F.when(F.col("m") == 1, F.array(F.lit("0"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.concat_ws("-", F.least(own, j), F.greatest(own, j)))
    )
    groups = (
        wanted.join(sets, "th").select("component", "node", "wide", "shingles", F.explode(pairs).alias("block"))
        .groupBy("component", "block").agg(F.collect_list(F.struct("node", "wide", "shingles")).alias("members"))
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(batch.schema.get_field_index("members")):
                members = row.values
                nodes = members.field("node").to_numpy()
                wide = members.field("wide").flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
                sets = [x.values.to_numpy().view(np.uint64) for x in members.field("shingles")]
                x, y = exact_forest(wide, sets, nodes, most, similarity)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bucket: int = MAX_BUCKET, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, fp, component, th, part) for near copies by similarity of their shingle sets rather than by a fixed radius: texts are
    linked if the Jaccard similarity of their sets of shingles is at least the one given, and by no other pair.

    Texts at 0.8 differ in about ten of 64 SimHash bits, beyond what a covering family can serve. Buckets are therefore
    the prefix keys of the sets, which no pair at the similarity escapes, whatever its length. Links of the 512-bit
    SimHashes, several deviations wider than the similarity asks for, only join candidates; within what they join, the
    sets themselves decide. component is the least id in it, null if all are null; th, the hash of the text, tells rows of one id
    apart, and part names the component whatever the ids are.
    """
    marked = cut(sketches(docs, id_col, text_col, words, similarity))
    buckets = marked.select("node", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("bucket"), F.col("node").alias("rep"))
    shared = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))  # counted before it is shuffled
    met = join_groups(buckets, shared, ["bucket"]).select("bucket", "rep")
    nodes = marked.select(F.col("node").alias("rep"), F.col("wide").alias("words")).dropDuplicates(["rep"])
    most = loose_bits(similarity)
    edges = links(nodes, cut(met), most, max_bucket)
    edges = _exact_links(docs, marked, connected_components(edges), text_col, words, most, similarity, block)
    labels = connected_components(edges).select("node", F.col("component").alias("part"))
    named = marked.join(labels, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = named.groupBy("part").agg(F.min("id").alias("component"))
    return named.join(least, "part").select("id", "fp", "component", "th", "part")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar(): that of the least id, null last, then of the least hash of the text. Rows
    are known by id and text, so rows of one id with different texts stay apart; of equal ones, one.

    A bitmap of bounded size marks the rows that go and those with an equal. Rows that it does not mark stay where they
    are; only the marked ones, falsely or not, are shuffled to be looked up.
    """
    keys = ["__id", "__none", "__th"]
    id, th = F.col("id"), F.col("th")
    rows = cut(groups.select("part", F.coalesce(id, F.lit(0)).alias("__id"), id.isNull().alias("__none"), th.alias("__th")).groupBy("part", *keys).agg(F.count("*").alias("n")))
    least = rows.groupBy("part").agg(F.min(F.struct("__none", "__id", "__th")).alias("least"))
    kept = least.select(*[F.col(f"least.{k}").alias(k) for k in keys])
    unsure = rows.filter("n > 1").select(*keys).unionByName(rows.select(*keys).join(kept, keys, "left_anti"))
    slot = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    word, bit = F.floor(slot / F.lit(64)).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    bits = cut(unsure.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")))
    own = F.col(id_col).cast("long")
    keyed = docs.withColumns({"__id": F.coalesce(own, F.lit(0)), "__none": own.isNull(), "__th": _texts(docs, text_col)[0]})
    marked = keyed.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(bits), "__word", "left")
    known = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    looked_up = marked.filter(known).join(kept, keys, "left_semi").dropDuplicates(keys)
    return marked.filter(~known).unionByName(looked_up).select(*docs.columns)
