"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, prepare

#: Words of test items in one automaton. A broadcast holds one automaton, so this bounds it whatever the benchmark's size;
#: a larger benchmark is dealt over several automata, each streamed against all documents.
BLOCK_WORDS = 100_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters, digits and bytes of other characters."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids; an item of fewer than `window` words is one window by itself."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]
        self.whole: dict[int, set[int]] = {}
        for item, words in items:
            self._add(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= window:
                self.ends[self.link[state]] |= self.ends[state]
        self._place_short(items)
        self.shortest = min([window, *(len(w) for _, w in items if w)])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the longest string of `state` followed by `word`, cut off from `target` if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, item: int, ids: list[int]) -> None:
        last = 0
        for word in ids:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                state = last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, word, self.next[state][word])
                last = new
            self.ends[last].add(item)

    def _place_short(self, items) -> None:
        """For states that hold a whole short item: the items and their length."""
        for item, words in items:
            if 0 < len(words) < self.window:
                state = 0
                for word in words:
                    state = self.next[state][self.vocabulary[word]]
                self.whole.setdefault(state, set()).add((len(words), item))
        self.short: list[tuple] = [()] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            above = self.short[self.link[state]] if state else ()
            self.short[state] = (*above, *sorted(self.whole.get(state, ())))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit runs [start, end) of words inside occurrences of windows, and the items whose windows occur."""
        ids = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        moves, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        state = size = 0
        for at, word in enumerate(ids):
            if word is None:
                state = size = 0
                continue
            step = moves[state].get(word)
            while step is None and state:
                state = link[state]
                size = length[state]
                step = moves[state].get(word)
            if step is None:
                state = size = 0
                continue
            state = step
            size += 1
            begin = at + 1
            if size >= window:
                begin = at + 1 - size
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                if top not in seen:
                    seen.add(top)
                    items |= self.ends[top]
            for n, item in short[state]:
                if n <= size:
                    items.add(item)
                    begin = min(begin, at + 1 - n)
            if begin <= at:
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = at + 1
                else:
                    spans.append([begin, at + 1])
        return [(a, b) for a, b in spans], items


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Lists of (id, words), each list of about block_words words; streamed, never held whole."""
    block, total = [], 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.filter("i is not null and t is not null").toLocalIterator():
        words = words_of(bytes(row["t"]))
        if words:
            block.append((row["i"], words))
            total += len(words)
        if total >= block_words:
            yield block
            block, total = [], 0
    if block:
        yield block


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document: id, n_words, spans (maximal word ranges [start, end) inside windows), items (sorted ids).

    Null and empty texts have no words and match nothing; items without words, or with a null id, match nothing; items
    with equal ids are one item; equal documents are answered row by row. An item of fewer than `window` words matches
    as a whole. A benchmark above block_words words is dealt over several automata; the documents stream past one
    after the other and their spans are merged, so memory is bounded by one automaton.
    """
    found = _streamed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", items, window, item_col, block_words)
    return found.select("row.id", "n_words", "spans", "items")


def _streamed(docs: DataFrame, text_col: str, items: DataFrame, window: int, item_col: str, block_words: int, most: float | None = None) -> DataFrame:
    """(row struct of all columns, n_words, spans, items, clean): clean is the text without its spans if `most`, the
    greatest share of matched words, is given, and null if it is exceeded or not given."""
    spark = docs.sparkSession
    prepare(spark)
    frame = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<long>").alias("items"),
        F.lit(None).cast("string").alias("clean"),
    )
    schema = frame.schema
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def over(frame: DataFrame, shared, most: float | None) -> DataFrame:
        def run(batches):
            automaton = shared.value
            for batch in batches:
                counts, spans, items, clean = [], [], [], []
                for text, old, had in zip(batch.column(0).field(text_col), batch.column(2), batch.column(3), strict=True):
                    raw = (text.as_py() or "").encode()
                    words = words_of(raw)
                    found, which = automaton.find(words)
                    if len(old.values):
                        found = _merged(found + [(x["start"], x["end"]) for x in old.as_py()])
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(which.union(had.as_py())))
                    fine = most is not None and sum(b - a for a, b in found) <= most * len(words)
                    clean.append(_without(raw, found) if fine and text.is_valid else None)
                made = [pa.array(counts, pa.int64()), pa.array(spans, ranges), pa.array(items, pa.list_(pa.int64())), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], batch.schema.names)

        return frame.mapInArrow(run, schema)

    blocks = _item_blocks(items, item_col, "text", block_words)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        if following is None:
            return over(frame, shared, most)
        frame = cut(over(frame, shared, None))
        shared.unpersist()
        block, following = following, next(blocks, None)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", max_coverage: float = 0.5, item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with matched spans cut out of their texts; rows whose matched share of words is above
    max_coverage go. What is left around a removed span is joined by one space. Rows without a match keep their text
    as it is, null texts included. All columns stay in place; matching follows matches()."""
    found = _streamed(docs, text_col, items, window, item_col, block_words, max_coverage)
    kept = found.filter(F.col("clean").isNotNull() | F.col(f"row.`{text_col}`").isNull())
    return kept.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the word ranges."""
    if not spans:
        return raw.decode(errors="replace")
    flat = raw.translate(_WORD_BYTES)
    offsets, i = [], 0
    for word in flat.split():
        i = flat.index(word, i)
        offsets.append((i, i + len(word)))
        i += len(word)
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last : offsets[a][0]].rstrip())
        last = offsets[b - 1][1]
    parts.append(raw[last:].lstrip())
    return b" ".join(p for p in parts if p).decode(errors="replace")
