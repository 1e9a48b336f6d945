"""Token-ID output: Arrow stream-file format with fixed-size-list batches, and its reader.

A data set is a folder of Arrow IPC files. Each file holds the token stream of a range of documents, in ascending id
order, cut into sequences of equal length; the last sequence is padded. Columns: `ids`, a fixed-size list, and `mask`,
a fixed-size list of booleans, false on padding. Batches hold a fixed number of sequences, so sequence k lies in batch
k // BATCH at row k % BATCH, found without reading anything before it (see Sequences); a memory-mapped local file gives
the buffers without a copy. Each file has an index file beside it: doc_id, start (in the file's stream), n_tokens. Files are known
by the manifest that the writer returns; what a lost attempt left behind is in no manifest.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, prepare, shared_dir

SEQUENCE, BATCH = 1024, 256
#: Rows of a file on average.
FILE_ROWS = 8192
#: Distinct pieces of text in a generation of a Python worker's cache of encodings; the one before is kept beside it. And in
#: that of a cache that a task drops at its end.
CACHE, TASK_CACHE = 400_000, 100_000


class _Pieces(dict):
    """piece -> its ids as bytes of unsigned 32-bit integers; `before` stands in front of every piece."""

    #: A word of letters up to U+00FF, which the pre-tokenizer leaves whole, and a run of ASCII marks behind it but for the
    #: apostrophe, which it parts from the word and leaves whole as well.
    WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, tokenizer, before: str, most: int = CACHE):
        super().__init__()
        self.most = most
        self.tokenizer, self.tokenize, self.before = tokenizer, tokenizer.model.tokenize, before
        self.older: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(other) for b in range(256)}
        self.shown = before.translate(self.letters)

    def _ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._ids(self.shown + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            if piece.isalpha() and (piece.isascii() or self.LETTERS.fullmatch(piece)):
                out = self._word(piece)
            elif parts := self.WORD.fullmatch(piece):
                out = self[parts[1]] + self._ids(parts[2])
            else:
                out = np.array(self.tokenizer.encode(self.before + piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


def _byte_level(tokenizer) -> bool:
    """Whether texts may be encoded piece by piece: a plain BPE over bytes, cut by the usual expression, nothing before
    or after it, and special tokens that hold "<|"."""
    kind = json.loads(tokenizer.to_str())
    cutter, model = kind["pre_tokenizer"] or {}, kind["model"]
    plain = kind["normalizer"] is None and kind["post_processor"] is None and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return plain and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True) and all("<|" in t["content"] for t in kind["added_tokens"])


def _load(tokenizer_path: str, most: int = CACHE):
    """text -> ids, by a tokenizer of the tokenizers library.

    A byte-level BPE's pre-tokenizer never joins a character that is not white space with white space behind it, so texts fall apart
    at single spaces and line feeds, and the pieces, which recur, are encoded by the library once and kept. Texts with
    other white space at such places, or with what may be a special token, are encoded whole, and so is every text if the
    tokenizer is of another kind.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    if not _byte_level(tokenizer):
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    first, spaced = _Pieces(tokenizer, "", most), _Pieces(tokenizer, " ", most)
    odd = re.compile(r"\s\s|<\|")
    feed = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> np.ndarray:
        if not text or text[0].isspace() or text[-1].isspace() or odd.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        out: list[bytes] = []
        for line in text.split("\n"):
            pieces = line.split(" ")
            out.append(first[pieces[0]])
            out += map(spaced.__getitem__, pieces[1:])
            out.append(feed)
        return np.frombuffer(b"".join(out[:-1]), "<u4")

    return encode


@functools.cache
def _encoder(tokenizer_path: str):
    """The encoder that a Python worker keeps from task to task."""
    return _load(tokenizer_path)


def write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, file_rows: int = FILE_ROWS, keep: bool = True) -> DataFrame:
    """Encode every text, append end_id to each document, write files under `out`; the manifest:
    (file, part, first_id, tokens, docs, start), start being the number of ids in all files before.

    Null texts are empty and have the end id alone. Rows are ordered by id, nulls first, ties by text. An empty table
    gives an empty manifest and no file. `out` is a URI that all executors reach, such as a folder under
    spark.checkpoint.dir. Ids are 16 bits wide if the vocabulary fits, else 32. keep: whether Python workers keep the tokenizer and
    its cache for later tasks, which saves time; without, a task drops them, which leaves the memory to other work.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, -(-rows.count() // file_rows))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        files, base = pa.fs.FileSystem.from_uri(out)
        files.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        encode = width = None
        sink = writer = None
        ids_of, starts, counts, rest, kept, total, part = [], [], [], [], 0, 0, 0

        def flush(last: bool):
            nonlocal rest, kept
            flat = np.concatenate(rest) if rest else np.zeros(0, width)
            whole = len(flat) // (sequence * BATCH) * (sequence * BATCH)
            for at in range(0, len(flat) if last else whole, sequence * BATCH):
                some = flat[at : at + sequence * BATCH]
                pad = -len(some) % sequence
                mask = np.ones(len(some) + pad, bool)
                mask[len(some) :] = False
                some = np.concatenate([some, np.zeros(pad, width)])
                writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), sequence) for x in (some, mask)], ["ids", "mask"]))
            rest = [] if last else [flat[whole:]]
            kept = 0 if last else len(flat) - whole

        for batch in batches:
            if encode is None:
                encode = _encoder(tokenizer_path) if keep else _load(tokenizer_path, TASK_CACHE)
                width = np.uint16 if _vocabulary(tokenizer_path) <= 1 << 16 else np.uint32
                sink = files.open_output_stream(f"{name}.arrow")
                kind = pa.from_numpy_dtype(width)
                writer = pa.ipc.new_file(sink, pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))]))
            for i, text, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.append(encode(text.as_py()), end_id).astype(width)
                ids_of.append(i)
                starts.append(total)
                counts.append(len(ids))
                total += len(ids)
                rest.append(ids)
                kept += len(ids)
                part = p
            if kept >= sequence * BATCH:
                flush(False)
        if writer is not None:
            flush(True)
            writer.close()
            sink.close()
            index = pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "start", "n_tokens"])
            with files.open_output_stream(f"{name}.index.arrow") as f, pa.ipc.new_file(f, index.schema) as w:
                w.write_batch(index)
            stem = name.rpartition("/")[2]
            yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([part], pa.int64()), pa.array([total], pa.int64()), pa.array([len(counts)], pa.int64())], ["file", "part", "tokens", "docs"])

    manifest = cut(ordered.mapInArrow(run, "file string, part long, tokens long, docs long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _vocabulary(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def read(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document, from the files of the manifest."""
    return _read(manifest, out, False)


def read_digests(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest; ids_crc32 is the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return _read(manifest, out, True)


def _read(manifest: DataFrame, out: str, digest: bool) -> DataFrame:
    prepare(manifest.sparkSession)
    last, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    files = manifest.count()
    spread = manifest.repartition(max(1, files), "file").select("file", "start")

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}.index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                with fs.open_input_file(f"{base}/{name}.arrow") as f:
                    yield from _documents(pa.ipc.open_file(f), index, start, digest, last)

    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {kind}")


def _documents(data, index, start: int, digest: bool, last: str):
    """Batches of documents put together again from a file's sequences, a batch of sequences in memory at a time."""
    tokens = np.zeros(0, np.uint32)
    at = have = 0  # of the stream: where `tokens` begins, and which batch comes next
    ids, starts, counts = (index.column(k).to_pylist() for k in range(3))
    rows: list[tuple] = []
    for i, s, n in zip(ids, starts, counts, strict=True):
        while at + len(tokens) < s + n:
            batch = data.get_batch(have)
            more = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
            tokens = np.concatenate([tokens[s - at :], more.astype(np.uint32)])
            at, have = s, have + 1
        own = tokens[s - at : s - at + n]
        rows.append((i, start + s, n, zlib.crc32(own.astype("<u4").tobytes()) if digest else own.astype(np.int32)))
        if len(rows) >= 2000:
            yield _as_batch(rows, digest, last)
            rows = []
    if rows:
        yield _as_batch(rows, digest, last)


def _as_batch(rows, digest, last):
    i, s, n, x = zip(*rows, strict=True)
    values = pa.array(x, pa.int64() if digest else pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), values], ["doc_id", "start", "n_tokens", last])


class Sequences:
    """Random access to the sequences of one file: s[k] is (ids, mask) of the k-th, Arrow arrays of equal length.

    A local file is mapped into memory and its buffers are used as they lie there; of others the batch of the sequence is
    read. Only the file's footer is read beforehand. Places beyond the end raise IndexError.
    """

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        self.data = pa.ipc.open_file(pa.memory_map(path) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(path))
        batches = self.data.num_record_batches
        self.size = (batches - 1) * BATCH + self.data.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k: int) -> tuple[pa.Array, pa.Array]:
        if not 0 <= k < self.size:
            raise IndexError(k)
        batch = self.data.get_batch(k // BATCH)
        return batch.column(0).slice(k % BATCH, 1).flatten(), batch.column(1).slice(k % BATCH, 1).flatten()


def new_folder(spark) -> str:
    """A folder of our own in the shared folder."""
    base = shared_dir(spark)
    return f"{base if '://' in base else 'file://' + base.removeprefix('file:')}/tokens-{uuid.uuid4().hex}"
