"""Benchmark decontamination by winnowing.

A k-gram is kept where its hash is the least, the rightmost of several, of a sliding window of
``window - k + 1`` k-grams, so any ``window`` consecutive words that a document shares with an item select
the same k-gram on both sides. Document fingerprints are joined with those of the benchmark; each hit is
extended word by word, and a window counts only if all its words agree. What a hit can extend to are the
words around it, so of an item's k-grams with equal words around them the index keeps one: a repeated word
is one entry however often it stands there. Items of fewer than ``window`` words are windows of their own
length, with every run of that length as fingerprint.

The benchmark is cut into blocks of about ``block_bytes`` of text (one longer item: that item), each of
which one task indexes into a file of the shared folder. A worker holds one block at a time and as many
documents as fit TEXT_BYTES, so neither driver nor executors need memory for more; documents are never
shuffled.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm import textkit
from gaugewright.llm.shared import opened, shared_folder

_BITS = 20
#: Text that is held against one block after another, where there are several; pairs of fingerprints that are extended at once.
TEXT_BYTES = 64 << 20
PAIRS = 1 << 18


def _runs(hashes: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps, of a window's least ones the rightmost; ends: of each word's text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, span = textkit.grams(hashes, k), window - k + 1
    least = gram[:n].copy()
    for j in range(1, span):
        np.minimum(least, gram[j : j + n], out=least)
    last = np.zeros(n, np.int64)
    for j in range(1, span):
        last[gram[j : j + n] == least] = j
    whole = np.arange(window, n + window) <= ends[:n]
    at = np.unique((np.arange(n) + last)[whole])
    return at, gram[at]


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[hashes & np.uint64((1 << _BITS) - 1)] = True
    return bits


def _pairs(values: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of value, index of equal key) for all equal pairs, about PAIRS at a time; keys are sorted."""
    at = np.flatnonzero(bits[values & np.uint64((1 << _BITS) - 1)])
    low, high = np.searchsorted(keys, values[at], "left"), np.searchsorted(keys, values[at], "right")
    at, low, count = at[high > low], low[high > low], (high - low)[high > low]
    upto, lo = np.cumsum(count), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - count[lo] + PAIRS, "right")))
        n, begin = count[lo:hi], np.cumsum(count[lo:hi]) - count[lo:hi]
        yield np.repeat(at[lo:hi], n), np.arange(int(n.sum())) + np.repeat(low[lo:hi] - begin, n)
        lo = hi


def index_block(ids: list[str], texts: pa.Array, window: int, k: int) -> bytes:
    """The fingerprints of a block of items, as an .npz file."""
    flat, item, at = [np.zeros(window, np.uint64)], [np.zeros(window, np.int64)], window
    keys, places, short = [], [], {n: [] for n in range(1, window)}
    for lo, hi, data, offsets in textkit.chunks(texts):
        found = textkit.words(data, offsets, textkit.ALNUM)
        for row in range(lo, hi):
            h = found.hash[found.first[row - lo] : found.first[row - lo + 1]]
            if 0 < len(h) < window:
                short[len(h)].append((textkit.grams(h, len(h))[0], row))
            elif len(h):
                p, g = _runs(h, np.full(len(h), len(h)), k, window)
                keys.append(g)
                places.append(p + at)
                flat += [h, np.zeros(window, np.uint64)]
                item += [np.full(len(h) + window, row)]
                at += len(h) + window
    keys, places = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)])
    flat, item = np.concatenate(flat), np.concatenate(item)
    # an item's places with equal words around them are one to every document
    around = textkit.mix(keys + item[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for j in range(k - window, window):
        around = textkit.mix(around * np.uint64(0xD6E8FEB86659FD93) + flat[places + j])
    first = np.sort(np.unique(around, return_index=True)[1])
    keys, places = keys[first], places[first]
    order = np.argsort(keys, kind="stable")
    out = {"ids": np.array(ids, dtype=object).astype(str), "flat": flat, "item": item, "keys": keys[order], "places": places[order], "bits": _bitmap(keys)}
    for n, pairs in short.items():
        if pairs:
            pairs.sort()
            out[f"short_{n}"] = np.array([x for x, _ in pairs], np.uint64)
            out[f"short_item_{n}"] = np.array([x for _, x in pairs], np.int64)
            out[f"short_bits_{n}"] = _bitmap(out[f"short_{n}"])
    np.savez(file := io.BytesIO(), **out)
    return file.getvalue()


def hits(found: textkit.Words, block: dict[str, np.ndarray], window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and lengths of document windows that an item holds; document and item rows that go together. A part at a time, and a window may come several times."""
    n = len(found.hash)
    doc = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    begins, ends = found.first[:-1][doc], found.first[1:][doc]
    fingerprints, gram = _runs(found.hash, ends, k, window)
    span = window - k
    padded = np.concatenate([np.ones(window, np.uint64), found.hash, np.ones(window, np.uint64)])
    around = np.arange(-span, window)
    for i, j in _pairs(gram, block["bits"], block["keys"]):
        at, place = fingerprints[i], block["places"][j]
        same = padded[at[:, None] + around + window] == block["flat"][place[:, None] + around]
        full = np.lib.stride_tricks.sliding_window_view(same, window, axis=1).all(axis=2)
        row, shift = np.nonzero(full)
        start = at[row] - span + shift
        inside = (start >= begins[at[row]]) & (start + window <= ends[at[row]])
        row, start = row[inside], start[inside]
        yield start, np.full(len(start), window), doc[at[row]], block["item"][place[row]]
    for length in range(1, window):
        if (keys := block.get(f"short_{length}")) is not None and n >= length:
            for i, j in _pairs(textkit.grams(found.hash, length), block[f"short_bits_{length}"], keys):
                inside = i + length <= ends[i]
                i, j = i[inside], j[inside]
                yield i, np.full(len(i), length), doc[i], block[f"short_item_{length}"][j]


class _Index:
    """The blocks of a benchmark, in files of the shared folder, and what texts share with them."""

    def __init__(self, benchmark: DataFrame, window: int, k: int, block_bytes: int):
        self.window, self.k = window, k
        # a repeated item says nothing new
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
        total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        self.blocks = -(-total // block_bytes)
        self.folder = folder = shared_folder(benchmark.sparkSession, "benchmark")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # repartitionById gives a task one block
            held = [x for x in batches if x.num_rows]
            if not held:
                return
            part = pa.Table.from_batches(held).sort_by([("item_id", "ascending"), ("text", "ascending")])
            files, path = opened(f"{folder}/{part['block'][0].as_py()}.npz")
            files.create_dir(path.rpartition("/")[0], recursive=True)
            with files.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as out:
                out.write(index_block(["" if x is None else f"={x}" for x in part["item_id"].to_pylist()], part["text"].combine_chunks(), window, k))
            files.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["n"])

        if self.blocks:
            block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)).cast("int")
            items.withColumn("block", block).repartitionById(self.blocks, "block").mapInArrow(textkit.tidy(write), "n long").agg(F.sum("n")).first()

    def load(self, b: int) -> dict[str, np.ndarray] | None:
        """A block; None if no item fell to it."""
        files, path = opened(f"{self.folder}/{b}.npz")
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return dict(np.load(io.BytesIO(f.read())))

    def grouped(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of up to TEXT_BYTES where there are several blocks, so a block is loaded once for so much text; else as they come, a few rows at a time."""
        if self.blocks <= 1:
            yield from textkit.slices(batches)
            return
        held, size = [], 0
        for batch in textkit.slices(batches):
            if held and size + batch.nbytes > TEXT_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def scan(self, texts: pa.Array, only: dict[str, np.ndarray] | None) -> tuple[np.ndarray, list[set[str]], list[np.ndarray]]:
        """(number of words, items, sorted places of hit words) of each text; only: the block, if there is one."""
        rows = len(texts)
        n_words, marks, names = np.zeros(rows, np.int64), [[] for _ in range(rows)], [set() for _ in range(rows)]
        for b in range(max(self.blocks, 1)):
            block = only or (self.load(b) if self.blocks else None)
            for lo, hi, data, offsets in textkit.chunks(texts):
                found = textkit.words(data, offsets, textkit.ALNUM)
                n_words[lo:hi] = np.diff(found.first)
                if block is None or not len(found.hash):
                    continue
                change, met = np.zeros(len(found.hash) + 1, np.int64), set()
                for start, length, doc, item in hits(found, block, self.window, self.k):
                    np.add.at(change, start, 1)
                    np.add.at(change, start + length, -1)
                    met.update(np.unique(doc * len(block["ids"]) + item).tolist())
                if not met:
                    continue
                for x in met:
                    names[lo + x // len(block["ids"])].add(str(block["ids"][x % len(block["ids"])]))
                hit = np.cumsum(change)[:-1] > 0
                for d in {x // len(block["ids"]) for x in met}:
                    marks[lo + d].append(np.flatnonzero(hit[found.first[d] : found.first[d + 1]]))
        return n_words, names, [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in marks]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words in a shared window), items (their ids as strings, sorted) and runs (first hit word, word after the last).

    Words are runs of ASCII letters and digits and non-ASCII characters, in lower case for A-Z. A null or
    empty text has no words and no hit, as has a benchmark without words. Every row has its own result, so
    repeated rows give repeated results; items with one id count as one, and those without an id as
    none, though their words are hit. Other columns of either table are ignored.
    """
    index = _Index(benchmark, window, k, block_bytes)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType())))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = index.load(0) if index.blocks == 1 else None
        for batch in index.grouped(batches):
            n_words, names, marks = index.scan(batch.column("text"), only)
            runs = [[[int(x[0]), int(x[-1]) + 1] for x in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)] if len(at) else [] for at in marks]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array([len(x) for x in marks], pa.int64()), pa.array([sorted(i[1:] for i in x if i) for x in names], pa.list_(pa.string())), pa.array(runs, pa.list_(pa.list_(pa.int64())))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(textkit.tidy(find), schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all columns, that share no window with the benchmark.

    A null or empty text stays, repeated rows stay or go each, an empty table of either kind changes nothing;
    columns may have any names.
    """
    index = _Index(benchmark, window, k, block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = index.load(0) if index.blocks == 1 else None
        for batch in index.grouped(batches):
            yield batch.filter(pa.array([not len(x) for x in index.scan(batch.column("text"), only)[2]], pa.bool_()))

    return docs.mapInArrow(textkit.tidy(keep), docs.schema)
