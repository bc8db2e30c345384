"""Token ids in byte-aligned files: frequency-ranked, variable-length, with separate control bytes.

Texts are encoded where they are read, dealt out by id range and staged in id order, with the count of each
id. Ids are then ranked by how often the corpus has them, ties by id, and each rank takes one to four bytes;
two bits of a control byte say how many. Control and data bytes of a block stand apart, so a reader finds
the lengths of four values by one look into a table of 256 rows, and all values of a block with a few numpy
gathers.

A file holds blocks: a header of four little-endian 64-bit numbers (documents, ids, data bytes, bytes of the
document ids), then the documents' lengths, their ids as decimal text, the control bytes and the data bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from gaugewright.llm.ordered import NO_ID, cut_points, range_of
from gaugewright.llm.shared import opened, shared_folder, written
from gaugewright.llm.textkit import tidy

#: Ids of a block (a longer document: its own).
BLOCK_IDS = 1 << 18
#: Bytes that a worker's remembered pieces may take, about, before it begins anew; what an entry takes besides its text and ids; characters of the longest.
PIECE_BYTES = 320 << 20
ENTRY_BYTES = 190
PIECE_CHARS = 64

_LENGTHS = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_HEAD = struct.Struct("<4q")
#: Letters on which all versions of Unicode agree, then common punctuation: a pre-tokenizer cuts between the two.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = ranks.astype("<u4" if len(ranks) and ranks.max() > 0xFFFF else "<u2")
    length = 1 + (ranks > 0xFF).astype(np.uint8)
    width = ranks.itemsize
    if width == 4:
        length += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, width)[np.arange(width) < length[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of encode_ranks."""
    control = np.frombuffer(control, np.uint8)
    length = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(length) - length
    raw = np.frombuffer(data + bytes(4), np.uint8)
    out = raw[begin].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(length > j)
        if not len(more):
            break
        out[more] |= raw[begin[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out & _MASKS[length]


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain + rest, plain + list(range(256, 256 + len(rest))), strict=True))


class _Uneven(Exception):
    """A piece with white space at an end, where the place of a cut depends on what stands beside it."""


class _Pieces(dict):
    """Ids of pieces after ``lead``, found when they are first asked for, and remembered for pieces of up to PIECE_CHARS."""

    def __init__(self, tokenizer: Tokenizer, lead: str, code: str, bare: "_Pieces | None" = None):
        super().__init__()
        self.tokenizer, self.model, self.lead, self.code = tokenizer, tokenizer.model, lead, code
        self.bare = self if bare is None else bare
        self.letters = byte_letters()
        self.head = lead.translate(self.letters)
        self.line = array(code, tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.stems: dict[str, bytes] = {}
        self.bytes = 0

    def _kept(self, held: dict[str, bytes], key: str, found: bytes) -> bytes:
        if len(key) <= PIECE_CHARS:
            held[key] = found
            self.bytes += ENTRY_BYTES + (1 if key.isascii() else 4) * len(key) + len(found)
        return found

    def __missing__(self, piece: str) -> bytes:
        if plain := _PLAIN.fullmatch(piece):
            stem, tail = plain.groups()
            if (found := self.stems.get(stem)) is None:
                named = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                found = self._kept(self.stems, stem, array(self.code, [t.id for t in self.model.tokenize(self.head + named)]).tobytes())
            if tail:
                found += self.bare.tail(tail)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        elif "\n" in piece and "" not in (parts := piece.split("\n")):
            # a line feed between two other characters is a token of its own
            found = self.line.join([self[parts[0]], *(self.bare[x] for x in parts[1:])])
        else:
            found = array(self.code, self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids).tobytes()
        return self._kept(self, piece, found)

    def tail(self, marks: str) -> bytes:
        if (found := self.stems.get(marks)) is None:
            found = self._kept(self.stems, marks, array(self.code, [t.id for t in self.model.tokenize(marks)]).tobytes())
        return found

    def forget(self) -> None:
        """Begin anew; common pieces come back soon."""
        self.clear()
        self.stems.clear()
        self.bytes = 0


def _cuts_at_spaces(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer's rules are those that remembered pieces rest on."""
    model, first = tokenizer.model, tokenizer.pre_tokenizer
    plain = isinstance(model, BPE) and not any(getattr(model, k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and tokenizer.normalizer is None and isinstance(first, ByteLevel) and first.use_regex and not first.add_prefix_space


class Encoder:
    """Ids of whole texts as the tokenizer in a file gives them, as bytes of unsigned little-endian numbers of ``kind``.

    A byte-level tokenizer cuts a text before a single space between two other characters whatever stands around, and
    encodes what is between two cuts alone, so ids of such pieces are remembered, in a bounded number of bytes. Texts
    with a special token, and those with white space beside a space, or a space at an end, are encoded whole, as are
    all texts by a file of which that isn't known: any but byte-pair encoding without a normaliser or prefix space
    after the byte-level pre-tokenizer's own pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cuts = _cuts_at_spaces(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.first = _Pieces(self.tokenizer, "", code)
        self.later = _Pieces(self.tokenizer, " ", code, self.first)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cuts and not any(s in text for s in self.special):
            head, *rest = text.split(" ")
            if self.first.bytes + self.later.bytes > PIECE_BYTES:
                self.first.forget()
                self.later.forget()
            try:
                return self.first[head] + b"".join(map(self.later.__getitem__, rest))
            except _Uneven:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by a worker."""
    return Encoder(path)


def _block(docs: list[tuple[str, np.ndarray]]) -> bytes:
    """A block of documents: (id as text, ranks) of each."""
    lengths = np.array([len(x) for _, x in docs], "<i8")
    names = "\n".join(n for n, _ in docs).encode()
    control, data = encode_ranks(np.concatenate([x for _, x in docs]))
    return _HEAD.pack(len(docs), int(lengths.sum()), len(data), len(names)) + lengths.tobytes() + names + control + data


def _blocks(uri: str) -> Iterator[tuple[list[str], np.ndarray, bytes, bytes]]:
    """(document ids as text, lengths, control bytes, data bytes) of each block of a file."""
    files, path = opened(uri)
    with files.open_input_stream(path) as f:
        while head := f.read(_HEAD.size):
            docs, n, size, named = _HEAD.unpack(head)
            lengths = np.frombuffer(f.read(8 * docs), "<i8")
            names = f.read(named).decode().split("\n")
            yield names, lengths, f.read(-(-n // 4)), f.read(size)


def _save(uri: str, blocks: Iterator[bytes]) -> None:
    """Write a file under another name and move it to its own, so no reader sees a part and a second attempt replaces the first."""
    files, path = opened(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as out:
        for x in blocks:
            out.write(x)
    files.move(draft, path)


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Write the ids of each text, and an end id, in files by ascending doc_id; returns a table of the files and the id of each rank.

    The table has (part, path, n_docs, n_ids, start): files follow one another by part, and start is the number
    of ids in those before. A null or empty text is the end id alone. Rows of one doc_id keep the order of
    their texts' hashes; rows without doc_id come first. doc_id is an integer; other columns are ignored, and
    an empty table gives no files.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    cuts = cut_points(rows.select("ord"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ord", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ids", T.BinaryType())])
    kind = encoder(tokenizer).kind
    end = np.array([end_id], kind).tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, deflate = encoder(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                found = [deflate(ids(x or "") + end) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ord"), batch.column("tie"), batch.column("doc_id").cast(pa.string()).fill_null(""), pa.array(found, pa.binary())], coded.names)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, path, inflate = np.zeros(1, np.int64), 0, "", zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if not batch.num_rows:
                continue
            if not path:
                # a partition holds one range, so its first row names the file
                part = batch.column("part")[0].as_py()
                path = f"{folder}/staged-{part:06d}"
                files, name = opened(path)
                files.create_dir(name.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}")
                stream = pa.ipc.new_stream(out, pa.schema([("name", pa.string()), ("ids", pa.binary())]))
            more = np.bincount(np.frombuffer(b"".join(map(inflate, batch.column("ids").to_pylist())), kind))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
            docs += batch.num_rows
            stream.write_batch(pa.RecordBatch.from_arrays([batch.column("name"), batch.column("ids")], ["name", "ids"]))
        if path:
            stream.close()
            out.close()
            files.move(draft, name)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs]), pa.array([int(counts.sum())]), pa.array([used]), pa.array([counts[used]])], ["part", "path", "n_docs", "n_ids", "id", "times"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for ids, times in zip(batch.column("id").to_pylist(), batch.column("times").to_pylist(), strict=True):
                for i, n in zip(ids, times, strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([list(total)], pa.list_(pa.int64())), pa.array([list(total.values())], pa.list_(pa.int64()))], ["id", "times"])

    dealt = rows.withColumn("part", range_of(F.col("ord"), cuts)).withColumn("tie", F.xxhash64("text")).mapInArrow(tidy(code), coded)
    staged = written(dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("ord", "tie").mapInArrow(tidy(stage), "part int, path string, n_docs long, n_ids long, id array<long>, times array<long>"), "staged")
    # the counts of about the square root of the number of files are added before they reach the driver, each at most as long as the vocabulary
    groups = isqrt(len(cuts) + 1) + 1
    total: dict[int, int] = {}
    for row in staged.select("part", "id", "times").repartitionById(groups, "part").mapInArrow(tidy(added), "id array<long>, times array<long>").toLocalIterator():
        for i, n in zip(row["id"], row["times"], strict=True):
            total[i] = total.get(i, 0) + n
    by_rank = np.array(sorted(total, key=lambda i: (-total[i], i)), np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            paths = []
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):

                def blocks(path: str = path) -> Iterator[bytes]:
                    files, name = opened(path)
                    held, n = [], 0
                    with files.open_input_stream(name) as f:
                        for batch in pa.ipc.open_stream(f):
                            for name, x in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                                held.append((name, ranks.value[np.frombuffer(inflate(x), kind)]))
                                n += len(held[-1][1])
                                if n >= BLOCK_IDS:
                                    yield _block(held)
                                    held, n = [], 0
                    if held:
                        yield _block(held)

                paths.append(f"{folder}/ids-{part:06d}")
                _save(paths[-1], blocks())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(paths), batch.column("n_docs"), batch.column("n_ids")], ["part", "path", "n_docs", "n_ids"])

    # a row for each file, no more than there are partitions
    listed = sorted(staged.select("part", "path", "n_docs", "n_ids").collect())
    if not listed:
        return spark.createDataFrame([], "part int, path string, n_docs long, n_ids long, start long"), by_rank
    files = spark.createDataFrame(listed, "part int, path string, n_docs long, n_ids long").repartitionById(len(cuts) + 1, "part")
    made = sorted(files.mapInArrow(tidy(final), "part int, path string, n_docs long, n_ids long").collect())
    starts = np.cumsum([0, *(r["n_ids"] for r in made)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(made, starts, strict=False)], "part int, path string, n_docs long, n_ids long, start long"), by_rank


def read_token_files(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in files that write_token_files wrote; ids are unsigned 32-bit, little-endian.

    A document without an id has a null one again; a null or empty text is its end id alone; repeated rows come
    each; no files give an empty result.
    """
    spark = files.sparkSession
    ids = spark.sparkContext.broadcast(by_rank.astype("<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for names, lengths, control, data in _blocks(path):
                    found = ids.value[decode_ranks(control, data, int(lengths.sum()))]
                    ends = np.cumsum(lengths)
                    cut = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(found)])
                    yield pa.RecordBatch.from_arrays([pa.array([int(n) if n else None for n in names], pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), cut.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    start += int(ends[-1])

    count = max(1, files.count())
    return files.repartitionById(count, "part").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids binary")
