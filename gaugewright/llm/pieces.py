"""Encoding with a SentencePiece vocabulary by Aho-Corasick and Viterbi, and decoding.

An automaton of all pieces reads a text once; at each position the output links give every piece that ends
there, the longest first, and each relaxes the best score of a segmentation up to that position. A character
that is no piece of its own falls back to its bytes, at a score below that of any piece. No piece has a
space mark after another character, so a text is a row of units, each of marks and then other characters,
and the segmentations of units are remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugewright.llm.textkit import slices, tidy

MARK = "▁"
#: Units that a task remembers before it begins anew, and characters of the longest: together some 100 MB at most.
UNITS = 250_000
UNIT_CHARS = 48
_UNIT = re.compile(r" +[^ ]*")


class Vocabulary(dict):
    """Ids of units after their first space, found when first asked for, and remembered for units of up to UNIT_CHARS; bytes of unsigned 32-bit little-endian numbers."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ids = range(self.size)
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.normal = {model.id_to_piece(i): i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = [model.get_score(i) for i in ids]
        self.unknown = min(self.score) - 10
        self.unknown_id = model.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece with a space mark after another character would join units")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.automaton.add_word(p, (len(p), self.score[i], i))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in self.normal if len(p) == 1)
        named = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.normal.items()}
        self.raw = [named.get(i, b"") for i in ids]

    def segmented(self, unit: str) -> tuple[float, list[int]]:
        """The best score of a space and a unit, and the ids of that segmentation; of equal scores that with the longer last piece."""
        text = MARK + unit.replace(" ", MARK)
        n = len(text)
        best, length, piece = [0.0] + [-float("inf")] * n, [0] * (n + 1), [0] * (n + 1)
        if n > 1000:  # a tenth of the memory
            best, length, piece = array("d", best), array("i", length), array("i", piece)
        # a mark in the text itself is no space
        alone = [k for k, c in enumerate(unit, 1) if c == MARK or c != " " and c not in self.single]
        if not alone:
            for end, (size, score, i) in self.automaton.iter(text):
                if (total := best[end + 1 - size] + score) > best[end + 1]:
                    best[end + 1], length[end + 1], piece[end + 1] = total, size, i
        else:
            # at such a character the segmentation up to it is complete: no piece crosses a mark in the text, another may end at it or go on
            own, waiting = {k for k in alone if unit[k - 1] == MARK}, iter([*alone, n])
            next_alone = next(waiting)
            for end, (size, score, i) in self.automaton.iter(text):
                while next_alone < end:
                    self._fall_back(best, length, piece, next_alone)
                    next_alone = next(waiting)
                if any(k in own for k in range(max(1, end + 1 - size), end + 1)):
                    continue
                if (total := best[end + 1 - size] + score) > best[end + 1]:
                    best[end + 1], length[end + 1], piece[end + 1] = total, size, i
            while next_alone < n:
                self._fall_back(best, length, piece, next_alone)
                next_alone = next(waiting)
        out: list[int] = []
        at = n
        while at:
            if piece[at] < 0:
                out += [self.byte.get(b, self.unknown_id) for b in reversed(text[at - 1].encode())] if self.byte else [self.unknown_id]
            else:
                out.append(piece[at])
            at -= length[at]
        return best[n], out[::-1]

    def _fall_back(self, best: list[float], length: list[int], piece: list[int], k: int) -> None:
        if (total := best[k] + self.unknown) > best[k + 1]:
            best[k + 1], length[k + 1], piece[k + 1] = total, 1, -1

    def __missing__(self, unit: str) -> bytes:
        found = array("I", self.segmented(unit)[1]).tobytes()
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text; none for an empty one."""
        if not text:
            return b""
        units = text.split(" ") if "  " not in text and text[0] != " " else [x[1:] for x in _UNIT.findall(f" {text}")]
        return b"".join(map(self.__getitem__, units))

    def decode(self, ids: bytes) -> str:
        """The text of encode's ids: pieces and bytes joined, without the mark that stands before every text."""
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode()[1:] if ids else ""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, kept by a worker."""
    return Vocabulary(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs: ids as unsigned 32-bit little-endian numbers.

    A null or empty text has no ids. decoded gives back every text that is valid Unicode, whatever white space
    or space marks it has. Repeated rows are encoded each; other columns are ignored, and an empty table gives
    an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in slices(batches, 1000):
            found = [words.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], schema.names)
        words.clear()

    return docs.select("doc_id", "text").mapInArrow(tidy(encode), schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """All columns of rows, and text: that of the column ids; null ids give a null text, and a column text that rows had goes.

    Repeated rows are decoded each; an empty table gives an empty result.
    """
    rows = rows.drop("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in slices(batches, 1000):
            texts = pa.array([None if x is None else words.decode(x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema.names)

    return rows.mapInArrow(tidy(decode), schema)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text_sha256) for each row of docs, text_sha256 that of the text decoded from the ids.

    What encoded and then decoded give, in one Python worker a task: a null or empty text has no ids and the
    hash of the empty text, repeated rows come each, an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("text_sha256", T.StringType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in slices(batches, 1000):
            found = [words.encode(x or "") for x in batch.column("text").to_pylist()]
            hashes = [hashlib.sha256(words.decode(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary()), pa.array(hashes, pa.string())], schema.names)
        words.clear()

    return docs.select("doc_id", "text").mapInArrow(tidy(code), schema)
