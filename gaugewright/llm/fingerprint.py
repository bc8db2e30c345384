"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, a long one cut after words that its own words choose, so an edit moves
no cut but those beside it. Each paragraph digest, with its number of occurrence, goes to one cell in each
of three sub-tables; a cell holds a count, a sum of digests and a sum of check values. The sketches of two
versions subtract cell by cell; cells that hold a single digest are peeled until nothing is left, which
recovers the digests that only one version has. If the sketch is too small for that, both are built again
four times as large.

A stored sketch grows with its text's number of paragraphs in steps of four, at about one cell for five to
twenty of them, so two fingerprints alone give away a difference of some 4 to 15 % of the larger text's
paragraphs, and of about 20 in a short one. A larger sketch folds to a smaller one's size, as cells are taken
by the low bits of a hash. ``compared`` reads two stored fingerprints; a greater difference needs both texts,
from which ``likeness`` builds larger sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm import textkit
from gaugewright.llm.ordered import NO_ID, cut_points, range_of

#: Least cells of a sub-table of the stored sketch; paragraphs for which a sub-table has a cell at least; growth of a retry; a word ends a paragraph piece if its hash is a multiple of CUT; most words of a piece; bytes of a word, longer ones are several.
CELLS = 8
SPREAD = 64
GROWTH = 4
CUT = 4
PIECE = 16
LONGEST = 16
_TEXT_BYTES = 4 << 20


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digests, first): the paragraph digests of text i, each with its number of occurrence, are digests[first[i]:first[i+1]]."""
    out, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in textkit.chunks(texts, _TEXT_BYTES):
        found = textkit.words(data, offsets, textkit.NONSPACE, LONGEST)
        n = len(found.hash)
        if not n:
            counts.append(np.zeros(len(offsets) - 1, np.int64))
            continue
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.ones(n, bool)
        opens[1:] = (lines[found.start[1:]] != lines[found.end[:-1]]) | (found.hash[:-1] % np.uint64(CUT) == 0)
        opens[found.first[:-1][found.first[:-1] < n]] = True
        begin = np.flatnonzero(opens)
        place = (np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))) % PIECE
        begin = np.flatnonzero(place == 0)
        digest = np.add.reduceat(textkit.mix(found.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
        first = np.searchsorted(begin, found.first)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        order = np.lexsort((digest, text))
        same = np.zeros(len(digest), bool)
        same[1:] = (digest[order][1:] == digest[order][:-1]) & (text[order][1:] == text[order][:-1])
        since = np.arange(len(digest))
        since -= np.maximum.accumulate(np.where(same, 0, since))
        out.append(textkit.mix(digest[order] + since.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        counts.append(np.diff(first))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)


class Cells:
    """Sketches of many texts, or differences of such: three sub-tables of ``size`` cells a text."""

    def __init__(self, texts: int, size: int, seed: int):
        self.size, self.seed = size, np.uint64(seed)
        self.count = np.zeros(texts * 3 * size, np.int64)
        self.total = np.zeros(texts * 3 * size, np.uint64)
        self.check = np.zeros(texts * 3 * size, np.uint64)

    def add(self, text: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
        """Add (sign 1) or subtract (-1) digests of texts."""
        value = np.where(sign > 0, digest, -digest)
        check = textkit.mix(digest ^ np.uint64(0xE7037ED1A0B428DB))
        check = np.where(sign > 0, check, -check)
        for at in self.places(text, digest):
            np.add.at(self.count, at, sign)
            np.add.at(self.total, at, value)
            np.add.at(self.check, at, check)

    def places(self, text: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
        mixed = textkit.mix(digest + self.seed)
        return [text * 3 * self.size + j * self.size + ((mixed >> np.uint64(20 * j)) % np.uint64(self.size)).astype(np.int64) for j in range(3)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, digest, sign) of all that single cells give away; what cannot be recovered stays in the cells."""
        texts, digests, signs = [], [], []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            sign = self.count[live]
            digest = np.where(sign > 0, self.total[live], -self.total[live])
            check = textkit.mix(digest ^ np.uint64(0xE7037ED1A0B428DB))
            pure = np.where(sign > 0, check, -check) == self.check[live]
            text, digest, sign = live[pure] // (3 * self.size), digest[pure], sign[pure]
            order = np.lexsort((digest, text))
            text, digest, sign = text[order], digest[order], sign[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
            text, digest, sign = text[new], digest[new], sign[new]
            if not len(text):
                break
            self.add(text, digest, -sign)
            texts.append(text)
            digests.append(digest)
            signs.append(sign)
            touched = np.unique(np.concatenate(self.places(text, digest)))
            live = touched[np.abs(self.count[touched]) == 1]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *texts]), np.concatenate([none.astype(np.uint64), *digests]), np.concatenate([none, *signs])

    def left(self) -> np.ndarray:
        """Whether a text's cells hold anything still."""
        return ((self.count != 0) | (self.total != 0) | (self.check != 0)).reshape(-1, 3 * self.size).any(axis=1)


def stored_size(paragraphs: np.ndarray) -> np.ndarray:
    """Cells of a sub-table of the stored sketches of texts of so many paragraphs: CELLS, times GROWTH as often as they need."""
    size = np.full(len(paragraphs), CELLS, np.int64)
    while (small := size * SPREAD < paragraphs).any():
        size[small] *= GROWTH
    return size


def _slices(digests: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position among rows, digest) of all digests of some texts."""
    length = first[rows + 1] - first[rows]
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin - first[rows], length)
    return np.repeat(np.arange(len(rows)), length), digests[at]


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pair, digest, sign) of the digests that only a's text left[i] (1) or only b's text right[i] (-1) has, and the number of retries.

    The first try has the cells of the stored sketches, the larger folded to the smaller's size.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    sizes = np.minimum(*(stored_size(first[rows + 1] - first[rows]) for (_, first), rows in ((a, left), (b, right))))
    waiting, tries = np.arange(len(left)), 0
    while len(waiting):
        stuck = np.zeros(len(left), bool)
        for size in np.unique(sizes[waiting]).tolist():
            some = waiting[sizes[waiting] == size]
            cells = Cells(len(some), size, seed=tries)
            for side, rows, sign in ((a, left, 1), (b, right, -1)):
                text, digest = _slices(*side, rows[some])
                cells.add(text, digest, np.full(len(text), sign))
            text, digest, sign = cells.peel()
            stuck[some] = cells.left()
            keep = ~stuck[some[text]]
            found.append((some[text[keep]], digest[keep], sign[keep]))
        waiting, tries = waiting[stuck[waiting]], tries + 1
        sizes *= GROWTH
    return *(np.concatenate(x) for x in zip(*found, strict=True)), tries - 1


def _near(sizes: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all, from the paragraphs of both texts together and those that only one has; 1 without any."""
    shared = (sizes - only) / 2
    return np.where(sizes > 0, shared / np.maximum(shared + only, 1), 1.0)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all paragraphs of both, for pairs of texts, from the recovered difference; 1 for two without any."""
    pair, _, sign, _ = differences(a, b, left, right)
    sizes = (a[1][left + 1] - a[1][left]) + (b[1][right + 1] - b[1][right])
    return _near(sizes, np.bincount(pair, minlength=len(left)))


_CELL = np.dtype([("count", "<u4"), ("total", "<u8"), ("check", "<u8")])


def sketches(digests: np.ndarray, first: np.ndarray) -> list[str]:
    """The stored form of each text's sketch: number of paragraphs, then the cells (count, digest sum, check sum) in base64."""
    out, sizes = [""] * (len(first) - 1), stored_size(np.diff(first))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        cells = Cells(len(rows), size, seed=0)
        text, digest = _slices(digests, first, rows)
        cells.add(text, digest, np.ones(len(text), np.int64))
        raw = np.zeros((len(rows), 3 * size), _CELL)
        raw["count"], raw["total"], raw["check"] = (x.reshape(len(rows), -1) for x in (cells.count.astype(np.uint32), cells.total, cells.check))
        for i, k, row in zip(rows.tolist(), np.diff(first)[rows].tolist(), raw, strict=True):
            out[i] = f"{k}:{base64.b64encode(row.tobytes()).decode()}"
    return out


def read_sketch(stored: str) -> tuple[int, Cells]:
    """(paragraphs, cells) of a stored sketch."""
    paragraphs, _, data = stored.partition(":")
    raw = np.frombuffer(base64.b64decode(data), _CELL)
    cells = Cells(1, len(raw) // 3, seed=0)
    cells.count, cells.total, cells.check = raw["count"].astype(np.int64), raw["total"].copy(), raw["check"].copy()
    return int(paragraphs), cells


def _folded(cells: Cells, size: int) -> Cells:
    out = Cells(1, size, seed=0)
    for name in ("count", "total", "check"):
        setattr(out, name, getattr(cells, name).reshape(3, -1, size).sum(axis=1, dtype=getattr(cells, name).dtype).reshape(-1))
    return out


def compared(a: str, b: str) -> tuple[list[int], list[int], float] | None:
    """(paragraph digests that only a's text has, those that only b's has, likeness) from two stored fingerprints alone; None if they differ in more than the sketches hold."""
    (n, left), (m, right) = read_sketch(a), read_sketch(b)
    size = min(left.size, right.size)
    left, right = _folded(left, size), _folded(right, size)
    for name in ("count", "total", "check"):
        setattr(left, name, getattr(left, name) - getattr(right, name))
    _, digest, sign = left.peel()
    if left.left()[0]:
        return None
    return digest[sign > 0].tolist(), digest[sign < 0].tolist(), float(_near(np.array([n + m]), np.array([len(digest)]))[0])


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, halo, doc_id, text), each partition sorted by id; a halo row repeats the last row of the range before.

    After the last document in descending order comes the first: the lowest range gets the row of the highest id.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"))
    cuts = cut_points(rows.select("ord"), parts)
    rows = rows.withColumn("part", range_of(F.col("ord"), cuts))
    last = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("ord")).collect()}  # a row for each partition
    held = sorted(last)
    after = {last[p]: held[(i + 1) % len(held)] for i, p in enumerate(held)}
    to = F.lit(None).cast("int")
    if held:
        ends = F.create_map(*[F.lit(x) for k, v in after.items() for x in (k, v)])
        to = F.element_at(ends, F.col("ord"))
    own = F.struct(F.col("part"), F.lit(False).alias("halo"))
    dealt = rows.withColumn("place", F.explode(F.when(to.isNull(), F.array(own)).otherwise(F.array(own, F.struct(to.alias("part"), F.lit(True).alias("halo"))))))
    dealt = dealt.select("place.part", "place.halo", "doc_id", "ord", "text").withColumn("tie", F.xxhash64("text"))
    return dealt.repartitionById(max(len(cuts) + 1, 1), "part").sortWithinPartitions("part", F.desc("halo"), "ord", "tie").select("halo", "doc_id", "text")


def version_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edited version, and how alike sketches of both, and of the next document, are.

    For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. near_*
    are what ``compared`` gives for the fingerprints, and where it gives None, what larger sketches do. The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    text by descending doc_id (after the last: the first; the text itself if it is the only one). A null text
    is empty; the sketch of an empty or blank text is empty, and two of them are alike to 1. Rows of one doc_id
    stand in the order of their texts' hashes; rows without doc_id come last. Equal texts have equal
    fingerprints. doc_id is an integer; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = ""
        for batch in batches:
            halo, text = batch.column("halo").to_numpy(zero_copy_only=False), batch.column("text")
            for lo, hi, _, _ in textkit.chunks(text, _TEXT_BYTES):
                all_texts = [before, *(x or "" for x in text.slice(lo, hi - lo).to_pylist())]
                before = all_texts[-1]
                rows = np.flatnonzero(~halo[lo:hi]) + 1
                if not len(rows):
                    continue
                edited = [t[: len(t) - len(t) // 3] + all_texts[i - 1][: len(t) // 3] for i in rows.tolist() for t in (all_texts[i],)]
                plain, changed = paragraphs(pa.array(all_texts, pa.large_string())), paragraphs(pa.array(edited, pa.large_string()))
                own = sketches(*plain)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows - 1)), pa.array([len(all_texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([own[i] for i in rows]), pa.array(sketches(*changed)),
                    pa.array(likeness(plain, changed, rows, np.arange(len(rows)))), pa.array(likeness(plain, plain, rows, rows - 1)),
                ], schema.names)

    return with_next(docs, parts).mapInArrow(textkit.tidy(fingerprints), schema)
