"""Personal data: patterns, and terms that give protected entities away.

E-mail and network addresses, card and phone numbers are found by pattern; each distinct value is a protected
entity, and so is what its holder shares with others: an address's domain, the network of 256 addresses, a
phone number without its last four digits. Over the corpus, the documents that hold an entity and a word are
counted: a term's point-wise mutual information with an entity, as a share of the entity's own information, is
its disclosure, 1 where the term is never without the entity. A term counts only where different texts enough
have both, and where so many by chance would be far less likely than one document in the corpus. A term that
reaches the threshold for any entity is sensitive in every document, with that entity or without, and is
generalised there, or removed where it all but names the entity.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm import textkit
from gaugewright.llm.shared import opened, shared_folder, written

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts that a term must share with an entity; disclosure from which a term is generalised, and removed.
LEAST_TEXTS = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Bits of surprise beyond those of one document that the texts with both a term and an entity must have: texts times the entity's bits.
CHANCE_BITS = 8.0
#: Rows of a dictionary file, of which a worker holds one; text that is held against one file after another, where there are several.
DICTIONARY_ROWS = 2_000_000
TEXT_BYTES = 64 << 20
#: Most candidate terms that workers hold to count; more are joined by shuffle.
TERMS = 4_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: from its first digit it would match too
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; each @ looks back over its local part once, so a long run of word characters costs no more than its length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    """Whether a card number's check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind, then from left to right without overlap within a kind; matches that fail a kind's test are dropped."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


class Outside(NamedTuple):
    """Words of a text that are outside of its base spans: hashes, and code points."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def outside(text: str, spans: list[tuple[str, int, int]]) -> Outside:
    raw = np.frombuffer(text.encode(), np.uint8)
    found = textkit.words(raw, np.array([0, len(raw)]), textkit.ALNUM)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    start, end = point[found.start], point[found.end]
    inside = np.zeros(len(text) + 1, np.int64)
    for _, s, e in spans:
        inside[s] += 1
        inside[e] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(inside) > 0)])
    free = covered[end] == covered[start]
    return Outside(found.hash[free], start[free], end[free])


def _names(kind: str, value: str) -> list[str]:
    """A value as it is compared, and what its holder shares with others."""
    if kind == "email":
        return [f"email:{value.lower()}", f"domain:{value.lower().rpartition('@')[2]}"]
    if kind == "ip":
        return [f"ip:{value}", f"network:{value.rpartition('.')[0]}"]
    digits = _NOT_DIGITS.sub("", value)
    return [f"{kind}:{digits}", f"exchange:{digits[:-4]}"] if kind == "phone" else [f"{kind}:{digits}"]


def entities(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Hashes of the distinct entities that spans of a text mention."""
    names = [n.encode() for k, s, e in spans for n in _names(k, text[s:e])]
    data, ends = np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(x) for x in names])
    return np.unique(textkit.words(data, np.concatenate([[0], ends]), np.ones(256, bool)).hash)


def _mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash of the text, distinct entities, distinct words) of each document that mentions an entity."""
    for batch in textkit.slices(batches):
        texts = [t for t in batch.column("text").to_pylist() if t]
        some = [(t, spans) for t in texts if (spans := base_spans(t))]
        named, terms = [entities(t, spans).view(np.int64) for t, spans in some], []
        column = pa.array([t for t, _ in some], pa.large_string())
        for _, _, data, offsets in textkit.chunks(column):
            found = textkit.words(data, offsets, textkit.ALNUM)
            terms += [np.unique(found.hash[lo:hi]).view(np.int64) for lo, hi in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]
        copy = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t, _ in some]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(copy, pa.int64()), pa.array(named, kind), pa.array(terms, kind)], ["copy", "entities", "terms"])


def _bits(terms: np.ndarray) -> np.ndarray:
    """Low bits that any of the terms has."""
    bits = np.zeros(1 << 20, bool)
    bits[terms & np.uint64((1 << 20) - 1)] = True
    return bits


def _among(hashes: np.ndarray, terms: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are terms, and those terms' places; terms are sorted."""
    at = np.flatnonzero(bits[hashes & np.uint64((1 << 20) - 1)])
    place = np.minimum(np.searchsorted(terms, hashes[at]), len(terms) - 1)
    hit = terms[place] == hashes[at]
    return at[hit], place[hit]


def _counter(terms: np.ndarray):
    """A function from texts to (term, documents with it) of a partition, for sorted terms."""
    bits = _bits(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, _, data, offsets in textkit.chunks(batch.column("text")):
                found = textkit.words(data, offsets, textkit.ALNUM)
                at, place = _among(found.hash, terms, bits)
                doc = np.searchsorted(found.first, at, side="right")
                times += np.bincount(np.unique(doc * len(terms) + place) % len(terms), minlength=len(terms))
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(times[some])], ["term", "docs"])

    return count


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it) of all words, a batch at a time."""
    for batch in batches:
        for _, _, data, offsets in textkit.chunks(batch.column("text"), 8 << 20):
            found = textkit.words(data, offsets, textkit.ALNUM)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
            order = np.lexsort((doc, found.hash))
            h, d = found.hash[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            term, times = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], ["term", "docs"])


def disclosures(docs: DataFrame) -> DataFrame:
    """(entity, term, n_both, n_term, n_entity, disclosure) of terms that reach GENERALISE for an entity, from the co-occurrence in all of docs."""
    docs = docs.select("text")
    n = docs.count()
    found = docs.mapInArrow(textkit.tidy(_mentioned), "copy long, entities array<long>, terms array<long>")
    # a row for each distinct text
    texts = written(found.groupBy("copy").agg(F.count("*").alias("docs"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "mentions")
    counts = [F.sum("docs").alias("n"), F.count("*").alias("texts")]
    held = texts.select("docs", F.explode("entities").alias("entity")).groupBy("entity").agg(*counts)
    held = written(held.where((F.col("texts") >= LEAST_TEXTS) & (F.col("n") < n)).select("entity", F.col("n").alias("n_entity")), "entities")
    # by text, not by entity: one that many texts mention would gather all their words
    named = texts.select("copy", F.explode("entities").alias("entity")).join(held.select("entity"), "entity").groupBy("copy").agg(F.collect_list("entity").alias("entities"))
    named = texts.drop("entities").join(named, "copy").select("docs", "terms", F.explode("entities").alias("entity"))
    both = named.select("docs", "entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(*counts).where(F.col("texts") >= LEAST_TEXTS)
    bits = F.log2(F.lit(float(n)) / F.col("n_entity"))
    both = both.join(held, "entity").where(F.col("texts") * bits >= log2(max(n, 1)) + CHANCE_BITS)
    # a term stands in no fewer documents than in those that mention some entity, which bounds its disclosure before it is counted in all
    least = texts.select("docs", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("docs").alias("n_least"))
    both = both.join(least, "term").where(1 - F.log2(F.col("n_least") / F.col("n")) / bits >= GENERALISE)
    both = written(both.select("entity", "term", "n_entity", F.col("n").alias("n_both")), "shared")
    terms = both.select("term").distinct()
    if not (size := terms.count()):
        return docs.sparkSession.createDataFrame([], "entity long, term long, n_both long, n_term long, n_entity long, disclosure double")
    # at most TERMS, by count; more candidates meet the counts of all words by shuffle
    some = np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64)) if size <= TERMS else None
    times = docs.mapInArrow(textkit.tidy(_count_all if some is None else _counter(some)), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("n_term"))
    found = both.join(times, "term").withColumn("disclosure", 1 - F.log2(F.col("n_term") / F.col("n_both")) / bits)
    return found.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "n_both", "n_term", "n_entity", "disclosure")


class Dictionary:
    """Sensitive terms with their greatest disclosure, in files of the shared folder by hash of the term; a worker holds one file at a time."""

    def __init__(self, docs: DataFrame):
        table = written(disclosures(docs).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosures")
        self.files = files = -(-table.count() // DICTIONARY_ROWS)
        self.folder = folder = shared_folder(docs.sparkSession, "dictionary")
        self._held: tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # repartitionById gives a task one file
            held = [x for x in batches if x.num_rows]
            if not held:
                return
            part = pa.Table.from_batches(held)
            system, path = opened(f"{folder}/{part['file'][0].as_py()}.npz")
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as out:
                np.savez(data := io.BytesIO(), term=part["term"].to_numpy(), disclosure=part["disclosure"].to_numpy())
                out.write(data.getvalue())
            system.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["n"])

        if files:
            table.withColumn("file", F.pmod(F.xxhash64("term"), F.lit(files)).cast("int")).repartitionById(files, "file").mapInArrow(textkit.tidy(write), "n long").agg(F.sum("n")).first()

    def grouped(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of up to TEXT_BYTES where there are several files, so a file is loaded once for so much text; else a few rows at a time."""
        held, size = [], 0
        for batch in textkit.slices(batches):
            if held and size + batch.nbytes > (TEXT_BYTES if self.files > 1 else 0):
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted terms of a file, their disclosures and low bits."""
        if self._held is None or self._held[0] != b:
            files, path = opened(f"{self.folder}/{b}.npz")
            if files.get_file_info(path).type == fs.FileType.NotFound:  # no term fell to it
                held = {"term": np.zeros(0, np.int64), "disclosure": np.zeros(0)}
            else:
                with files.open_input_stream(path) as f:
                    held = np.load(io.BytesIO(f.read()))
            terms, disclosure = held["term"].view(np.uint64), held["disclosure"]
            order = np.argsort(terms)
            self._held = (b, (terms[order], disclosure[order], _bits(terms)))
        return self._held[1]

    def spans(self, texts: pa.Array) -> list[list[tuple[str, int, int, float]]]:
        """For each text its base spans (disclosure 1), then the terms outside of them, each (kind, start, end, disclosure)."""
        sensitive: list[dict[int, float]] = [{} for _ in range(len(texts))]
        for b in range(self.files):
            terms, disclosure, bits = self._block(b)
            if not len(terms):
                continue
            for lo, _, data, offsets in textkit.chunks(texts):
                found = textkit.words(data, offsets, textkit.ALNUM)
                at, place = _among(found.hash, terms, bits)
                row = np.searchsorted(found.first, at, side="right") - 1 + lo
                for r, i in np.unique(np.stack([row, place]), axis=1).T.tolist():
                    sensitive[r][int(terms[i])] = float(disclosure[i])
        out = []
        for i, by in enumerate(sensitive):
            text = texts[i].as_py() or ""
            base = base_spans(text)
            spans = [(*s, 1.0) for s in base]
            if by:
                m = outside(text, base)
                hit = np.flatnonzero(np.isin(m.hash, np.array(list(by), np.uint64)))
                spans += [("term", int(m.start[j]), int(m.end[j]), by[int(m.hash[j])]) for j in hit]
            out.append(spans)
        return out


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs; spans: kind, start, end (code points, end exclusive) and disclosure.

    By kind in the order email, ip, card, phone, term, then by start. A null or empty text has none; repeated
    rows have the same; an empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    dictionary = Dictionary(docs)
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disclosure", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(kind))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disclosure", pa.float64())]))
        for batch in dictionary.grouped(batches):
            found = [[dict(zip(("kind", "start", "end", "disclosure"), s, strict=True)) for s in spans] for spans in dictionary.spans(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, typed)], ["doc_id", "spans"])

    return docs.mapInArrow(textkit.tidy(find), schema)


def cleaned(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with base spans and weaker terms as their kind in brackets, and without terms that reach REMOVE; of overlapping spans the first, then the longest."""
    out, last = [], 0
    for kind, s, e, d in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e <= last:
            continue
        out.append(text[last : max(s, last)])
        out.append("" if kind == "term" and d >= REMOVE else f"[{kind.upper()}]")
        last = e
    return "".join([*out, text[last:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """All columns of docs, the text without what personal_data finds; ``n_chars``, if there is one, counts its code points.

    A null text stays null, with its n_chars; repeated rows are cleaned alike; an empty table gives an empty
    result; other columns stay as they are, whatever their names.
    """
    dictionary = Dictionary(docs)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in dictionary.grouped(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [cleaned(t, found) if found else t for t, found in zip(columns["text"].to_pylist(), dictionary.spans(columns["text"]), strict=True)]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(textkit.tidy(clean), schema)
