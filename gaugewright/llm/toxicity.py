"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its first bytes, so inflected forms
of a stem share most of it. Filters of several widths run over a text's embeddings, each keeps its greatest
value, and a logistic unit weighs them. The gradient of a text reaches only the words at those greatest
values, which makes a step cheap however long the text is. Scores are calibrated on labelled rows that
training left aside, for the share of toxic rows among all labels, and each language gets a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm import textkit
from gaugewright.llm.shared import removed, written_at

#: Numbers of first bytes of a word that are hashed besides the whole word; buckets; dimensions; filters of each width.
HEADS = (4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Texts of the sample that a bucket must be in to have an embedding.
LEAST_TEXTS = 3
#: Rows and bytes of texts that one model learns in turn. Of more, parts learn side by side and are averaged after each round.
PART_ROWS = 8192
PART_BYTES = 32 << 20
#: Ranges of buckets in which parts are averaged.
RANGES = 64
_PAD = max(WIDTHS)
_BLOCKS = [(w, k) for w in WIDTHS for k in range(w)]


@dataclass
class Model:
    """Embeddings, filters (a column block for each width and place in it), their biases, and the logistic unit; then the calibration."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buckets of each word, first words of each text) for chunks of texts."""
    for lo, hi, data, offsets in textkit.chunks(texts, 1 << 18):
        found = textkit.words(data, offsets, textkit.ALNUM, heads=HEADS)
        hashes = [found.hash, *(h + np.uint64(k << 56 | 0x9E3779B97F4A7C) for k, h in zip(HEADS, found.heads, strict=True))]
        yield lo, hi, np.stack([(h >> np.uint64(40)).astype(np.int64) % BUCKETS for h in hashes], axis=1).astype(np.int32).reshape(-1, len(hashes)), found.first


def _pooled(model: Model, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded embeddings, row of each word in them, filter values, greatest value of each text and filter)."""
    texts, length = len(first) - 1, np.diff(first)
    rows = np.arange(len(buckets)) + _PAD * np.repeat(np.arange(texts), length)
    x = np.zeros((len(buckets) + _PAD * texts + _PAD, DIMENSIONS), np.float32)
    total = model.embedding[buckets[:, 0]]
    for j in range(1, buckets.shape[1]):
        total += model.embedding[buckets[:, j]]
    x[rows] = total
    part = x @ model.filters
    n = len(x) - _PAD
    values = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    block = 0
    for i, w in enumerate(WIDTHS):
        out = values[:, i * FILTERS : (i + 1) * FILTERS]
        out[:] = part[:n, block * FILTERS : (block + 1) * FILTERS]
        for k in range(1, w):
            out += part[k : n + k, (block + k) * FILTERS : (block + k + 1) * FILTERS]
        block += w
    # a window may begin at the first pad, which an empty text has too, but not at the others
    begin = first[:-1] + _PAD * np.arange(texts)
    for j in range(1, _PAD):
        values[begin + length + j] = -np.inf
    return x, rows, values, np.maximum.reduceat(values, begin, axis=0)


def logits(model: Model, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Uncalibrated logit of each text."""
    top = _pooled(model, buckets, first)[3]
    return np.maximum(top + model.bias, 0) @ model.weight + model.offset


def _step(model: Model, memory: dict[str, np.ndarray], buckets: np.ndarray, first: np.ndarray, label: np.ndarray, common: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch; only common buckets have embeddings."""
    texts = len(label)
    x, rows, values, top = _pooled(model, buckets, first)
    active = np.maximum(top + model.bias, 0)
    error = (1 / (1 + np.exp(-(active @ model.weight + model.offset))) - label).astype(np.float32) / texts
    back = error[:, None] * model.weight * (active > 0)
    where = np.zeros(top.shape, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(first) + _PAD)
    row, column = np.nonzero(values == top[owner])
    where[owner[row][::-1], column[::-1]] = row[::-1]
    grad_x, grad_filters = np.zeros_like(x), np.zeros_like(model.filters)
    block = 0
    for i, w in enumerate(WIDTHS):
        at, g = where[:, i * FILTERS : (i + 1) * FILTERS], back[:, i * FILTERS : (i + 1) * FILTERS]
        for k in range(w):
            columns = slice((block + k) * FILTERS, (block + k + 1) * FILTERS)
            grad_filters[:, columns] = np.einsum("tf,tfd->df", g, x[at + k])
            np.add.at(grad_x, (at + k).reshape(-1), (g[:, :, None] * model.filters[:, columns].T).reshape(-1, DIMENSIONS))
        block += w

    def move(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        memory[name] += grad**2
        value -= rate * grad / np.sqrt(memory[name] + 1e-8)

    move("filters", model.filters, grad_filters)
    move("bias", model.bias, back.sum(axis=0))
    move("weight", model.weight, active.T @ error)
    memory["offset"] += error.sum() ** 2
    model.offset -= float(rate * error.sum() / np.sqrt(memory["offset"] + 1e-8))
    word = grad_x[rows]
    reached = word.any(axis=1)
    for j in range(buckets.shape[1]):
        moved = np.flatnonzero(reached & common[buckets[:, j]])
        which, inverse = np.unique(buckets[moved, j], return_inverse=True)
        grad = np.zeros((len(which), DIMENSIONS), np.float32)
        np.add.at(grad, inverse, word[moved])
        memory["embedding"][which] += grad**2
        model.embedding[which] -= rate * grad / np.sqrt(memory["embedding"][which] + 1e-8)


def _fresh(rng: np.random.Generator) -> Model:
    width = len(WIDTHS) * FILTERS
    return Model(rng.normal(0, 0.005, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.3, (DIMENSIONS, len(_BLOCKS) * FILTERS)).astype(np.float32), np.zeros(width, np.float32), rng.normal(0, 0.3, width).astype(np.float32), 0.0)


def _memory(model: Model) -> dict[str, np.ndarray]:
    return {n: np.zeros_like(getattr(model, n)) for n in ("filters", "bias", "weight", "embedding")} | {"offset": 0.0}


def _joined(buckets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of some texts, and their first words."""
    some = [buckets[i] for i in rows]
    return np.concatenate([np.zeros((0, 1 + len(HEADS)), np.int32), *some]), np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)


def train(texts: pa.Array, label: np.ndarray, share: float, *, steps: int = 1000, batch: int = 32, rate: float = 0.1, seed: int = 7) -> tuple[Model, np.ndarray, np.ndarray]:
    """(model, the rows that calibrated it, their scores); share: of label 1 among all rows that have a label."""
    rng = np.random.default_rng(seed)
    parts = [(b, f) for _, _, b, f in features(texts)]
    buckets = [b[f[i] : f[i + 1]] for b, f in parts for i in range(len(f) - 1)]
    n = len(label)
    model = _fresh(rng)
    times = np.zeros(BUCKETS, np.int64)
    for x in buckets:
        times[np.unique(x)] += 1
    common = times >= LEAST_TEXTS
    model.embedding[~common] = 0
    memory = _memory(model)
    order = rng.permutation(n)
    kept, aside = order[n // 5 :], order[: n // 5]

    joined = lambda rows: _joined(buckets, rows)
    epochs = max(6, -(-steps * batch // max(len(kept), 1)))
    for epoch in range(epochs):
        for lo in range(0, len(kept), batch):
            rows = kept[lo : lo + batch]
            _step(model, memory, *joined(rows), label[rows], common, rate * (1 - epoch / epochs))
        kept = rng.permutation(kept)
    raw = np.concatenate([np.zeros(0), *(logits(model, *joined(aside[lo : lo + 256])) for lo in range(0, len(aside), 256))])
    _calibrate(model, raw, label[aside], share, label.mean())
    return model, aside, scores(model, raw)


def _calibrate(model: Model, raw: np.ndarray, label: np.ndarray, share: float, sampled: float) -> None:
    """Fit slope and shift by Newton steps on smoothed labels, then move the odds from the sample's to those of all labels."""
    if len(np.unique(label)) == 2:
        ones, zeros = label.sum(), len(label) - label.sum()
        target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            w, g = p * (1 - p) + 1e-9, p - target
            hessian = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hessian, [(g * raw).sum(), g.sum()])
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        model.slope, model.shift = max(a, 1e-3), b
    if 0 < share < 1 and 0 < sampled < 1:
        model.shift += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))


def scores(model: Model, raw: np.ndarray) -> np.ndarray:
    """Probability of label 1 for uncalibrated logits."""
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -40, 40)))


def _threshold(score: np.ndarray, label: np.ndarray, otherwise: float) -> float:
    """The threshold between two scores with the greatest F1, the lowest of several, held between 0.1 and 0.7; ``otherwise`` for fewer than 5 rows of a class."""
    if label.sum() < 5 or (1 - label).sum() < 5:
        return otherwise
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + label.sum())
    last = np.append(s[1:] != s[:-1], True)
    best = np.flatnonzero(last & (f1 == f1[last].max()))[-1]
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float(np.clip((s[best] + below) / 2, 0.1, 0.7))


_DENSE = ("filters", "bias", "weight")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(part, buckets of each text, labels) of rows (part, text, toxic) in the order of parts."""
    part, buckets, label = None, [], []
    for batch in batches:
        numbers, toxic = batch.column("part").to_numpy(), batch.column("toxic").to_numpy()
        texts = batch.column("text")
        found = [b[f[i] : f[i + 1]].copy() for _, _, b, f in features(texts) for i in range(len(f) - 1)]
        for number, one, y in zip(numbers, found, toxic, strict=True):
            if number != part and buckets:
                yield part, buckets, np.array(label, np.float64)
                buckets, label = [], []
            part = int(number)
            buckets.append(one)
            label.append(y)
    if buckets:
        yield part, buckets, np.array(label, np.float64)


def _averaged(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, mean change of embedding and memory over the parts that changed them), summed in the order of parts."""
    kind = np.dtype([("at", np.int32), ("change", np.float32, (2 * DIMENSIONS,))])
    rows = np.concatenate([np.frombuffer(b, kind) for _, b in sorted(blobs)])
    at, inverse, times = np.unique(rows["at"], return_inverse=True, return_counts=True)
    total = np.zeros((len(at), 2 * DIMENSIONS))
    np.add.at(total, inverse, rows["change"])
    return at, (total / times[:, None]).astype(np.float32)


def train_parts(dealt: DataFrame, n: int, parts: int, *, steps: int = 1000, batch: int = 32, rate: float = 0.1, seed: int = 7) -> Model:
    """A model from all n rows of dealt (part, text, toxic), each part in one partition, in the order of parts.

    In a round each part takes its steps from the same model; then the mean of the parts' changes is taken, of an
    embedding over the parts that changed it. Driver and tasks hold the model and one part, however many parts there are.
    """
    context = dealt.sparkSession.sparkContext
    model = _fresh(np.random.default_rng(seed))
    memory = _memory(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(BUCKETS, np.int64)
        for _, buckets, _ in _parts(batches):
            for x in buckets:
                times[np.unique(x)] += 1
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times[at])], ["bucket", "times"])

    met = dealt.mapInArrow(count, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST_TEXTS).select("bucket").toArrow()
    common = np.zeros(BUCKETS, bool)
    common[met["bucket"].to_numpy()] = True
    model.embedding[~common] = 0
    rounds = max(6, -(-steps * batch * parts // max(n, 1)))
    for turn in range(rounds):
        sent = context.broadcast((model, memory, common))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for part, buckets, label in _parts(batches):
                before, held, common = sent.value
                own = Model(before.embedding.copy(), before.filters.copy(), before.bias.copy(), before.weight.copy(), before.offset)
                mine = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in held.items()}
                order = np.random.default_rng([seed, turn, part]).permutation(len(label))
                for lo in range(0, len(order), batch):
                    rows = order[lo : lo + batch]
                    _step(own, mine, *_joined(buckets, rows), label[rows], common, rate * (1 - turn / rounds))
                at = np.flatnonzero((mine["embedding"] != held["embedding"]).any(axis=1))
                found = np.zeros(len(at), np.dtype([("at", np.int32), ("change", np.float32, (2 * DIMENSIONS,))]))
                found["at"] = at
                found["change"] = np.concatenate([own.embedding[at] - before.embedding[at], mine["embedding"][at] - held["embedding"][at]], axis=1)
                cuts = np.searchsorted(at, np.arange(RANGES + 1) * (BUCKETS // RANGES))
                dense = np.concatenate([*(x.ravel() for k in _DENSE for x in (getattr(own, k), mine[k])), [own.offset, mine["offset"]]]).astype(np.float64)
                blobs = [(-1, dense.tobytes()), *((r, found[cuts[r] : cuts[r + 1]].tobytes()) for r in range(RANGES))]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in blobs], pa.int64()), pa.array([part] * len(blobs), pa.int64()), pa.array([b for _, b in blobs], pa.binary())], ["range", "part", "changes"])

        def merge(table: pa.Table) -> pa.Table:
            blobs = list(zip(table["part"].to_pylist(), table["changes"].to_pylist(), strict=True))
            where = table["range"][0].as_py()
            if where < 0:
                out = np.mean([np.frombuffer(b, np.float64) for _, b in sorted(blobs)], axis=0).tobytes()
                return pa.table({"range": pa.array([where], pa.int64()), "at": pa.array([b""], pa.binary()), "change": pa.array([out], pa.binary())})
            at, change = _averaged(blobs)
            return pa.table({"range": pa.array([where], pa.int64()), "at": pa.array([at.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

        for where, at, change in dealt.mapInArrow(learn, "range long, part long, changes binary").groupBy("range").applyInArrow(merge, "range long, at binary, change binary").collect():  # the model itself
            if where >= 0:
                rows, moved = np.frombuffer(at, np.int32), np.frombuffer(change, np.float32).reshape(-1, 2 * DIMENSIONS)
                model.embedding[rows] += moved[:, :DIMENSIONS]
                memory["embedding"][rows] += moved[:, DIMENSIONS:]
                continue
            dense, lo = np.frombuffer(change, np.float64), 0
            for name in _DENSE:
                for x in (getattr(model, name), memory[name]):
                    x[...] = dense[lo : lo + x.size].reshape(x.shape)
                    lo += x.size
            model.offset, memory["offset"] = float(dense[lo]), float(dense[lo + 1])
        sent.destroy()
    return model


class Judge:
    """A model fitted to labelled documents, with a threshold for each language.

    Learns from all rows of labels (doc_id, toxic) where ``may_learn`` holds and docs has a text; a fifth of them
    calibrates. A caller may bound them: at most ``ones`` and ``zeros`` of each class, those with the least hash of doc_id, at
    most ``sample_bytes`` of whole texts, of which only the longest are left out. Only texts are inputs of a score; ``lang``, if docs has it, chooses the threshold.
    Labels other than 0 and 1 and rows without doc_id teach nothing; a doc_id with both labels counts as 1.
    With labels of one class or none, the score is that class's share (none: 0) and the threshold 0.5.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, may_learn: Column, ones: int | None = None, zeros: int | None = None, sample_bytes: int | None = None):
        docs = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
        known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        held = known.agg(F.count("*"), F.sum("toxic")).first()
        share = (held[1] or 0) / held[0] if held[0] else 0.0
        first = lambda toxic, most: known.where(F.col("toxic") == toxic) if most is None else known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = known if ones is None and zeros is None else first(1, ones).unionByName(first(0, zeros))
        sample = docs.join(some, "doc_id").withColumn("order", F.xxhash64("doc_id", "text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
        # repeated rows of docs teach once, by the least of their hashes and texts; written, as sizes and texts are asked for one after the other
        sample = sample.groupBy("doc_id").agg(F.min(F.struct("order", "text", "lang", "toxic", "bytes")).alias("s")).select("s.*")
        sample, path = written_at(sample, "sample")
        self.model, self.constant, self.thresholds, self.usual = None, share, {}, 0.5
        n, ones_of, size = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        if sample_bytes is None and (n > PART_ROWS or size > PART_BYTES):
            if 0 < ones_of < n:
                self._all(sample, n, ones_of, max(-(-n // PART_ROWS), -(-size // PART_BYTES)), share)
        else:
            self._some(sample, size if sample_bytes is None else sample_bytes, share)
        removed(docs.sparkSession, path)
        textkit.released()

    def _all(self, sample: DataFrame, n: int, ones: int, parts: int, share: float) -> None:
        """Learn from and calibrate by all rows, in tasks."""
        aside = F.pmod(F.xxhash64("order"), F.lit(5)) == 0
        left = sample.where(~aside).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < left[1] < left[0]:  # too few of a class to leave any aside
            left, aside = (n, ones), F.lit(True)
            kept = sample
        else:
            kept = sample.where(~aside)
        dealt = kept.select(F.pmod("order", F.lit(parts)).alias("part"), "text", "toxic", "order").repartition(parts, "part").sortWithinPartitions("part", "order").persist(StorageLevel.DISK_ONLY)
        self.model = train_parts(dealt, left[0], parts)
        dealt.unpersist()
        sent = sample.sparkSession.sparkContext.broadcast(self.model)

        def logit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros(batch.num_rows)
                for lo, hi, buckets, first in features(batch.column("text")):
                    out[lo:hi] = logits(sent.value, buckets, first)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(np.round(np.clip(out, -40, 40), 3))], ["lang", "toxic", "raw"])

        # counts by rounded logit: as many rows at most as there are such logits, for each language and label
        found = sample.where(aside).select("text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic").mapInArrow(textkit.tidy(logit), "lang string, toxic int, raw double").groupBy("lang", "toxic", "raw").count().orderBy("lang", "toxic", "raw").toArrow()
        times = found["count"].to_numpy()
        raw, label, lang = np.repeat(found["raw"].to_numpy(), times), np.repeat(found["toxic"].to_numpy().astype(np.float64), times), np.repeat(np.array(found["lang"].to_pylist(), dtype=object), times)
        _calibrate(self.model, raw, label, share, ones / n)
        self._cut(scores(self.model, raw), label, lang)

    def _cut(self, found: np.ndarray, label: np.ndarray, lang: np.ndarray) -> None:
        self.usual = _threshold(found, label, 0.3)
        self.thresholds = {x: _threshold(found[lang == x], label[lang == x], self.usual) for x in sorted(set(lang.tolist()))}

    def _some(self, sample: DataFrame, sample_bytes: int, share: float) -> None:
        """Learn from rows that one model learns in turn."""
        sizes = sample.select("order", "bytes").toPandas().sort_values(["bytes", "order"])
        fits = sizes[sizes["bytes"].cumsum() <= sample_bytes]
        longest, last = (int(fits[c].iloc[-1]) for c in ("bytes", "order")) if len(fits) else (-1, 0)
        rows = sample.where((F.col("bytes") < longest) | (F.col("bytes") == longest) & (F.col("order") <= last)).select("text", "lang", "toxic", "order").toArrow()
        rows = rows.take(pa.array(np.argsort(rows["order"].to_numpy(), kind="stable")))
        label, lang = rows["toxic"].to_numpy().astype(np.float64), np.array(rows["lang"].fill_null("").to_pylist(), dtype=object)
        if len(np.unique(label)) == 2:
            self.model, aside, found = train(rows["text"].combine_chunks(), label, share)
            self._cut(found, label[aside], lang[aside])

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.constant)
        if self.model is not None:
            for lo, hi, buckets, first in features(texts):
                out[lo:hi] = scores(self.model, logits(self.model, buckets, first))
        return out

    def cuts(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.thresholds.get(x or "", self.usual) for x in langs], np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, *, ones: int | None = None, zeros: int | None = None, sample_bytes: int | None = None) -> DataFrame:
    """(doc_id, score, threshold, toxic) for each row of docs; score is a Judge's calibrated probability of label 1, toxic whether it reaches its language's threshold.

    A null or empty text has the score of no words. Repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """
    judge = docs.sparkSession.sparkContext.broadcast(Judge(docs, labels, may_learn, ones, zeros, sample_bytes))
    docs = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cut = judge.value.scores(batch.column("text")), judge.value.cuts(batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(cut), pa.array(out >= cut)], ["doc_id", "score", "threshold", "toxic"])

    return docs.mapInArrow(textkit.tidy(score), T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column, *, ones: int | None = None, zeros: int | None = None, sample_bytes: int | None = None) -> DataFrame:
    """The rows of docs, with all columns, whose score is below their language's threshold.

    A null or empty text has the score of no words; repeated rows stay or go each, as rows of one text and
    language do; a null language has the threshold of all; an empty table gives an empty result; columns may
    have any names.
    """
    judge = docs.sparkSession.sparkContext.broadcast(Judge(docs, labels, may_learn, ones, zeros, sample_bytes))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            names = batch.schema.names
            langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * batch.num_rows
            yield batch.filter(pa.array(judge.value.scores(batch.column(names.index("text"))) < judge.value.cuts(langs)))

    return docs.mapInArrow(textkit.tidy(keep), docs.schema)
