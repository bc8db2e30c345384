"""Fits of tables that fit a task, in numpy: trees, forests, boosted trees and linear machines as Spark ML defines them.

Spark ML grows a tree by several jobs a level or stage, which on such tables are all overhead: 15 folds of ten
boosted classes are 15,000 trees. Here all fits are one job, whose tasks each have some trees or one class of a fit, over a
broadcast table. Splits are between at most ``maxBins`` bins of all training rows; the linear machine's coefficients are the optimum of its loss.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of features, places in folds and class shares of a table that is sent to tasks whole. A larger one is fitted by Spark ML, by jobs of the cluster.
FIT_BYTES = 128 << 20
#: Trees of a forest that a task grows; rows whose splits are sought together.
TREES, BLOCK = 10, 8192
#: Parameters that may be set for a fit here; with others Spark ML fits.
_KNOWN = {DecisionTreeClassifier: {"maxDepth", "maxBins", "seed"}, RandomForestClassifier: {"numTrees", "maxDepth", "maxBins", "seed"}, GBTClassifier: {"maxIter", "maxDepth", "maxBins", "stepSize", "seed"}, LinearSVC: {"regParam", "maxIter", "tol"}}


@dataclass
class Table:
    """Rows in the order of their keys: features as wide as they were, labels, and the fold of each row (a row of fold for each repetition, -1: in none)."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    #: Bins of the fit that a worker was last at: its tasks come one after another.
    kept: dict[tuple[int, ...], tuple[np.ndarray, ...]] = field(default_factory=dict)


def collected(rows: DataFrame, folds: DataFrame, key: str) -> tuple[Table, pa.Array] | None:
    """The rows (key, features, label) with their folds, and their keys; None if they are more than FIT_BYTES, or not finite numbers of one width with labels 0, 1, and so on."""
    n, width, least, bad, last = rows.agg(F.count(F.lit(1)), F.max(F.size("features")), F.min(F.size("features")), F.count_if(F.col(key).isNull() | F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") % 1 != 0)), F.max("label")).first()
    element = rows.schema["features"].dataType.elementType.simpleString()
    kind = np.dtype(np.float32 if element == "float" else np.float64)
    if not n or least != width or width < 1 or bad or n * (kind.itemsize * width + 8 * (last + 8)) > FIT_BYTES or folds.count() * 16 > FIT_BYTES:
        return None
    # a small table by the check above
    found = rows.select(key, F.col("features").cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>").alias("features"), F.col("label").cast("int").alias("label")).toArrow()
    keys, y = found[key].combine_chunks(), found["label"].to_numpy()
    x, at = np.empty((n, width), kind), 0
    for chunk in found["features"].chunks:
        values = chunk.flatten()
        if values.null_count or len(values) != len(chunk) * width or at + len(chunk) > n:
            return None
        x[at : at + len(chunk)] = values.to_numpy().reshape(len(chunk), width)
        at += len(chunk)
    del found
    order = pc.sort_indices(keys)
    keys, order = keys.take(order), order.to_numpy()
    if at < n or not np.isfinite(x).all() or len(keys.unique()) < n:
        return None
    placed = folds.select(key, F.col("repetition_id").cast("int").alias("repetition"), F.col("fold_id").cast("int").alias("fold")).toArrow()
    here = pc.index_in(placed[key].combine_chunks(), keys)
    known = here.is_valid().to_numpy(zero_copy_only=False)
    row, repetition, number = here.fill_null(0).to_numpy()[known], placed["repetition"].to_numpy()[known], placed["fold"].to_numpy()[known]
    fold = np.full((int(repetition.max(initial=-1)) + 1, n), -1, np.int32)
    fold[repetition, row] = number
    if (fold >= 0).sum() < len(row):  # a row twice in a repetition
        return None
    return Table(x[order], y[order].astype(np.int64), fold), keys


def plan(made: Estimator) -> dict[str, Any] | None:
    """Parameters of an estimator that is fitted here; None for others."""
    inner = made.getClassifier() if isinstance(made, OneVsRest) else made
    known = _KNOWN.get(type(inner))
    if known is None or isinstance(made, OneVsRest) != isinstance(inner, (GBTClassifier, LinearSVC)) or not {p.name for p in inner._paramMap} <= known:
        return None
    if isinstance(made, OneVsRest) and not {p.name for p in made._paramMap} <= {"classifier", "parallelism"}:
        return None
    found = {p.name: inner.getOrDefault(p) for p in inner.params if p.name in known} | {"kind": type(inner).__name__}
    return None if found["kind"] == "LinearSVC" and found["regParam"] <= 0 else found


# Trees


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Split points of a column: between all neighbours, or where the rows are nearest to being dealt evenly to bins."""
    distinct, counts = np.unique(values, return_counts=True)
    bins = min(bins, len(values))
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) < bins:
        return middle
    up, found, last, target = np.cumsum(counts), [], -1, len(values) / bins
    pairs, k = up[:-1] + up[1:], 1
    while (last := max(last + 1, int(np.searchsorted(pairs, 2 * target * k, side="right")))) < len(middle):
        found.append(last)
        k += 1
    return middle[found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(column, row) numbers of bins: of the split points below a value."""
    kind = np.min_scalar_type(max(len(c) for c in cuts))
    return np.stack([np.searchsorted(c, x[:, j], side="left").astype(kind) for j, c in enumerate(cuts)])


@dataclass
class Tree:
    """Nodes: column (-1: a leaf), last bin that goes left, first child (the other is next), and the value of each leaf."""

    column: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at, moving = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        while len(moving := moving[self.column[at[moving]] >= 0]):
            node = at[moving]
            at[moving] = self.child[node] + (codes[self.column[node], moving] > self.bin[node])
        return self.value[at]


def _chosen(rng: np.random.Generator, nodes: int, columns: int, k: int) -> np.ndarray:
    """(nodes, k) different columns of each node, by Floyd's sampling."""
    found = np.full((nodes, k), -1)
    for i, top in enumerate(range(columns - k, columns)):
        drawn = rng.integers(0, top + 1, nodes)
        found[:, i] = np.where((found == drawn[:, None]).any(axis=1), top, drawn)
    return found


def _by_counts(bins: np.ndarray, node: np.ndarray, label: np.ndarray, table: np.ndarray, size: np.ndarray, whole: np.ndarray, width: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, bin, score) of each split, in order, from counts of classes by node and bin. times: how often a row counts (None: once)."""
    m, classes = table.shape
    left = np.bincount((node * width + bins) * classes + label, times, minlength=m * width * classes).reshape(m, width, classes).cumsum(axis=1)[:, :-1]
    n_left = left.sum(axis=2)
    n_right = size[:, None] - n_left
    squares = (left * left).sum(axis=2)
    cross = (left @ table[:, :, None])[:, :, 0]
    of, bin_ = np.nonzero((n_left > 0) & (n_right > 0))
    s, n, r = squares[of, bin_], n_left[of, bin_], n_right[of, bin_]
    return of, bin_, s / n + (whole[of] - 2 * cross[of, bin_] + s) / r


def _by_order(bins: np.ndarray, node: np.ndarray, label: np.ndarray, table: np.ndarray, size: np.ndarray, whole: np.ndarray, width: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from rows (by node) sorted by node and bin: a row adds 2 r + 1 to the sum of squared class counts left of a split, r being the rows of its node and class before it, however many nodes and classes there are; one that counts t times adds 2 r t + t t."""
    classes, place = table.shape[1], np.arange(len(node))
    packed = np.sort(((node * width + bins) << 32) | place)
    at, who = packed >> 32, label[packed & 0xFFFFFFFF]
    group = node * classes + who
    again = np.sort((group << 32) | place)
    counts = table.ravel()
    place_in, ended = again & 0xFFFFFFFF, np.cumsum(counts)
    rank = np.empty(len(node), np.int64)
    if times is None:
        t, square = 1, 1
        rank[place_in] = place - np.repeat(ended - counts, counts)
    else:
        t = times[packed & 0xFFFFFFFF]
        square, own = t * t, t[place_in]
        rank[place_in] = np.cumsum(own) - own - (ended - counts)[again >> 32]
    ends = np.flatnonzero((at[1:] != at[:-1]) & (node[1:] == node[:-1]))
    of = node[ends]
    # what the nodes before add up to: the squared counts of their classes, in both sums
    before = (np.cumsum(whole) - whole)[of]
    s, cross = np.cumsum(2 * rank * t + square)[ends] - before, np.cumsum(counts[group] * t)[ends] - before
    n = (ends + 1 if times is None else np.cumsum(t)[ends]) - (np.cumsum(size) - size)[of]
    return of, at[ends] - of * width, s / n + (whole[of] - 2 * cross + s) / (size[of] - n)


def _best(codes: np.ndarray, rows: np.ndarray, node: np.ndarray, label: np.ndarray, table: np.ndarray, picked: np.ndarray | None, width: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Column (-1: none makes purer) and last bin on the left of each node's best split; rows are in the order of nodes."""
    m, classes = table.shape
    size, whole = table.sum(axis=1), (table**2).sum(axis=1)
    best, column, cut = whole / size * (1 + 1e-12), np.full(m, -1), np.zeros(m, np.int64)
    way = _by_counts if m * width * classes <= 4 * len(rows) else _by_order
    for j in range(len(codes) if picked is None else picked.shape[1]):
        bins = (codes[j][rows] if picked is None else codes[picked[node, j], rows]).astype(np.int64)
        of, bin_, score = way(bins, node, label, table, size, whole, width, times)
        if not len(of):
            continue
        first = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
        top, nodes = np.maximum.reduceat(score, first), of[first]
        better = top > best[nodes] * (1 + 1e-12)
        most = np.diff(first, append=len(of))
        hit = np.flatnonzero((score == np.repeat(top, most)) & np.repeat(better, most))[::-1]
        cut[of[hit]] = bin_[hit]  # the first of equal ones
        nodes, top = nodes[better], top[better]
        best[nodes], column[nodes] = top, j if picked is None else picked[nodes, j]
    return column, cut


def grow(codes: np.ndarray, y: np.ndarray, classes: int, depth: int, k: int | None = None, rng: np.random.Generator | None = None, times: np.ndarray | None = None) -> Tree:
    """A classification tree by Gini impurity, level by level, each node split by the best of k columns (None: of all). Leaf values are shares of classes.

    times: how often each row was drawn (None: once); one that was drawn more often is still one row to sort and count.
    """
    rows, width = np.arange(codes.shape[1]) if times is None else np.flatnonzero(times), int(codes.max(initial=0)) + 1
    node, first, total = np.zeros(len(rows), np.int64), 0, 1
    parts: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        m, label = total - first, y[rows]
        table = np.bincount(node * classes + label, None if times is None else times[rows], minlength=m * classes).astype(np.int64).reshape(m, classes)
        size = table.sum(axis=1)
        column, cut = np.full(m, -1), np.zeros(m, np.int64)
        if level < depth:
            live = np.flatnonzero(table.max(axis=1) < size)
            kept = np.zeros(m, bool)
            kept[live] = True
            kept = kept[node]
            rows, label, node = rows[kept], label[kept], (np.cumsum(np.bincount(live, minlength=m)) - 1)[node[kept]]
            order = np.argsort(node.astype(np.uint16 if len(live) < 1 << 16 else np.int64), kind="stable")
            rows, label, node = rows[order], label[order], node[order]
            picked = None if k is None or k >= len(codes) else _chosen(rng, len(live), len(codes), k)
            ends = np.cumsum(np.bincount(node, minlength=len(live)))
            lo = 0
            while lo < len(live):  # some nodes at a time, as short arrays stay in the cache
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
                some = slice(int(begin), int(ends[hi - 1]))
                column[live[lo:hi]], cut[live[lo:hi]] = _best(codes, rows[some], node[some] - lo, label[some], table[live[lo:hi]], None if picked is None else picked[lo:hi], width, None if times is None else times[rows[some]])
                lo = hi
            node = live[node]
        split = column >= 0
        children = np.where(split, total + 2 * (np.cumsum(split) - 1), -1)
        parts.append((column, cut, children, table / size[:, None]))
        if not split.any():
            break
        go = split[node]
        rows, node = rows[go], node[go]
        node = children[node] + (codes[column[node], rows] > cut[node]) - total
        first, total = total, total + 2 * int(split.sum())
    return Tree(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def _sums(codes: np.ndarray, part: np.ndarray, group: np.ndarray | int, m: int, bins: int) -> np.ndarray:
    """(column, group, bin) sums of part."""
    shift = group * bins
    return np.stack([np.bincount(c + shift if m > 1 else c, part, minlength=m * bins) for c in codes]).reshape(len(codes), m, bins)


def _numbers(codes: np.ndarray, group: np.ndarray | int, m: int, bins: int) -> np.ndarray:
    """(column, group, bin) numbers of rows."""
    shift = group * bins
    return np.stack([np.bincount(c + shift if m > 1 else c, minlength=m * bins) for c in codes]).reshape(len(codes), m, bins)


def _halves(less: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(column, node, bin) of pairs of nodes, whose half that less names is one."""
    out, k = np.empty((len(one), len(less), 2, one.shape[2]), one.dtype), np.arange(len(less))
    out[:, k, less], out[:, k, 1 - less] = one, other
    return out.reshape(len(one), 2 * len(less), -1)


def grow_means(codes: np.ndarray, target: np.ndarray, depth: int, bins: int, numbers: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A regression tree by variance over all columns, and the leaf's mean of each row. numbers: rows by column and bin, the same for all trees."""
    n = codes.shape[1]
    node, at, first, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 1
    column, cut, child, value = [], [], [], []
    rows, split, by_sum, by_n = np.arange(n), np.zeros(0, bool), np.empty(0), numbers
    for level in range(depth + 1):
        m, part = total - first, target[rows]
        size, sums = np.bincount(node, minlength=m), np.bincount(node, part, minlength=m)
        mean = sums / size
        value.append(mean)
        before, split, children = split, np.zeros(m, bool), np.full(m, -1)
        best_column, best_bin = np.full(m, -1), np.zeros(m, np.int64)
        if level < depth:
            if not level:
                by_sum = _sums(codes, part, 0, 1, bins)
            else:  # children stand side by side: the smaller is summed, the other is what it leaves of their parent
                less = (size[1::2] < size[::2]).astype(np.int64)
                small = (node & 1) == less[node >> 1]
                some, group = codes.take(rows[small], axis=1), node[small] >> 1
                one, one_n = _sums(some, part[small], group, m // 2, bins), _numbers(some, group, m // 2, bins)
                other_n = by_n[:, before] - one_n
                by_sum, by_n = _halves(less, one, np.where(other_n > 0, by_sum[:, before] - one, 0.0)), _halves(less, one_n, other_n)
            left, n_left = by_sum.cumsum(axis=2), by_n.cumsum(axis=2)
            n_right = size[None, :, None] - n_left
            with np.errstate(divide="ignore", invalid="ignore"):
                score = left**2 / n_left + (sums[None, :, None] - left) ** 2 / n_right
            score = np.where((n_left > 0) & (n_right > 0), score, -np.inf).transpose(1, 0, 2).reshape(m, -1)
            top = score.argmax(axis=1)
            split = score[np.arange(m), top] > sums * mean + 1e-12 * np.bincount(node, part**2, minlength=m)
            best_column, best_bin = np.where(split, top // bins, -1), top % bins
            children = np.where(split, total + 2 * (np.cumsum(split) - 1), -1)
        column.append(best_column)
        cut.append(best_bin)
        child.append(children)
        go = split[node]
        at[rows[~go]] = first + node[~go]
        if not go.any():
            break
        rows, node = rows[go], node[go]
        node = children[node] + (codes[best_column[node], rows] > best_bin[node]) - total
        first, total = total, total + 2 * int(split.sum())
    tree = Tree(np.concatenate(column), np.concatenate(cut), np.concatenate(child), np.concatenate(value))
    return tree, tree.value[at]


def boosted(codes: np.ndarray, y: np.ndarray, tested: np.ndarray, stages: int, depth: int, step: float, bins: int) -> np.ndarray:
    """Margins of the tested rows for label 1 of y by boosted trees under the loss 2 log(1 + exp(-2 y F)), y -1 or 1."""
    sign = np.where(y > 0, 1.0, -1.0)
    margin, out, numbers = np.zeros(len(y)), np.zeros(tested.shape[1]), _numbers(codes, 0, 1, bins)
    for stage in range(stages):
        target = sign if not stage else 4 * sign / (1 + np.exp(np.clip(2 * sign * margin, -700, 700)))
        tree, found = grow_means(codes, target, depth, bins, numbers)
        weight = step if stage else 1.0
        margin += weight * found
        out += weight * tree(tested)
    return 2 * out


# Linear machine


def machine(x: np.ndarray, y: np.ndarray, l2: float, *, tol: float = 1e-9, most: int = 200) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) with the least l2 / 2 |w|^2 + mean hinge loss of columns scaled to deviation 1, by a primal-dual interior point method."""
    n = len(y)
    scale = x.std(axis=0, ddof=1) if n > 1 else np.zeros(x.shape[1])
    scale = np.where(scale > 0, scale, np.inf)
    centre = x.mean(axis=0)
    sign, c = np.where(y > 0, 1.0, -1.0), 1 / (n * l2)
    a = np.column_stack([(x - centre) / scale, np.ones(n)]) * sign[:, None]
    d = a.shape[1]
    ridge = np.append(np.ones(d - 1), 0.0)
    v, alpha = np.zeros(d), np.full(n, c / 2)
    slack = s = np.full(n, 1.0)
    for _ in range(most):
        dual, bound = ridge * v - a.T @ alpha, a @ v - 1 + slack - s
        rest = c - alpha
        gap = (alpha @ s + rest @ slack) / (2 * n)
        loss = (ridge * v) @ v / 2 + c * np.maximum(0, 1 - a @ v).sum()
        if 2 * n * gap <= tol * (1 + loss) and np.abs(dual).max() <= tol * c * n and np.abs(bound).max() <= 1e-6:
            break
        weight = 1 / (s / alpha + slack / rest)
        system = np.diag(ridge)
        for lo in range(0, n, BLOCK):
            some = a[lo : lo + BLOCK]
            system += some.T @ (some * weight[lo : lo + BLOCK, None])
        system[np.diag_indices(d)] += 1e-13 * np.trace(system) / d

        def step(one: np.ndarray, two: np.ndarray, weight=weight, system=system, rest=rest, dual=dual, bound=bound, s=s, slack=slack, alpha=alpha) -> tuple[np.ndarray, ...]:
            q = one / alpha - two / rest - bound
            dv = np.linalg.solve(system, a.T @ (weight * q) - dual)
            da = weight * (q - a @ dv)
            return dv, da, (one - s * da) / alpha, (two + slack * da) / rest

        def most_of(da: np.ndarray, ds: np.ndarray, dk: np.ndarray, rest=rest, s=s, slack=slack, alpha=alpha) -> float:
            return min(1.0, *(float(np.min(np.where(dx < 0, -x_ / np.where(dx < 0, dx, -1.0), np.inf))) for x_, dx in ((alpha, da), (rest, -da), (s, ds), (slack, dk))))

        _, da, ds, dk = step(-alpha * s, -rest * slack)
        far = most_of(da, ds, dk)
        after = ((alpha + far * da) @ (s + far * ds) + (rest - far * da) @ (slack + far * dk)) / (2 * n)
        aim = gap * (after / gap) ** 3
        dv, da, ds, dk = step(aim - alpha * s - da * ds, aim - rest * slack + da * dk)
        far = 0.995 * most_of(da, ds, dk)
        v, alpha, s, slack = v + far * dv, alpha + far * da, s + far * ds, slack + far * dk
    w = v[:-1] / scale
    return w, float(v[-1] - centre @ w)


# Tasks


def parts(made: dict[str, Any], classes: int) -> int:
    """Tasks of a fit."""
    return {"DecisionTreeClassifier": 1, "RandomForestClassifier": -(-made.get("numTrees", 1) // TREES)}.get(made["kind"], classes)


def part(table: Table, made: dict[str, Any], repetition: int, fold: int, i: int) -> np.ndarray:
    """What task i of a fit to the other folds gives each tested row: sums of its trees' class shares, or the margin of class i."""
    of, classes = table.fold[repetition], int(table.y.max()) + 1
    known, test = (of >= 0) & (of != fold), of == fold
    y = table.y[known]
    if not len(y):
        raise ValueError("no rows to fit to")
    if made["kind"] in ("LinearSVC", "GBTClassifier") and not (y == i).any():
        return np.full((int(test.sum()), 1), -np.inf)
    if made["kind"] == "LinearSVC":
        w, b = machine(table.x[known].astype(np.float64), y == i, made["regParam"])
        # what the solver leaves is no difference: where no coefficient pays, margins are equal
        return np.round(table.x[test].astype(np.float64) @ w + b, 6)[:, None]
    if (at := (made["maxBins"], repetition, fold)) not in table.kept:
        x = np.ascontiguousarray(table.x[known].T).T
        cuts = [thresholds(x[:, j].astype(np.float64), made["maxBins"]) for j in range(x.shape[1])]
        table.kept.clear()
        table.kept[at] = binned(x, cuts), binned(table.x[test], cuts)
    codes, seen = table.kept[at]
    if made["kind"] == "GBTClassifier":
        return boosted(codes, y == i, seen, made["maxIter"], made["maxDepth"], made["stepSize"], made["maxBins"])[:, None]
    if made["kind"] == "DecisionTreeClassifier":
        return grow(codes, y, classes, made["maxDepth"])(seen)
    out = np.zeros((seen.shape[1], classes))
    for t in range(i * TREES, min((i + 1) * TREES, made["numTrees"])):
        rng = np.random.default_rng([made["seed"] & (2**63 - 1), repetition, fold, t])
        columns = max(1, int(np.ceil(np.sqrt(len(codes))))) if made["numTrees"] > 1 else None
        times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) if made["numTrees"] > 1 else None
        out += grow(codes, y, classes, made["maxDepth"], columns, rng, times)(seen)
    return out


class Fits:
    """Fits to one table that all tasks get."""

    def __init__(self, spark, table: Table, keys: pa.Array, key_type: str):
        self.spark, self.classes, self.key_type = spark, int(table.y.max()) + 1, key_type
        self.sent = spark.sparkContext.broadcast((table, keys))

    def predictions(self, items: list[tuple[str, int, int, dict[str, Any]]]) -> DataFrame:
        """(model, repetition_id, fold_id, row_id, y_true, y_pred, proba, train_time, eval_time) of the tested rows of fits (model, repetition, fold, parameters), in one job; times are the seconds of a fit's tasks.

        A task gives the bytes of its array, a row for each tested row in the order of keys; those of a fit are put together in one task.
        """
        sent, tasks = self.sent, [(k, i) for k, item in enumerate(items) for i in range(parts(item[3], self.classes))]

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, i in (tasks[t] for t in batch.column(0).to_pylist()):
                    began = time.perf_counter()
                    _, repetition, fold, made = items[k]
                    values = part(sent.value[0], made, repetition, fold, i).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([values], pa.binary()), pa.array([time.perf_counter() - began])], ["item", "part", "values", "seconds"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[int, list[tuple[int, bytes, float]]] = {}
            for batch in batches:
                for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    of.setdefault(k, []).append(tuple(row))
            for k, rows in of.items():
                began = time.perf_counter()
                (model, repetition, fold, made), (table, keys) = items[k], sent.value
                margins, at = made["kind"] in ("LinearSVC", "GBTClassifier"), np.flatnonzero(table.fold[repetition] == fold)
                arrays = [np.frombuffer(v, np.float64).reshape(len(at), -1) for _, v, _ in sorted(rows)]
                values = np.concatenate(arrays, axis=1) if margins else sum(arrays)
                text = lambda a: pa.array(a.astype(int)).cast(pa.string())
                shares = None if margins else values / np.maximum(values.sum(axis=1, keepdims=True), 1e-300)
                proba = pa.nulls(len(at), pa.list_(pa.float64())) if margins else pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, shares.shape[1]), pa.int32()), pa.array(shares.ravel()))
                found = [keys.take(pa.array(at)), text(table.y[at]), text(values.argmax(axis=1)), proba]
                same = [pa.scalar(model), pa.scalar(repetition, pa.int32()), pa.scalar(fold, pa.int32())], [pa.scalar(sum(s for _, _, s in rows)), pa.scalar(time.perf_counter() - began)]
                before, after = ([pa.repeat(v, len(at)) for v in some] for some in same)
                yield pa.RecordBatch.from_arrays([*before, *found, *after], ["model", "repetition_id", "fold_id", "row_id", "y_true", "y_pred", "proba", "train_time", "eval_time"])

        given = self.spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(fit, "item int, part int, values binary, seconds double")
        return given.repartitionById(len(items), F.col("item")).mapInArrow(score, f"model string, repetition_id int, fold_id int, row_id {self.key_type}, y_true string, y_pred string, proba array<double>, train_time double, eval_time double")
