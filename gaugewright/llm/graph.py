"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.shared import removed, written_at

_FOREST_ROWS = 1 << 20
#: Edges, after each partition's forest, that one task may hold: the nodes of so many fit one forest.
ONE_TASK = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the same components as the edges read; flushed whenever a fixed number of nodes is held."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > _FOREST_ROWS:
            yield stars()
    yield stars()


#: Edges of a node from which it is joined by broadcast, at least; and so many such nodes at most.
HOT_EDGES, HOT_NODES = 1000, 1000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) with low, the least b of their a.

    A node of very many edges would meet them in one task, so those above HOT_EDGES, and above a share of all
    edges that only HOT_NODES nodes can reach, are joined where their edges are.
    """
    bound = max(HOT_EDGES, count // HOT_NODES)
    least = edges.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
    hot = F.broadcast(least.where(F.col("degree") > bound).select("a", "low"))
    cold = edges.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("degree") <= bound).select("a", "low"), "a")
    return cold.unionByName(edges.join(hot, "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b; longs): root is the least node of its component.

    Each partition first keeps a spanning forest of its edges. Up to ONE_TASK of those edges become one forest in
    one task; of more, large-star and small-star steps alternate until the edges no longer change,
    logarithmically many times.
    """
    spark = edges.sparkSession
    now, path = written_at(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "edges")
    count, mark = now.count(), None
    if count <= ONE_TASK:
        old = path
        now, path = written_at(now.coalesce(1).mapInArrow(_forest, "a long, b long"), "edges")
        removed(spark, old)
    while count > ONE_TASK:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * count).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a != b").distinct()
        large, middle = written_at(large, "stars")
        moved = _with_least(large, count)
        parents = large.groupBy("a").agg(F.min("b").alias("b"))
        before, old = mark, path
        now, path = written_at(moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(parents).where("a != b").distinct(), "edges")
        # the tables of the step before, compressed and few as they are, would add up over the steps
        removed(spark, old)
        removed(spark, middle)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        count = mark[0]
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
