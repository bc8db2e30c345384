import random
import re

import numpy as np
import pytest

from gaugewright.llm import graph, ngram_join
from gaugewright.llm.graph import components
from gaugewright.llm.ngram_join import allocation, band_edges, jaccard_components, link_block

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -1, len(sets[i]), min(groups[find(i)]) if find(i) in groups else -1) for i, (d, _) in enumerate(docs))


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return out or ["x"]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_brute_force(spark, documents, n, percent):
    rng = random.Random(n)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 14, 25, 40, 90, 300]))]
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            docs.append((len(docs), " ".join(near(rng, base, rng.choice([0, 0, 1, 2, 5, 12])))))
    docs += [(1000 + i, " ".join(common + [f"u{i}_{j}" for j in range(rng.choice([5, 10, 60]))])) for i in range(40)]  # a passage of many
    docs += [(2000 + i, "same words of a copy " * 9) for i in range(30)] + [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "b " * 5000), (5, "again with an id that is taken"), (None, "same words of a copy " * 9), (None, "all alone here")]
    rng.shuffle(docs)
    got = jaccard_components(documents(docs), n=n, percent=percent).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute(docs, n, percent)


def test_crowded_blocks(spark, documents, monkeypatch):
    """A group much larger than a bucket's limit, in several blocks, gives the links that brute force gives."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(near(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 8])))) for i in range(150)]
    got = jaccard_components(documents(docs), n=4, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(docs, 4, 85)


def test_families_of_a_group(spark, documents, monkeypatch):
    """Families that share a passage are one crowded group of several classes in several blocks; links within and between them are brute force's."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 2)
    across = []
    linked = ngram_join._group_links
    monkeypatch.setattr(ngram_join, "_group_links", lambda *a: across.append(linked(*a)) or across[-1])
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    docs = []
    for g, many in enumerate((60, 25, 25, 6)):
        base = [*shared, *(f"g{g}w{i}" for i in range(30))]
        docs += [(len(docs) + i, " ".join(near(rng, base, rng.choice([0, 1, 2, 3, 5, 7])))) for i in range(many)]
    bridge = [*shared, *(f"g0w{i}" for i in range(30))]
    docs += [(500 + i, " ".join(bridge[: 90 - i] + [f"g1w{j}" for j in range(i)])) for i in range(0, 30, 2)]
    got = jaccard_components(documents(docs), n=4, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(docs, 4, 85)
    assert len(across[0]) == 3  # within blocks, between them, and what is outside of the greatest class


def test_empty(spark, documents):
    assert jaccard_components(documents([])).collect() == []
    assert [tuple(r) for r in jaccard_components(documents([(4, None)])).collect()] == [(4, 0, 4)]


def test_link_block_connects_what_brute_force_does():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(120)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    for percent in (50, 85):
        edges = link_block(np.arange(120), first, np.concatenate(sets), percent)
        for a, b in edges:
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
        label = list(range(120))

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges:
            label[find(a)] = find(b)
        for a in range(120):
            for b in range(a):
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])):
                    assert find(a) == find(b)


def test_bands():
    for percent in (80, 85):
        edges = band_edges(percent, 5000)
        for size in range(1, 5001):
            band = next(i for i in range(len(edges)) if edges[i] <= size < edges[i + 1])
            largest = size * 100 // percent
            assert largest < (edges[band + 2] if band + 2 < len(edges) else edges[-1] * 100 // percent + 1)
        for (lower, upper), (segments, deleting, spare) in zip(zip(edges, edges[1:], strict=False), allocation(edges, {i: 1000 for i in range(len(edges))}, percent), strict=True):
            most = (100 - percent) * (upper - 1) // percent
            assert not most and not segments or segments + deleting >= most + 1 + spare and lower


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (1, 0)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[200 + i] for i in range(30)} == {100}
    assert components(edges.limit(0)).count() == 0


def test_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_EDGES", 5)
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    edges = spark.createDataFrame([(500, i) for i in range(100)] + [(i, 1000 + i) for i in range(40)] + [(3000, 3001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[i] for i in [*range(100), 500, *range(1000, 1040)]} == {0} and got[3001] == 3000
