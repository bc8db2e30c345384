import io
import random
import re

import numpy as np
import pyarrow as pa

from gaugewright.llm import textkit
from gaugewright.llm.decontaminate import contamination, decontaminated, hits, index_block

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def brute(docs, items, window=10):
    out = {}
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(len(w) - min(window, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_brute_force(spark, documents):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["é", "Ab", "ab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(3, text(15)), (None, text(12)), (50, None), (51, "..."), (60, "w1 " * 30)]
    docs = [(i, text(rng.choice([0, 1, 5, 10, 60, 300]))) for i in range(60)]
    docs += [(100 + i, f"{text(5)}, {(items[i % len(items)][1] or '').upper()}; {text(7)}") for i in range(30)] + [(200, None), (201, ""), (202, "w1 " * 200), (203, "x" * 50_000 + " " + items[4][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id").selectExpr("item_id", "text", "1 as n_hit")
    for size in (16 << 20, 300):  # one block and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(documents(docs), table, block_bytes=size).collect()}
        assert got == brute(docs, items)
    runs = {r["doc_id"]: sum(b - a for a, b in r["runs"]) - r["n_hit"] for r in contamination(documents(docs), table).collect()}
    assert set(runs.values()) == {0}
    assert sorted(r["doc_id"] for r in decontaminated(documents(docs), table).collect()) == sorted(d for d, x in brute(docs, items).items() if not x[1])


def test_repeated_words(spark, documents):
    """Texts of one word, or a few in turn, over and over: the result is brute force's, and pairs of fingerprints don't multiply."""
    items = [(1, "w " * 1000), (2, "a b c " * 300), (3, "w w w"), (4, "a b " * 5), (5, "w " * 12 + "z")]
    docs = [(1, "w " * 20_000), (2, "a b c " * 7000), (3, "w " * 9), (4, "w " * 300 + "z " + "w " * 8), (5, "c a b " * 4), (6, "a b a b a b a b a b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(documents(docs), table).collect()}
    assert got == brute(docs, items)
    block = dict(np.load(io.BytesIO(index_block(["=1"], pa.array([items[0][1]]), 10, 5))))
    assert len(block["keys"]) < 20
    found = textkit.words(np.frombuffer(docs[0][1].encode(), np.uint8), np.array([0, len(docs[0][1])]), textkit.ALNUM)
    assert max(len(x[0]) for x in hits(found, block, 10, 5)) < 1_000_000


def test_repeated_and_empty(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = contamination(documents([(7, "x a b"), (7, "x a b"), (None, "b a")]), items).collect()
    assert sorted(((r["doc_id"] or 0), r["n_hit"]) for r in got) == [(0, 0), (7, 2), (7, 2)]
    assert contamination(documents([]), items).count() == 0
    assert contamination(documents([(1, "a b")]), items.limit(0)).first()["n_hit"] == 0
    assert decontaminated(documents([(1, "a b")]), items.limit(0)).count() == 1
