import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugewright.llm import fingerprint, textkit
from gaugewright.llm.fingerprint import CUT, LONGEST, PIECE, Cells, compared, differences, likeness, paragraphs, sketches, version_fingerprints


def digests(texts):
    return paragraphs(pa.array(texts, pa.large_string()))


def test_peeling_recovers_the_difference():
    rng = random.Random(3)
    texts = ["\n".join(f"line {rng.randrange(40)} of many here" for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(40)]
    d, first = digests(texts)
    left, right = np.arange(40), np.array([rng.randrange(40) for _ in range(40)])
    pair, digest, sign, tries = differences((d, first), (d, first), left, right)
    assert tries > 0  # some were too large for the first sketch
    for i in range(40):
        a, b = (set(d[first[x] : first[x + 1]].tolist()) for x in (left[i], right[i]))
        assert Counter(zip(digest[pair == i].tolist(), sign[pair == i].tolist(), strict=True)) == Counter([(x, 1) for x in a - b] + [(x, -1) for x in b - a])
        near = likeness((d, first), (d, first), left[i : i + 1], right[i : i + 1])[0]
        assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_paragraph_cuts_follow_content():
    base = " ".join(f"word{i}" for i in range(400))
    (d, first) = digests([base, f"inserted {base}", base.replace("word200", "other")])
    sets = [set(d[first[i] : first[i + 1]].tolist()) for i in range(3)]
    assert len(sets[0]) > 40 and len(sets[0] ^ sets[1]) <= 6 and 0 < len(sets[0] ^ sets[2]) <= 6


def by_hand(text):
    """The paragraph pieces of a text as a multiset, from the rules alone: lines, cut after words whose hash is a multiple of CUT, at most PIECE words each."""
    out = Counter()
    for line in text.split("\n"):
        words = [w[i : i + LONGEST] for w in re.findall(rb"[^\x20\x09-\x0d]+", line.encode()) for i in range(0, len(w), LONGEST)]
        piece = []
        for w in words:
            piece.append(w.lower())
            hashed = textkit.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), textkit.NONSPACE).hash[0]
            if hashed % np.uint64(CUT) == 0 or len(piece) == PIECE:
                out[tuple(piece)] += 1
                piece = []
        if piece:
            out[tuple(piece)] += 1
    return out


def jaccard(a, b):
    a, b = by_hand(a), by_hand(b)
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_near_by_brute_force(documents):
    """near_edited and near_next are multiset Jaccard of the pieces, and what the stored fingerprints give alone wherever they hold enough."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 7, 40])))
    base = [word() for _ in range(3000)]
    rows = [(i, "".join(word() + rng.choice([" ", "  ", "\n"]) for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(30)]
    rows += [(100 + i, " ".join([*base[: 500 * i], "edit", *base[500 * i :]])) for i in range(5)] + [(200 + i, "same\n" * (20 + i)) for i in range(3)]
    got = {r["doc_id"]: r for r in version_fingerprints(documents(rows)).collect()}
    order, alone = sorted(rows, reverse=True), 0
    for i, (d, t) in enumerate(order):
        following, after = order[(i + 1) % len(order)]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[d]
        assert r["near_edited"] == pytest.approx(jaccard(t, edited)) and r["near_next"] == pytest.approx(jaccard(t, after))
        for other, near in ((r["edited_fingerprint"], "near_edited"), (got[following]["fingerprint"], "near_next")):
            if (found := compared(r["fingerprint"], other)) is not None:
                assert found[2] == pytest.approx(r[near])
                alone += 1
    assert alone >= 10 and compared(got[101]["fingerprint"], got[102]["fingerprint"]) is not None


def test_fingerprints_compare(documents):
    """Two stored fingerprints give the digests that only one text has, also where the sketches are of different sizes."""
    rng = random.Random(5)
    lines = [f"line {i} {rng.random()}" for i in range(420)]
    texts = ["\n".join(lines), "\n".join(lines[:300] + lines[303:] + ["new"]), "\n".join(lines[:3]), "", "\n".join(lines[:2] * 2)]
    d, first = digests(texts)
    stored, sets = sketches(d, first), [set(d[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    assert len(stored[0]) > len(stored[2])
    for i, j in ((0, 0), (0, 1), (2, 3), (2, 4), (3, 3), (4, 3)):
        left, right, near = compared(stored[i], stored[j])
        assert (set(left), set(right)) == (sets[i] - sets[j], sets[j] - sets[i]) and len(left) == len(set(left))
        assert near == pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0)
    assert compared(stored[0], stored[2]) is None
    # a larger sketch folds to what the smaller size would have held
    big = Cells(1, 32, seed=0)
    big.add(np.zeros(len(sets[1]), np.int64), np.array(sorted(sets[1]), np.uint64), np.ones(len(sets[1]), np.int64))
    small = Cells(1, 8, seed=0)
    small.add(np.zeros(len(sets[1]), np.int64), np.array(sorted(sets[1]), np.uint64), np.ones(len(sets[1]), np.int64))
    assert (fingerprint._folded(big, 8).total == small.total).all() and (fingerprint._folded(big, 8).count == small.count).all()


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        out[d] = (n, hashlib.sha256((t[: n - n // 3] + after[: n // 3]).encode()).hexdigest())
    return out


def test_versions(documents):
    rng = random.Random(4)
    rows = [(i * 3, "".join(rng.choice("ab é日\n") for _ in range(rng.choice([0, 1, 2, 3, 50, 3000])))) for i in range(120)] + [(1, None), (2, ""), (4, "x" * 100_000), (1000, "same text here\nand there"), (1001, "same text here\nand there")]
    got = version_fingerprints(documents(rows)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == expected(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["fingerprint"] == by[1001]["fingerprint"] != by[4]["fingerprint"] and by[1001]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 for r in got)


def test_few_and_odd_rows(documents):
    assert version_fingerprints(documents([])).collect() == []
    one = version_fingerprints(documents([(5, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    twice = version_fingerprints(documents([(5, "abc"), (5, "abc"), (None, "xyz")])).collect()
    assert len(twice) == 3
