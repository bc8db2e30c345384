import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.llm import textkit

TEXT = st.text(st.sampled_from("aAbB1 .\n\té日\x0b-"), max_size=40)


def words_of(texts, member, **more):
    out = []
    for lo, hi, data, offsets in textkit.chunks(pa.array(texts, pa.string()), 16):
        found = textkit.words(data, offsets, member, **more)
        for r in range(hi - lo):
            out.append([(bytes(data[s:e]), h) for s, e, h in zip(found.start[found.first[r] : found.first[r + 1]], found.end[found.first[r] : found.first[r + 1]], found.hash[found.first[r] : found.first[r + 1]], strict=True)])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_a_pattern(texts):
    for member, pattern in ((textkit.NONSPACE, r"[^\x20\x09-\x0D]+"), (textkit.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        got = words_of(texts, member)
        assert [[w for w, _ in x] for x in got] == [[w.encode() for w in re.findall(pattern, t or "")] for t in texts]
        by = {}
        for w, h in (p for x in got for p in x):
            key = bytes(w).decode("utf-8", "replace").translate({i: i + 32 for i in range(65, 91)})
            assert by.setdefault(key, h) == h
        assert len(set(by.values())) == len(by)


def test_long_words_come_in_pieces():
    assert [w for w, _ in words_of(["a" * 40 + " b"], textkit.NONSPACE, longest=16)[0]] == [b"a" * 16, b"a" * 16, b"a" * 8, b"b"]


def test_grams_depend_on_order():
    h = textkit.mix(np.arange(5, dtype=np.uint64) + np.uint64(1))
    assert textkit.grams(h, 2)[0] != textkit.grams(h[::-1].copy(), 2)[-1]
    assert len(textkit.grams(h, 6)) == 0


def test_no_rows():
    assert list(textkit.chunks(pa.array([], pa.string()))) == []
    assert [len(x) for x in words_of([None, "", "  "], textkit.NONSPACE)] == [0, 0, 0]
