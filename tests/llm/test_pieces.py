import functools
import random

import public_tokenizers

from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = pieces.vocabulary(PATH)


def best_score(unit):
    """The greatest score of any segmentation, by trying every piece at every place."""
    text = pieces.MARK + unit.replace(" ", pieces.MARK)
    own = {k for k, c in enumerate(unit, 1) if c == pieces.MARK}

    @functools.cache
    def upto(end):
        if not end:
            return 0.0
        found = [-float("inf")]
        for begin in range(max(0, end - 20), end):
            i = VOCABULARY.normal.get(text[begin:end])
            if i is not None and not own.intersection(range(begin, end)):
                found.append(upto(begin) + VOCABULARY.score[i])
        if end - 1 in own or text[end - 1] not in VOCABULARY.single:
            found.append(upto(end - 1) + VOCABULARY.unknown)
        return max(found)

    return upto(len(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("theaningsé日😀▁\n\tQ. "), max_size=24))
def test_viterbi_finds_the_best_score(unit):
    unit = unit.lstrip(" ")
    score, ids = VOCABULARY.segmented(unit)
    assert score == best_score(unit)
    assert b"".join(VOCABULARY.raw[i] for i in ids).decode() == " " + unit


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert VOCABULARY.decode(VOCABULARY.encode(text)) == text


def test_long_and_plain_texts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(20_000))
    assert VOCABULARY.decode(VOCABULARY.encode(text)) == text
    whole = "".join(rng.choice("abc") for _ in range(30_000))
    assert VOCABULARY.decode(VOCABULARY.encode(whole)) == whole


def test_table(documents):
    rows = [(1, "Hello  world "), (2, None), (3, ""), (4, "é▁日\x00"), (1, "Hello  world "), (None, "x")]
    made = pieces.encoded(documents(rows), PATH)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in pieces.decoded(made, PATH).collect())
    assert got == sorted(((d or 0), t or "") for d, t in rows)
    assert pieces.encoded(documents([]), PATH).count() == 0
    assert {r["n_tokens"] for r in made.where("doc_id in (2, 3)").collect()} == {0}


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "UNITS", 10)
    for i in range(100):
        assert VOCABULARY.decode(VOCABULARY.encode(f"a{i} b{i} c")) == f"a{i} b{i} c"
    assert len(VOCABULARY) <= 13
    VOCABULARY.clear()
    rng = random.Random(9)
    for _ in range(100):  # units without spaces aren't remembered
        text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
        assert VOCABULARY.decode(VOCABULARY.encode(text)) == text
    assert not len(VOCABULARY)


def test_clashing_text(documents):
    made = pieces.encoded(documents([(1, "a b")]), PATH).selectExpr("*", "'old' as text")
    got = pieces.decoded(made, PATH)
    assert got.columns.count("text") == 1 and got.first()["text"] == "a b"
