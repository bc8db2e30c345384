import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugewright.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(st.sampled_from("abZé '.,!1\n\t 日ß×­ s"), max_size=40)))
def test_pieces_encode_as_whole_texts(text):
    encode = tokenfile.encoder(PATH)
    assert np.frombuffer(encode(text), encode.kind).tolist() == ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|> b", "a b<|endoftext|>", "it's 's x", "a...", "word.\nNext word", "a\n\nb c", "x' y's z", "naïve×÷ x÷y"])
def test_odd_texts(text):
    encode = tokenfile.encoder(PATH)
    assert np.frombuffer(encode(text), encode.kind).tolist() == ids(text)


def test_other_rules_encode_whole_texts(tmp_path):
    """A file whose pre-tokenizer or normaliser isn't the known one gives its own ids all the same."""
    file = json.load(open(PATH))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.json")
        json.dump(file | change, open(path, "w"))
        encode, other = tokenfile.Encoder(path), Tokenizer.from_file(path)
        for text in ("The  Quick brown fox", "a b", " x\ny"):
            assert not encode.cuts and np.frombuffer(encode(text), encode.kind).tolist() == other.encode(text, add_special_tokens=False).ids
    assert tokenfile.encoder(PATH).cuts


def test_memory_is_bounded(monkeypatch):
    """Pieces are remembered up to a number of bytes, and texts without spaces not at all."""
    encode = tokenfile.Encoder(PATH)
    rng = random.Random(9)
    for i in range(100):
        text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
        assert np.frombuffer(encode(text), encode.kind).tolist() == ids(text)
    assert encode.first.bytes + encode.later.bytes == 0 and not len(encode.first)
    monkeypatch.setattr(tokenfile, "PIECE_BYTES", 3000)
    for i in range(200):
        encode(f"w{i} x{i} y{i}.")
        assert encode.first.bytes + encode.later.bytes < 3000 + 2000 and len(encode.later) < 30


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_varbyte_round_trip(values):
    x = np.array(values, np.uint32)
    control, data = tokenfile.encode_ranks(x)
    assert len(control) == -(-len(x) // 4) and (tokenfile.decode_ranks(control, data, len(x)) == x).all()


def test_files(documents, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    rng = random.Random(5)
    rows = [(i * 11 % 301, " ".join(rng.choice(["the", "of", "Größe", "x1", "\n", "  "]) for _ in range(rng.choice([0, 1, 9, 200])))) for i in range(150)] + [(500, None), (501, ""), (502, "a" * 30_000), (-3, "negative")]
    files, by_rank = tokenfile.write_token_files(documents(rows), PATH)
    got = sorted(tokenfile.read_token_files(files, by_rank).collect(), key=lambda r: r["start"])
    start = 0
    for (doc, text), r in zip(sorted(rows), got, strict=True):
        want = np.array([*ids(text or ""), 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) == (doc, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    counts = np.bincount(np.concatenate([[*ids(t or ""), 0] for _, t in rows]))
    assert (np.diff(counts[by_rank]) <= 0).all() and len(by_rank) == (counts > 0).sum()


def test_empty_and_repeated(documents):
    files, by_rank = tokenfile.write_token_files(documents([]), PATH)
    assert tokenfile.read_token_files(files, by_rank).count() == 0
    files, by_rank = tokenfile.write_token_files(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH)
    got = sorted(tokenfile.read_token_files(files, by_rank).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1] and got[1]["ids"] == got[2]["ids"]
