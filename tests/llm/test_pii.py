import math
import random
import re

import pytest

from gaugewright.llm import pii
from gaugewright.llm.pii import base_spans, cleaned, luhn, personal_data, sanitised

#: The patterns as the contract gives them.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "1", "25", ".", "@", "+", "-", " ", "_", "%", "é", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "+49 (30) 123456", "(", "\n"]) for _ in range(rng.randrange(14)))
        assert base_spans(text) == brute(text), text


def test_linear_in_the_text():
    for text in ("a" * 200_000, "1" * 200_000, "+1" * 50_000, "a@" * 50_000, "1." * 100_000, "." * 200_000):
        base_spans(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_terms_that_disclose(documents):
    """A word that only ever stands by one address discloses it; common words and words of one context don't."""
    rng = random.Random(0)
    common = [f"c{i}ommon" for i in range(40)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{some(6)} zanzibar {some(3)} boss@firm.example {some(9)}") for i in range(6)]
    rows += [(10 + i, f"the same words always here boss@firm.example and ubiquitous after") for i in range(5)]
    rows += [(100 + i, some(30)) for i in range(300)] + [(1000, None), (1001, ""), (1002, f"{some(4)} zanzibar"), (0, "x@y.zz repeated id")]
    found = {}
    for r in personal_data(documents(rows)).collect():
        found.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["spans"]])
    texts = dict(rows)
    for i in range(1, 6):
        terms = {texts[i][s:e] for k, s, e in found[i][0] if k == "term"}
        assert terms == {"zanzibar"}
    assert found[1002] == [[("term", texts[1002].index("zanzibar"), len(texts[1002]))]] and [[]] == found[1000] == found[1001]
    assert all(k != "term" for s in found[12] for k, _, _ in s)
    assert len(found[0]) == 2
    clean = {r["doc_id"]: r for r in sanitised(documents(rows)).collect()}
    assert "zanzibar" not in clean[1]["text"] and "[EMAIL]" in clean[1]["text"] and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[1002]["text"] == texts[1002].removesuffix("zanzibar") and clean[1000]["text"] is None and clean[1]["part"] == "x"


@pytest.mark.parametrize("rows_of_a_file", [1, 500_000])
def test_terms_in_texts_without_the_entity(documents, monkeypatch, rows_of_a_file):
    """A term over the threshold is found, and goes, where no entity is spelled out."""
    monkeypatch.setattr(pii, "DICTIONARY_ROWS", rows_of_a_file)
    rng = random.Random(1)
    some = lambda n: " ".join(f"c{rng.randrange(40)}ommon" for _ in range(n))
    rows = [(i, f"{some(6)} zanzibar quagga{i % 2} {some(3)} boss@firm.example {some(9)}") for i in range(6)] + [(100 + i, some(30)) for i in range(300)]
    rows += [(1000, "é Zanzibar, quagga1 and zanzibar"), (1001, "zanzibars"), (1002, "call x@y.zz in zanzibar"), (1003, None)]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in personal_data(documents(rows)).collect()}
    assert found[1000] == [("term", 2, 10), ("term", 12, 19), ("term", 24, 32)] and found[1001] == [] == found[1003]
    assert found[1002] == [("email", 5, 11), ("term", 15, 23)]
    clean = {r["doc_id"]: r["text"] for r in sanitised(documents(rows)).collect()}
    assert "anzibar" not in clean[1000] + clean[1002] and clean[1001] == "zanzibars" and clean[1003] is None


def test_terms_far_from_the_entity(documents):
    """Co-occurrence is by document: a heading's name and an address at the end meet, and short names count."""
    rng = random.Random(2)
    some = lambda n: " ".join(f"c{rng.randrange(40)}ommon" for _ in range(n))
    rows = [(i, f"Zanzibar Wu {some(40)} boss@firm.example") for i in range(6)] + [(100 + i, some(30)) for i in range(300)]
    for r in personal_data(documents(rows)).collect():
        assert [(s["kind"], s["start"], s["end"], s["disclosure"]) for s in r["spans"] if s["kind"] == "term"] == ([("term", 0, 8, 1.0), ("term", 9, 11, 1.0)] if r["doc_id"] < 6 else [])


def test_same_block_in_different_texts(documents):
    """A signature that stands word for word in different texts discloses; in copies of one text it doesn't."""
    rng = random.Random(3)
    some = lambda n: " ".join(f"c{rng.randrange(40)}ommon" for _ in range(n))
    block = "all the best from this our office, please always contact Johann Schmidt at j@firm.example or else just write him, call him daily, then wait for his answer"
    rows = [(i, f"{some(20)} {block} {some(20)}") for i in range(3)] + [(10 + i, "a copied notice by Erika, e@firm.example") for i in range(5)] + [(100 + i, some(30)) for i in range(300)]
    texts = dict(rows)
    for r in personal_data(documents(rows)).collect():
        terms = {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"}
        assert terms >= {"Johann", "Schmidt"} if r["doc_id"] < 3 else not terms


def test_documents_count_once(documents):
    """An entity that a document mentions often counts once in it, for its own share and for its terms'."""
    rng = random.Random(4)
    some = lambda n: " ".join(f"c{rng.randrange(40)}ommon" for _ in range(n))
    often = lambda name, word: " ".join(f"{some(9)} {word} {name} {some(9)}" for _ in range(3))
    rows = [(i, often("hot@firm.example", "zanzibar")) for i in range(100)] + [(100, often("rare@firm.example", "quagga"))]
    rows += [(101 + i, f"{some(20)} rare@firm.example {some(20)}") for i in range(2)] + [(110 + i, f"{some(20)} quagga") for i in range(2)] + [(200 + i, some(30)) for i in range(195)]
    texts = dict(rows)
    for r in personal_data(documents(rows)).collect():
        terms = {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"}
        assert terms == ({"zanzibar"} if r["doc_id"] < 100 else set())


def test_dictionary_in_several_files(documents, monkeypatch):
    monkeypatch.setattr(pii, "DICTIONARY_ROWS", 1)
    monkeypatch.setattr(pii, "TERMS", 1)
    monkeypatch.setattr(pii, "TEXT_BYTES", 500)
    rows = [(i * 10 + j, f"w{i * 1000 + j * 7} w{j * 31} special{i} p{i}@x.yy w{i * 77 + j} v{j}") for i in range(4) for j in range(5)] + [(500 + i, f"plain text number {i}") for i in range(50)]
    for r in personal_data(documents(rows)).collect():
        kinds = [s["kind"] for s in r["spans"]]
        assert kinds == (["email"] if r["doc_id"] < 500 else []) + ["term"] * kinds.count("term")
        if r["doc_id"] < 500:
            assert f"special{r['doc_id'] // 10}" in {dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def by_hand(rows):
    """{term: greatest disclosure} over all entities, from the definition."""
    docs = [t for _, t in rows if t]
    n, names, words = len(rows), [], []
    for t in docs:
        found = set()
        for kind, s, e in brute(t):
            v = t[s:e].lower()
            digits = re.sub("[^0-9]", "", v)
            found |= {"email": {v, v.split("@")[-1]}, "ip": {v, v.rsplit(".", 1)[0]}, "card": {f"c{digits}"}, "phone": {f"p{digits}", f"p{digits[:-4]}"}}[kind]
        names.append(found)
        words.append(set(WORD.findall(lower(t))))
    out = {}
    for entity in set().union(*names):
        has = [entity in x for x in names]
        n_entity = sum(has)
        if len({t for t, h in zip(docs, has) if h}) < pii.LEAST_TEXTS or n_entity == n:
            continue
        bits = math.log2(n / n_entity)
        for term in set().union(*(w for w, h in zip(words, has) if h)):
            n_both, n_term = sum(term in w and h for w, h in zip(words, has)), sum(term in w for w in words)
            texts = len({t for t, w, h in zip(docs, words, has) if h and term in w})
            disclosure = 1 - math.log2(n_term / n_both) / bits
            if texts >= pii.LEAST_TEXTS and texts * bits >= math.log2(n) + pii.CHANCE_BITS and disclosure >= pii.GENERALISE - 1e-12:
                out[term] = max(out.get(term, 0), disclosure)
    return out


@pytest.mark.parametrize("seed,most", [(0, 4_000_000), (1, 4_000_000), (1, 10)])
def test_disclosure_by_brute_force(documents, monkeypatch, seed, most):
    """Term spans and their disclosures are those of the definition: addresses, domains, networks and exchanges, by chance or not, counted by workers or by shuffle."""
    monkeypatch.setattr(pii, "TERMS", most)
    rng = random.Random(seed)
    common = [f"c{i}ommon" for i in range(60)] + ["Größe", "x1"]
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(rng.randrange(4, 25))]
        if i < 60:
            g = i % 6
            words += [f"p{i}@firm{g}.example", f"10.0.{g}.{i}", f"+49 30 55{g}{g} {1000 + i}", f"boss{g}" if rng.random() < 0.9 else "x", f"code{g // 2}", "Hello" if i % 3 else "hello"]
            if g == 0:
                words += ["Hauptbüro"]
            rng.shuffle(words)
        if 60 <= i < 64:
            words += ["boss1", "code0"]
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1])]
    want, texts = by_hand(rows), dict(rows)
    assert len(want) > 8
    for r in personal_data(documents(rows)).collect():
        text = texts[r["doc_id"]] or ""
        inside = [(s, e) for _, s, e in brute(text)]
        hit = [(m.start(), m.end(), want[m[0]]) for m in WORD.finditer(lower(text)) if m[0] in want and not any(s < m.end() and m.start() < e for s, e in inside)]
        got = [(s["start"], s["end"], s["disclosure"]) for s in r["spans"] if s["kind"] == "term"]
        assert [x[:2] for x in got] == [x[:2] for x in hit] and [x[2] for x in got] == pytest.approx([x[2] for x in hit])


def test_cleaned():
    assert cleaned("a b@c.d e", [("email", 2, 7, 1.0), ("term", 0, 1, 0.9), ("term", 8, 9, 0.99)]) == "[TERM] [EMAIL] "
    assert cleaned("0123456789", [("ip", 0, 5, 1.0), ("card", 3, 8, 1.0)]) == "[IP][CARD]89"


def test_empty(documents):
    assert personal_data(documents([])).count() == 0 == sanitised(documents([])).count()
