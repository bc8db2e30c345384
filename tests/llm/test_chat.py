import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.llm import queries
from gaugewright.llm.chat import as_events, parsed, read_back, reconstruct, rendered, unescaped

TEXT = st.text(st.sampled_from("ab\\<|>\n/[]"), max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_template_is_reversible(turns):
    made = [rendered(r, t) for r, t in turns]
    assert parsed("".join(x for x, _, _ in made)) == turns
    for (x, s, e), (_, t) in zip(made, turns, strict=True):
        assert unescaped(x[s:e]) == t


def test_parse_errors():
    with pytest.raises(ValueError, match="no turn"):
        parsed("<|user|>\nhello")


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(rendered(r, t)[0]) for r, t in turns)


def test_conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for turn in range(rng.choice([1, 2, 7, 60])):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a<|end|>\\b", "x |>\ny", "|>\n", "é日" * 900, "x" * 400, f"text {turn}"])))
    rows += [(None, 0, "user", "no id"), (99, 5, "user", "late"), (99, 5, "user", "late"), (99, 5, "assistant", "same turn"), (99, None, "system", "no turn")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, event string")
    got = {r["conv_id"]: tuple(r)[1:] for r in read_back(reconstruct(as_events(table))).collect()}
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: digests(t) for c, t in want.items()}


def test_long_message(spark):
    """A message of a million characters streams in events that carry a delta each, and comes back whole."""
    text = "".join(chr(97 + i % 26) if i % 1000 else "😀|>\n" for i in range(1_000_000))
    table = spark.createDataFrame([(1, 1, "assistant", text), (1, 0, "user", "x |>\ny")], "conv_id long, turn long, role string, text string")
    events = as_events(table)
    assert events.agg(F.max(F.length("text"))).first()[0] <= 400 and "text" not in events.schema["seq"].dataType.names
    assert tuple(read_back(reconstruct(events)).first())[1:] == digests([("user", "x |>\ny"), ("assistant", text)])


def test_sql_agrees(spark, tmp_path):
    """The query's SQL on texts with every character that the template escapes."""
    rows = [(1, 0, "us|er", "a<|>\n\\b|"), (1, 1, "assistant", "|>\n<|end|>\n"), (2, 0, "assistant", None), (2, 1, None, "\\|<")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op6_event_fold(spark, str(tmp_path))
    cursor = base.execute(queries.oracle_sql()["op6_event_fold"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_folding(spark):
    log = [(1, 0, "open", "user", "he"), (1, 1, "delta", None, "llo"), (1, 2, "open", "assistant", ""), (1, 3, "delta", None, "wrong"), (1, 4, "regenerate", None, None), (1, 5, "delta", None, "right"), (1, 6, "open", "user", "typo"), (1, 7, "edit", None, "fixed"), (1, 8, "delta", None, "!")]
    random.Random(1).shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq long, event string, role string, text string")
    got = [parsed(r["formatted"])[0] for r in reconstruct(df).orderBy("turn").collect()]
    assert got == [("user", "hello"), ("assistant", "right"), ("user", "fixed!")]
    assert [r["loss_start"] is not None for r in reconstruct(df).orderBy("turn").collect()] == [False, True, False]
    assert reconstruct(df.limit(0)).count() == 0
    for bad in ((2, 0, "delta", None, "x"), (2, 0, "open", "user", "x", "no"), (2, 0, "vote", None, "x")):
        rows = [bad[:5]] if bad[2] != "open" else [bad[:5], (2, 1, "vote", None, "x")]
        with pytest.raises(Exception, match="no message is open|unknown event"):
            reconstruct(spark.createDataFrame(rows, df.schema)).collect()
