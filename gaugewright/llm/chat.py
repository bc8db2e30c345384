"""Chat formatting from an event log.

A conversation is a stream of events: a message opens, text deltas arrive, an edit replaces a message's text,
a regeneration discards an answer and streams another. The log is dealt out by conversation, sorted by
sequence number, and folded message by message, so a worker holds one message, however long the conversation.
Each final message is rendered as a row of its own; the rows of a conversation, joined by sequence, are its
formatted text.

Template: a turn is ``<|role|>``, a line feed, the text and ``<|end|>`` with a line feed. In roles and texts
every backslash, every ``<`` and every ``|`` gets a backslash before it, so neither the end of a role nor a
marker can stand in one, and removing the backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "conv_id long, seq long, event string, role string, text string"
END = "<|end|>\n"
#: Code points of a streamed delta.
DELTA = 400
_ESCAPED = re.compile(r"\\([\\<|])")
_HELD = r"([^\\<|]*(?:\\[\\<|][^\\<|]*)*)"
_TURN = re.compile(rf"<\|{_HELD}\|>\n{_HELD}<\|end\|>\n")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("|", "\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the span of its text there (code points)."""
    head = f"<|{escaped(role)}|>\n"
    body = escaped(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text; an error if anything else stands in it."""
    out, at = [], 0
    while at < len(formatted):
        if not (found := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that could have led to finished rows (conv_id, turn, role, text): each message opens and streams its text in deltas.

    Answers of even turns are regenerated once and messages of every third turn are edited once, with a first
    version that doesn't last. Rows of a conversation and turn follow one another by role and text, repeated
    rows each; a null role or text is empty, an empty table gives no events. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the place of a message among those of its turn; its events carry that, and of the text their own part
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda p: event("delta", p))
    opened = F.array(event("open", F.lit("")))
    draft = F.array(event("delta", F.concat(F.lit("draft "), F.substring("text", 1, 40))))
    again = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), F.concat(draft, F.array(event("regenerate", F.lit(""))), deltas))
    edit = F.when(F.col("turn") % 3 == 0, F.concat(draft, F.array(event("edit", F.col("text")))))
    events = F.concat(opened, F.coalesce(again, edit, deltas))
    return rows.select("conv_id", "role", "turn", "place", F.posexplode(events).alias("step", "e")).select("conv_id", F.struct("turn", "place", "step").alias("seq"), F.col("e.event").alias("event"), "role", F.col("e.text").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) for each final message of an event log (conv_id, seq, event, role, text).

    seq is of any type that sorts. Events: ``open`` begins a message of a role, ``delta`` adds text to it,
    ``edit`` replaces its text, ``regenerate`` empties it; turns are numbered from 0 by their opening. The loss
    span is that of the text in ``formatted``, in code points, for the role assistant, else null. A null text
    adds nothing, a null role is empty, a conversation without an id is one of its own. Events before the first
    ``open`` of a conversation and events of another kind raise an error; events of equal seq come in the order
    of kind, role and text. Other columns are ignored.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), "seq", "event", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    log = events.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "event", "role", "text").select("conv_id", "event", "role", "text")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn, role, held, rows = None, -1, "", [], []

        def close() -> None:
            if turn >= 0:
                formatted, start, end = rendered(role, "".join(held))
                answer = role == "assistant"
                rows.append((conv, turn, role, formatted, start if answer else None, end if answer else None))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
            rows.clear()
            return out

        for batch in batches:
            for c, event, r, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    close()
                    conv, turn, held = c, -1, []
                if event == "open":
                    close()
                    turn, role, held = turn + 1, r, [text]
                elif turn < 0 or event not in ("delta", "edit", "regenerate"):
                    raise ValueError(f"event {event!r} of conversation {c} where no message is open" if turn < 0 else f"unknown event {event!r}")
                elif event == "delta":
                    held.append(text)
                else:
                    held = [text] if event == "edit" else []
            yield flush()
        close()
        yield flush()

    return log.mapInArrow(fold, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each conversation of reconstruct's rows.

    Each row's formatted text is parsed again. turns_sha256 is of role, line feed, text and line feed of all
    turns; loss_sha256 of the texts under the loss mask, loss_chars their code points, both unescaped.
    """
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, loss, counts, out, begun = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], [], False

        def close() -> None:
            if begun:
                out.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
            out.clear()
            return made

        for batch in batches:
            for c, _, text, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv or not begun:
                    close()
                    conv, turns, loss, counts, begun = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], True
                for role, said in parsed(text):
                    counts[0] += 1
                    turns.update(f"{role}\n{said}\n".encode())
                counts[2] += len(text)
                if start is not None:
                    masked = unescaped(text[start:end])
                    counts[1] += len(masked)
                    loss.update(masked.encode())
            yield flush()
        close()
        yield flush()

    return rows.mapInArrow(read, schema)
