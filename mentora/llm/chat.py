"""Chat formatting from event logs: fold each conversation's events into messages, then render.

Events of a conversation are sorted by sequence number and folded one by one:

* ``start`` opens a message with a role, ``delta`` appends text to a message, ``edit`` replaces a message's text;
* ``regenerate`` empties a message and drops all messages after it.

A delta, edit or regeneration of an unknown message is ignored, as is a second start of a known one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
RENDERED = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    """No control string is left in the result: a backslash is doubled and ``<|`` gets one inside."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the messages that (event, message_id, role, text) in order leave."""
    order: list = []
    roles: dict = {}
    parts: dict = {}
    for event, message, role, text in events:
        if event == "start" and message not in roles:
            order.append(message)
            roles[message], parts[message] = role or "", [text] if text else []
        elif message not in roles:
            continue
        elif event == "delta":
            parts[message].append(text or "")
        elif event == "edit":
            parts[message] = [text or ""]
        elif event == "regenerate":
            parts[message] = [text or ""]
            while order[-1] != message:  # each message goes once, so this is linear in the log
                x = order.pop()
                del roles[x], parts[x]
    return [(roles[m], "".join(parts[m])) for m in order]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the code point spans of the texts under the loss mask."""
    out, at, starts, ends = [], 0, [], []
    for role, text in messages:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for turn in formatted.split(BEGIN)[1:]:
        role, _, body = turn.removesuffix(END).partition("\n")
        out.append((unescape_role(role), unescape(body)))
    return out


def turn_events(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as the event log of a conversation as it comes about.

    Every turn has a start and two streamed halves of its text in false order; then an assistant's is regenerated, followed
    by a message that is dropped again with a second regeneration, and streamed anew, and any other is edited to the
    whole text. So what is left are the turns.

    Turns with equal number follow each other by role, then in input order. A null text has empty events; a null turn
    number comes first; other columns are ignored; an empty table has no events.
    """
    piece = lambda event, step, text, late=False: F.struct(F.lit(event).alias("event"), F.lit(step).alias("step"), F.expr(text).alias("text"), F.lit(late).alias("late"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    half = "cast(ceil(length(text) / 2) as int)"
    first, rest = f"substring(text, 1, {half})", f"substring(text, {half} + 1)"
    opened = [piece("start", 0, "''"), piece("delta", 1, rest), piece("delta", 2, first)]
    again = [piece("regenerate", 3, "''"), piece("start", 4, "text", True), piece("delta", 5, "text", True), piece("regenerate", 6, "''"), piece("delta", 7, first), piece("delta", 8, rest)]
    rows = rows.withColumn("e", F.explode(F.when(F.col("role") == LOSS_ROLE, F.array(*opened, *again)).otherwise(F.array(*opened, piece("edit", 3, "text")))))
    message = F.concat(F.col("message").cast("string"), F.when(F.col("e.late"), "-dropped").otherwise(""))
    return rows.select("conv_id", F.struct("turn", "role", "message", "e.step").alias("sequence"), F.col("e.event").alias("event"), message.alias("message"), "role", F.col("e.text").alias("text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render an event log (conv_id, sequence, event, message, role, text), whatever types sequence and message have.

    Returns conv_id, n_turns, formatted, loss_starts and loss_ends (code points of the escaped assistant texts). Events
    without conv_id form one conversation; of events with equal sequence number, those with lesser event, role and text
    come first; an empty log gives no rows; other columns are ignored. A task streams its sorted partition and holds the
    messages of one conversation.
    """
    ordered = events.select(F.col("conv_id").cast("long"), "sequence", "event", F.col("message").cast("string"), "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "sequence", "event", "role", "text").drop("sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "event", "message", "role", "text")), strict=True))
        done: list[tuple] = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            messages = fold(r[1:] for r in group)
            done.append((conv, len(messages), *render(messages)))
            if len(done) == 256:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return ordered.mapInArrow(run, RENDERED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    ``formatted`` has the columns of ``format_conversations`` without nulls but in conv_id; one row for each of its rows,
    repeated ones too; an empty table gives none; other columns are ignored; texts are read whole.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
