"""Chat records from event logs: messages are folded from their events, then rendered with a template.

Events are partitioned by conversation and sorted by message and sequence number, so a task holds one message at a
time however long a conversation is. A message starts with ``open`` (its role), grows by ``delta`` (streamed text),
is replaced by ``edit``, and starts anew with ``regenerate``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import map_arrow

#: Control strings of common chat templates, none of which may appear in a text as it is.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>"]
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"

_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_length long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    """Backslashes are doubled, and control strings get one after their first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn with its marks, and where the text that is trained on starts and how long it is (0 for other roles)."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(body) if role == TRAINED_ROLE else 0


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head = _HEAD.match(formatted, len(START))
    return unescape(head[1]), unescape(formatted[head.end() : formatted.index(END, head.end())])


def _plain(value) -> str:
    return "" if value is None else value


def _rows(batches, names):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _out(rows: list[tuple], schema: str):
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _emit(rows, schema: str, most: int = 1000, chars: int = 8_000_000):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield _out(held, schema)
            held, size = [], 0
    if held:
        yield _out(held, schema)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def fold_and_render(events: DataFrame) -> DataFrame:
    """Rendered turns of all conversations, in order of ``turn``, from their events.

    A message without ``open`` has an empty role; null texts and roles are empty; deltas before an edit are lost to it,
    later ones are added to it. Events with an unknown kind are an error. A null ``conv_id`` is a conversation of its
    own. Events of a message with one ``seq`` are taken in the order of kind, role and text. Repeated events count as
    often as they occur; other columns are not used. ``loss_start`` and ``loss_length`` give the trained span inside
    ``formatted``, in code points.
    """

    def fold(batches):
        def messages():
            key, role, parts = None, "", []
            for conv, message, kind, own_role, text in _rows(batches, ["conv_id", "message", "kind", "role", "text"]):
                if (conv, message) != key:
                    if key is not None:
                        yield *key, role, "".join(parts)
                    key, role, parts = (conv, message), "", []
                if kind == "open":
                    role = _plain(own_role)
                elif kind == "delta":
                    parts.append(_plain(text))
                elif kind == "edit":
                    parts = [_plain(text)]
                elif kind == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown event kind {kind!r}")
            if key is not None:
                yield *key, role, "".join(parts)

        def turns():
            before, turn = object(), 0
            for conv, _, role, text in messages():
                turn = turn + 1 if conv == before else 0
                before = conv
                formatted, start, length = render_turn(role, text)
                yield conv, turn, role, text, formatted, start, length

        yield from _emit(turns(), TURNS)

    return map_arrow(_by_conversation(events, "message", "seq", "kind", "role", "text"), fold, TURNS)


def digests(turns: DataFrame, together: bool = False) -> DataFrame:
    """Counts and digests of each conversation, read back from its rendered turns in order of ``turn``.

    ``together`` says that each conversation lies in one partition in order, as :func:`fold_and_render` leaves it.
    """

    def read_back(batches):
        def conversations():
            key, state = object(), None
            for conv, turn, formatted, start, length in _rows(batches, ["conv_id", "turn", "formatted", "loss_start", "loss_length"]):
                if conv != key or state is None:
                    if state is not None:
                        yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                loss = unescape(formatted[start : start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            if state is not None:
                yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _emit(conversations(), DIGESTS)

    return map_arrow(turns if together else _by_conversation(turns, "turn"), read_back, DIGESTS)


def events_of(conversations: DataFrame, piece: int = 200) -> DataFrame:
    """An event log that leads to the given conversations.

    A row opens a message; its text arrives in deltas of ``piece`` code points. Every assistant message first streams
    a draft that is regenerated, and every second user message is edited into its text. Messages are numbered by
    ``turn`` (null first), equal turns by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), text.alias("text")
    ).withColumn("message", F.row_number().over(order).cast("long"))

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(piece))
    deltas = F.transform(starts, lambda i: event("delta", F.substring("text", i, F.lit(piece))))
    nothing = F.lit(None).cast("string")
    draft = F.array(event("delta", F.concat(F.reverse("text"), F.lit("?"))), event("regenerate", nothing))
    edited = F.array(event("delta", F.lit("draft")), event("edit", F.col("text")))
    body = (
        F.when(F.col("role") == TRAINED_ROLE, F.concat(draft, deltas))
        .when((F.col("role") == "user") & (F.col("message") % 2 == 0), edited)
        .otherwise(deltas)
    )
    log = rows.select("conv_id", "message", "role", F.posexplode(F.concat(F.array(event("open", nothing)), body)).alias("seq", "e"))
    return log.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
