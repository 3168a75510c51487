"""Chat formatting: conversations through a compiled template, with a loss mask.

Turns are shuffled by conversation and sorted by turn; each task then streams its
conversations through the template, one output row per turn, so memory holds one turn at a
time however long a conversation is. Control strings inside texts and roles are escaped
reversibly; ``read_back`` parses the formatted text again.

Defined results: rows in order of (turn, role, text), nulls first; a null text or role is empty;
a null conversation id is a conversation; repeated rows are turns of their own; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import END, Template

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
TEMPLATE = ("{% for m in messages %}### {{ m.role | escape_role }}: "
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
            "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}")

_TEXT = re.compile(r"\\|### |</turn>")
_ROLE = re.compile(r"\\|:|### |</turn>")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    """As ``escape``, and before every colon."""
    return _ROLE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _find(text: str, mark: str, start: int) -> int:
    """The first ``mark`` that no odd run of backslashes precedes."""
    at = text.find(mark, start)
    while at >= 0:
        k = at
        while k > start and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at = text.find(mark, at + 1)
    raise ValueError("a turn is not closed")


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    if not formatted.startswith(OPEN):
        raise ValueError("a turn must start with its marker")
    colon = _find(formatted, COLON, len(OPEN))
    close = _find(formatted, CLOSE, colon + len(COLON))
    if formatted[close + len(CLOSE):] != "\n":
        raise ValueError("text after the end of a turn")
    return unescape(formatted[len(OPEN):colon]), unescape(formatted[colon + len(COLON):close])


def chat_template(source: str = TEMPLATE) -> Template:
    return Template(source, {"escape": escape, "escape_role": escape_role})


_TURNS = "conv_id long, turn_no long, offset long, formatted string, starts array<int>, ends array<int>"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, iterator of messages) of runs of equal ids in a sorted stream; the id of a run is
    known before its messages are read."""
    rows = ((c, {"role": r or "", "text": t or ""}) for b in batches
            for c, r, t in zip(*(b.column(k).to_pylist() for k in range(3))))
    head = next(rows, None)

    def run(conv):
        nonlocal head
        while head is not None and head[0] == conv:
            message = head[1]
            head = next(rows, None)
            yield message
    while head is not None:
        conv = head[0]
        yield conv, run(conv)


def _format(source: str, batch_rows: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = chat_template(source)
        out: list = []

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(),
                                                          pa.list_(pa.int32()), pa.list_(pa.int32())))],
                names=["conv_id", "turn_no", "offset", "formatted", "starts", "ends"])

        for conv, messages in _conversations(batches):
            parts, starts, ends, size, offset, number = [], [], [], 0, 0, 0
            for piece, gen in template.stream({"messages": messages}):
                if piece is not END:
                    if gen and piece:
                        starts.append(size)
                        ends.append(size + len(piece))
                    parts.append(piece)
                    size += len(piece)
                    continue
                out.append((conv, number, offset, "".join(parts), starts, ends))
                offset, number = offset + size, number + 1
                parts, starts, ends, size = [], [], [], 0
                if len(out) >= batch_rows:
                    yield flush()
            for _ in messages:                             # a template may leave messages unread
                pass
            if parts:                                      # text after the last turn
                out.append((conv, number, offset, "".join(parts), starts, ends))
        if out:
            yield flush()
    return run


def format_conversations(turns: DataFrame, source: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: the formatted text, its offset in the conversation's text, and the
    spans under the loss mask (code points within the row). The rows of a conversation are
    consecutive and in order within a partition."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(role_col).cast("string").alias("role"),
                        F.col(text_col).cast("string").alias("text"), F.col(turn_col).cast("long").alias("turn"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .drop("turn").mapInArrow(_format(source), _TURNS))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    done, state = [], None

    def close():
        done.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

    for b in batches:
        for conv, text, starts, ends in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5))):
            if state is None or state["id"] != conv:
                if state is not None:
                    close()
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
            role, said = parse_turn(text)
            state["n"] += 1
            state["turns"].update(f"{role}\n{said}\n".encode())
            for s, e in zip(starts, ends):
                learned = unescape(text[s:e])
                state["chars"] += len(learned)
                state["loss"].update(learned.encode())
            state["all"] += len(text)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done = []
    if state is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from ``format_conversations``' own rows."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long")
