"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as

    <|im_start|>ROLE NEWLINE TEXT <|im_end|> NEWLINE

and reparsed by a deterministic parser.  The turns it recovers are compared
to the source; turns that differ are escaped, and the conversation is
rendered and reparsed until every turn comes back unchanged.  Escaping adds
one backslash to every ``<``, backslashes, ``|`` sequence, so no control
string is left inside a text, and taking one backslash away undoes it.
Roles are escaped the same way, their line breaks and backslashes too.

Only one conversation is in a task's memory at a time: rows are dealt by
conversation, sorted inside the partitions, and streamed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed control strings of the template.
START = "<|im_start|>"
END = "<|im_end|>"

_OPENERS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
# neither a role nor a text may hold "<|", and a role is one line
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|)[^\n])*)\n([^<]*(?:<(?!\|)[^<]*)*)<\|im_end\|>\n")
_ROLE_BACK = re.compile(r"\\([\\np])")

OUT_BYTES = 8_000_000  # formatted text gathered before a batch is handed on

SCHEMA = ("conv_id bigint, formatted string, n_turns bigint, rounds int, turns_sha256 string, loss_spans "
          "array<struct<start:bigint,end:bigint>>, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def escape(text: str) -> str:
    return _OPENERS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return _ROLE_BACK.sub(lambda m: {"\\": "\\", "n": "\n", "p": "|"}[m[1]], role)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, start and end being the code
    point span of the text; None if the whole is not a sequence of turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            return None
        turns.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, int]:
    """The formatted text and the number of renderings it took."""
    written, rounds = list(turns), 0
    while True:
        rounds += 1
        formatted = render(written)
        back = parse(formatted)
        if back is not None and [(r, t) for r, t, _, _ in back] == turns:
            return formatted, rounds
        # a turn ends at its own control string, so it can be judged alone
        wrong = [i for i, x in enumerate(written) if x == turns[i] and [
            (r, t) for r, t, _, _ in parse(render([x])) or []] != [turns[i]]]
        for i in wrong:
            written[i] = (escape_role(turns[i][0]), escape(turns[i][1]))
        if not wrong:
            raise ValueError("a conversation does not survive its template")


def loss_text(formatted: str, loss_role: str = "assistant") -> tuple[list[tuple[int, int]], str]:
    """Spans under the loss mask (texts of ``loss_role``) and what they say."""
    spans = [(s, e) for r, _, s, e in parse(formatted) or [] if r == loss_role]
    return spans, "".join(unescape(formatted[s:e]) for s, e in spans)


def _row(conv_id, turns: list[tuple[str, str]], loss_role: str) -> dict:
    formatted, rounds = format_conversation(turns)
    back = parse(formatted) or []
    spans, loss = loss_text(formatted, loss_role)
    said = hashlib.sha256()
    for role, text, _, _ in back:
        said.update(f"{role}\n{text}\n".encode())
    return {"conv_id": conv_id, "formatted": formatted, "n_turns": len(back), "rounds": rounds,
            "turns_sha256": said.hexdigest(), "loss_spans": [{"start": s, "end": e} for s, e in spans],
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
            "formatted_chars": len(formatted)}


def format_chats(conversations: DataFrame, loss_role: str = "assistant", keep_text: bool = True) -> DataFrame:
    """One row per conversation (SCHEMA): the formatted text, and what is read
    back from it -- turns, their digest, the loss spans (code points) and the
    digest of the text under the loss mask.

    Turns are ordered by turn, then role, then text, so equal numbers have a
    defined order; repeated rows are turns of their own.  A NULL role or text
    counts as empty, NULL turns come first, rows without conv_id form one
    conversation.  Other columns are ignored; an empty table gives no rows.
    ``keep_text=False`` leaves ``formatted`` and ``loss_spans`` NULL.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("rounds", pa.int32()),
        ("turns_sha256", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for conv_id, group in groupby(rows(batches), key=lambda r: r[0]):
            row = _row(conv_id, [(role, text) for _, role, text in group], loss_role)
            held += row["formatted_chars"]
            out.append(row if keep_text else {**row, "formatted": None, "loss_spans": None})
            if held > OUT_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    c = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)
