"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back.

The template marks turns; control strings in a role or text are escaped with
a backslash, and a backslash with another, so the output reads back exactly.
Rows are dealt by conversation and sorted by turn; a conversation is rendered
as a stream, in parts of about ``part_chars``, so a huge one is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.llm.common import by_bytes
from quintet.llm.template import _text, compile_template

TURN, END, NAME = "<turn>", "</turn>\n", "### "
CONTROLS = ("<turn>", "</turn>", "###")
TEMPLATE = (
    "{% for m in messages %}{{ '<turn>### ' ~ (m.role | escape_name) ~ ':\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</turn>\\n' }}{% endfor %}"
)
PART_CHARS = 1 << 20
SCHEMA = "conv_id long, part long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(text: str | None, controls: tuple[str, ...] = CONTROLS) -> str:
    text = _text(text).replace("\\", "\\\\")
    for c in controls:
        text = text.replace(c, "\\" + c)
    return text


def escape_name(role: str | None) -> str:
    return escape(role, (*CONTROLS, ":", "\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS = {"escape": escape, "escape_name": escape_name}


def _unescaped(text: str, mark: str, at: int = 0) -> int:
    """Where ``mark`` stands with no escaping backslash before it, or -1."""
    while (at := text.find(mark, at)) >= 0:
        k = at
        while k and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at += 1
    return -1


def read_turns(parts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted conversation that comes in parts. Raises ValueError for other text."""
    left = ""
    for part in parts:
        left, at = left + part, 0
        while (end := _unescaped(left, END, at)) >= 0:
            if not left.startswith(TURN + NAME, at) or not at < (colon := _unescaped(left, ":\n", at + len(TURN + NAME))) < end:
                raise ValueError("a turn doesn't begin with its mark")
            yield unescape(left[at + len(TURN + NAME) : colon]), unescape(left[colon + 2 : end])
            at = end + len(END)
        left = left[at:]
    if left:
        raise ValueError("the conversation ends inside a turn")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in by_bytes(batches):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, formatted, loss_starts, loss_ends)``; most conversations have the one part 0.

    Rows of a conversation come by turn, ties by role and text, nulls first. Null
    roles and texts are empty; null conv_ids are one conversation. The loss
    spans are code points of their part. Parts of a conversation are neighbours
    in one partition, in order. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = compile_template(template, FILTERS)
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["conv_id", "part", "formatted", "loss_starts", "loss_ends"])
            out.clear()
            size = 0
            return b

        for conv_id, turns in groupby(_rows(batches), key=lambda r: r[0]):
            text, at, starts, ends, part = [], 0, [], [], 0
            for piece, generated in form(messages=({"role": r[2] or "", "text": r[3] or ""} for r in turns)):
                text.append(piece)
                if generated:
                    starts.append(at)
                    ends.append(at + len(piece))
                at += len(piece)
                if at >= part_chars:
                    out.append((conv_id, part, "".join(text), starts, ends))
                    text, at, starts, ends, part = [], 0, [], [], part + 1
                    yield flush()
            if text or not part:
                out.append((conv_id, part, "".join(text), starts, ends))
                size += at
            if size >= part_chars or len(out) >= 1000:
                yield flush()
        if out:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts as ``format_conversations`` gives them: turns, loss text and size.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Rows of null conv_ids are one conversation;
    a conversation without loss text has the digest of the empty text; an empty table gives an empty one. Raises ValueError
    for text that is not formatted so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, parts in groupby(_rows(batches), key=lambda r: r[0]):
            loss, n_loss, chars = hashlib.sha256(), 0, 0

            def texts(parts=parts):
                nonlocal n_loss, chars
                for _, _, text, starts, ends in parts:
                    chars += len(text)
                    for a, b in zip(starts, ends, strict=True):
                        said = unescape(text[a:b])
                        n_loss += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                    yield text

            turns, n = hashlib.sha256(), 0
            for role, text in read_turns(texts()):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            out.append((conv_id, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escape(column: str, controls: tuple[str, ...]) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for c in controls:
        c = f"'{c}'" if c != "\n" else "chr(10)"
        text = f"replace({text}, {c}, '\\' || {c})"
    return text


CHAT_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length({_sql_escape('role', (*CONTROLS, ':', chr(10)))}) + length({_sql_escape('text', CONTROLS)})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
