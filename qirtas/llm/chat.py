r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. A deterministic parser reads
the text back by the same grammar; the turns recovered are compared to the source, and a turn that doesn't come
back identically is escaped (``<`` before any backslashes and ``|`` gets one backslash more, which the parser takes
away). This goes on until all turns are identical, so text without conflicts is never touched. Roles are
percent-encoded outside ``[A-Za-z0-9_-]``.

Cases: turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. A null role or
text counts as empty. Rows with a null ``conv_id`` are one conversation. An empty table gives an empty result.
Texts of any length are processed whole; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> str:
    return "".join(f"{START}{quote(role, safe='')}\n{escape(text) if i in escaped else text}{END}\n" for i, (role, text) in enumerate(turns))


def parse(text: str) -> tuple[list[tuple[str, str]], bool]:
    """The turns of a rendered text, and whether all of it follows the grammar; reading stops at the first error."""
    turns, at = [], 0
    while at < len(text):
        head = text.find("\n", at)
        if not text.startswith(START, at) or head < 0:
            return turns, False
        end = text.find(END, head)
        if end < 0:
            return turns, False
        body = text[head + 1 : end]
        if START in body:
            return turns, False
        turns.append((unquote(text[at + len(START) : head]), _ESCAPED.sub(r"<\1|", body)))
        at = end + len(END)
        if not text.startswith("\n", at):
            return turns, False
        at += 1
    return turns, True


def formatted(turns: list[tuple[str, str]]) -> tuple[str, int]:
    """The rendered conversation, and how many turns had to be escaped for it to read back identically."""
    escaped: set[int] = set()
    while True:
        text = render(turns, escaped)
        got, ok = parse(text)
        if ok and got == turns:
            return text, len(escaped)
        wrong = {i for i, t in enumerate(turns) if i not in escaped and parse(render([t], set())) != ([t], True)}
        if not wrong:
            raise AssertionError("a conversation of sound turns doesn't read back")
        escaped |= wrong


def chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_escaped, rendered: one row for each conversation."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("turns").to_pylist():
                turns = [(t["role"] or "", t["text"] or "") for t in turns]
                out.append((len(turns), *formatted(turns)))
            n, text, escaped = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int32()), pa.array(escaped, pa.int32()), pa.array(text, pa.string())], names=["conv_id", "n_turns", "n_escaped", "rendered"])

    id_type = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.mapInArrow(write, f"conv_id {id_type}, n_turns int, n_escaped int, rendered string")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         contains(coalesce(text, ''), '<|im_start|>') OR contains(coalesce(text, ''), '<|im_end|>')
           OR regexp_matches(coalesce(text, ''), '<\\+\|') AS conflict
  FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE conflict) AS INTEGER) AS n_escaped,
       string_agg('<|im_start|>' || role || chr(10)
                  || CASE WHEN conflict THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END
                  || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t GROUP BY conv_id
"""
