"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(turns) -> str`` for a list of
``(role, text)``; nothing else about it is assumed.  Each successive prefix of
a conversation is rendered.  Where an output extends the one before, the added
part is the new turn's span; where it does not, the template rewrites history,
and the conversation is reported as such with no loss mask.  Inside a span the
text is located by rendering the same prefix with two different one-letter
texts in the last turn: the outputs part where the text starts, and what
follows them is the turn's tail.

Rendering all prefixes takes time that grows with the square of a
conversation's turns.  A template may declare (``turn_local = True``) that what
it puts out for a turn depends on that turn alone.  Only then, and beyond
``ALL_PREFIXES`` turns, prefixes of the last few turns are rendered instead, and
the result is held against the output for the whole conversation and its
prefixes of doubling lengths; where these don't agree, all prefixes are
rendered.  Every prefix of any other template is rendered, however long the
conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, release

Turn = tuple[str, str]


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...


class MarkedTurns:
    """``### role: text </turn>`` per turn; roles and texts are escaped so that no control string can occur in them."""

    turn_local = True
    # the backslash comes first
    _ESCAPE = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
    _ESCAPE_ROLE = (*_ESCAPE, (":", "\\c"), ("\n", "\\n"))
    _BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
    _OPEN, _MIDDLE, _CLOSE = "### ", ": ", " </turn>\n"

    def render(self, turns: list[Turn]) -> str:
        return "".join([f"{self._OPEN}{self._escaped(role, self._ESCAPE_ROLE)}{self._MIDDLE}{self._escaped(text, self._ESCAPE)}{self._CLOSE}" for role, text in turns])

    @staticmethod
    def _escaped(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
        for plain, escaped in pairs:
            text = text.replace(plain, escaped)
        return text

    def unescape(self, text: str) -> str:
        head, *rest = text.split("\\")
        out, rest = [head], iter(rest)
        for part in rest:
            if part:
                out += [self._BACK[part[0]], part[1:]]
            else:  # an escaped backslash: the next part starts with what followed it
                out += ["\\", next(rest)]
        return "".join(out)

    def parse(self, formatted: str) -> list[Turn]:
        turns = []
        for piece in formatted.split(self._CLOSE)[:-1]:
            role, _, text = piece.removeprefix(self._OPEN).partition(self._MIDDLE)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


Span = tuple[int, int, int, int]
#: Conversations of up to this many turns have all their prefixes rendered, and all conversations with templates that aren't declared turn-local.
ALL_PREFIXES = 64
#: Turns before the new one that are rendered again in a longer conversation.
LOOK_BACK = 8


def _last_turn(template: Template, shown: list[Turn], before: str) -> tuple[str, Span | None]:
    """The output for ``shown`` and the last turn's ``(start, end, text_start, text_end)`` in it; None if it doesn't extend ``before``."""
    now = template.render(shown)
    if not now.startswith(before):
        return now, None
    a, b = (template.render([*shown[:-1], (shown[-1][0], probe)]) for probe in "ab")
    start = len(os.path.commonprefix([a, b]))
    return now, (len(before), len(now), start, len(now) - (len(a) - start - 1))


def _by_prefixes(template: Template, turns: list[Turn]) -> tuple[str, list[Span], int | None]:
    before, spans = template.render([]), []
    for i in range(len(turns)):
        before, span = _last_turn(template, turns[: i + 1], before)
        if span is None:
            return template.render(turns), spans, i
        spans.append(span)
    return before, spans, None


def _by_windows(template: Template, turns: list[Turn]) -> tuple[str, list[Span]] | None:
    """The same for a long conversation in time proportional to it, or None if this can't be relied on.

    Successive prefixes of the last few turns give what each turn adds.  All
    additions together must make up the output for the whole conversation, and
    for its prefixes of doubling lengths.
    """
    made, spans, rewritten = _by_prefixes(template, turns[:ALL_PREFIXES])
    if rewritten is not None:
        return None
    parts, size = [made], len(made)
    ends = [0] * ALL_PREFIXES
    for i in range(ALL_PREFIXES, len(turns)):
        window = turns[i - LOOK_BACK : i + 1]
        before = template.render(window[:-1])
        now, span = _last_turn(template, window, before)
        if span is None:
            return None
        moved = size - len(before)
        spans.append(tuple(x + moved for x in span))
        parts.append(now[len(before) :])
        size += len(parts[-1])
        ends.append(size)
    whole = "".join(parts)
    n = 2 * ALL_PREFIXES
    while n < len(turns):
        if template.render(turns[:n]) != whole[: ends[n - 1]]:
            return None
        n *= 2
    return (whole, spans) if template.render(turns) == whole else None


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[Span], int | None]:
    """The formatted conversation, each turn's ``(start, end, text_start, text_end)``, and the first turn that rewrites history (then the spans end before it)."""
    if getattr(template, "turn_local", False) and len(turns) > ALL_PREFIXES and (found := _by_windows(template, turns)):
        return *found, None
    return _by_prefixes(template, turns)


def format_conversations(rows: DataFrame, template: Template, *, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, spans, loss_spans, rewritten_turn`` for every conversation in ``rows(conv_id, turn, role, text)``.

    Turns go by ``turn`` (null first), then role and text, so ties and repeated
    rows have a fixed order and each is a turn of its own.  A null role or text
    counts as empty; rows with a null conv_id form one conversation.  Other
    columns are not read; an empty table gives an empty result.  A conversation
    is never split: it is streamed through one task.  ``rewritten_turn`` is null
    unless the template rewrites history; then ``loss_spans`` is empty.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def finish(conv, turns: list[Turn]):
        formatted, spans, rewritten = locate(template, turns)
        loss = [] if rewritten is not None else [list(s[2:]) for s, (role, _) in zip(spans, turns, strict=True) if role == loss_role]
        return conv, formatted, [list(s) for s in spans], loss, rewritten

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out: list[tuple] = []
        size, kind = 0, pa.int64()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [kind, pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "formatted", "spans", "loss_spans", "rewritten_turn"])

        def rows_of() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        for conv, group in itertools.groupby(rows_of(), key=lambda r: r[0]):
            out.append(finish(conv, [(r[1] or "", r[2] or "") for r in group]))
            size += len(out[-1][1])
            if size > 4_000_000:
                yield flush()
                out.clear()
                size = 0
        if out:
            yield flush()

    ordered = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return on_workers(ordered.select("conv_id", "role", "text")).mapInArrow(run, f"conv_id {id_type}, formatted string, spans array<array<long>>, loss_spans array<array<long>>, rewritten_turn long")


def read_back(formatted: DataFrame, template: MarkedTurns) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, taken from its output alone."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = template.parse(text)
                masked = "".join(template.unescape(text[a:b]) for a, b in loss)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(3)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turn"])

    return on_workers(formatted.select("conv_id", "formatted", "loss_spans", "rewritten_turn")).mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turn long")


#: Both turns of the conversation -7: a text full of what looks like control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def oracle() -> str:
    """DuckDB SQL for ``read_back`` of all ``conversations`` and the conversation -7, formatted with ``MarkedTurns``."""
    longer = lambda c, escaped: f"2 * length({c}) - length(translate({c}, {escaped}, ''))"
    own = len(MarkedTurns._OPEN) + len(MarkedTurns._MIDDLE) + len(MarkedTurns._CLOSE)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({own} + {longer("role", "'#<:' || chr(92) || chr(10)")} + {longer("text", "'#<' || chr(92)")}) AS BIGINT) AS formatted_chars, CAST(NULL AS BIGINT) AS rewritten_turn
FROM c GROUP BY conv_id"""
