"""Chat formatting: a state machine over roles checks the order of turns and emits segments with a loss flag each.

The template is data. A turn is marked by strings that can't occur in a text: texts are escaped first, so whatever a
text says (a closing tag, an instruction mark) reads back as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import batch
from .staging import ship, width

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a conversation's start, of each role's turns and of other roles' turns; which roles' texts are learned."""

    start: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<<ANS>> ", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    learned: frozenset[str] = frozenset({"assistant"})
    #: Which role may follow which; "" stands for the start.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m.strip() for m in (self.start, *self.other, *(m for pair in self.roles.values() for m in pair))})

    def escape(self, text: str) -> str:
        """Doubles escapes, then breaks each control string after its first character."""
        text = text.replace(ESCAPE, ESCAPE * 2)
        for c in self.controls():
            text = text.replace(c, c[0] + ESCAPE + c[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        out, parts = [], text.split(ESCAPE)
        out.append(parts[0])
        i = 1
        while i < len(parts):
            if parts[i] == "" and i + 1 < len(parts):  # an escaped escape
                out.append(ESCAPE + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        return "".join(out)


Segment = tuple[str, bool]  # text of the output, whether it is learned


class Formatter:
    """Walks the state machine turn by turn. ``errors`` tells each turn that was out of order; such turns are formatted all the same."""

    def __init__(self, template: Template):
        self.template, self.state, self.turns, self.errors = template, "", 0, []

    def turn(self, role: str, text: str) -> list[Segment]:
        t = self.template
        out: list[Segment] = [] if self.turns else [(t.start, False)]
        if role not in t.order.get(self.state, ()):
            self.errors.append(f"turn {self.turns}: {role or 'no role'} after {self.state or 'the start'}")
        before, after = t.roles[role] if role in t.roles else (f"{t.other[0]}{t.escape(role)}{t.other[1]}", t.other[2])
        self.state, self.turns = role, self.turns + 1
        return [*out, (before, False), (t.escape(text), role in t.learned), (after, False)]

    def close(self) -> list[Segment]:
        if self.turns and self.state not in self.template.final:
            self.errors.append(f"ends after {self.state or 'no role'}")
        return [] if self.turns else [(self.template.start, False)]


def _turns(template: Template, text: str, at: int) -> Iterator[tuple[str, str, int]]:
    """Role, text and end of each turn from a turn's start on."""
    while at < len(text):
        for role, (before, after) in template.roles.items():
            if text.startswith(before, at):
                at += len(before)
                break
        else:
            if not text.startswith(template.other[0], at):
                raise ValueError(f"no turn starts at {at}")
            end = text.index(template.other[1], at)
            role, after, at = template.unescape(text[at + len(template.other[0]) : end]), template.other[2], end + len(template.other[1])
        end = text.index(after, at)
        said, at = template.unescape(text[at:end]), end + len(after)
        yield role, said, at


def read_turns(template: Template, text: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of formatted output, from the start or from any turn's start on."""
    for role, said, _ in _turns(template, text, len(template.start) if text.startswith(template.start) else 0):
        yield role, said


def format_turns(turns: Iterable[tuple[str, str]], template: Template | None = None) -> tuple[list[Segment], list[str]]:
    """Segments of a whole conversation and the errors in its order."""
    formatter, out = Formatter(template or Template()), []
    for role, text in turns:
        out += formatter.turn(role, text)
    return out + formatter.close(), formatter.errors


class Reader:
    """Reads turns back from a stream of output and the spans of it that the loss counts; what was read is let go."""

    def __init__(self, template: Template):
        self.template, self.held, self.begin, self.end = template, "", 0, 0  # begin: place of ``held`` in the stream
        self.started, self.spans = False, []

    def feed(self, segments: Iterable[Segment]) -> Iterator[tuple[str, str, list[str]]]:
        """Role and text of each turn that is complete by now, and the texts under the loss in it."""
        for text, learned in segments:
            if learned:
                self.spans.append((self.end, self.end + len(text)))
            self.held += text
            self.end += len(text)
        at = 0
        if not self.started and self.held.startswith(self.template.start):
            self.started, at = True, len(self.template.start)
        for role, text, after in _turns(self.template, self.held, at):
            there = [s for s in self.spans if s[1] <= self.begin + after]
            self.spans = self.spans[len(there) :]
            yield role, text, [self.template.unescape(self.held[a - self.begin : b - self.begin]) for a, b in there]
            at = after
        self.held, self.begin = self.held[at:], self.begin + at


class _Digest:
    """What a conversation's output says, read back from the stream of it."""

    def __init__(self, conversation: int | None, template: Template):
        self.conversation, self.formatter, self.reader = conversation, Formatter(template), Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = 0

    def add(self, role: str, text: str) -> None:
        for role, text, learned in self.reader.feed(self.formatter.turn(role, text)):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for piece in learned:
                self.loss_chars += len(piece)
                self.loss.update(piece.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.formatter.close()
        errors = self.formatter.errors
        return self.conversation, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.reader.end, not errors, errors[0] if errors else None


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, error string"


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Digest | None = None
        for given in batches:
            rows = []
            for conversation, role, text in zip(*(given.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ is None or open_.conversation != conversation:
                    rows += [open_.row()] if open_ else []
                    open_ = _Digest(conversation, template)
                open_.add(role or "", text or "")
            if rows:
                yield batch(DIGEST_SCHEMA, *zip(*rows))
        if open_:
            yield batch(DIGEST_SCHEMA, *zip(*[open_.row()]))

    return run


def _ordered(turns: DataFrame) -> DataFrame:
    """Conversations side by side, their turns in order; a task streams over them and holds one turn at a time."""
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.repartition(width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digest_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """What each conversation's formatted output says when read back, with its length and whether its turns are in order.

    Turns with one number lie in the order of role and text. A null role is an empty name, a null text is empty.
    Rows with a null conv_id are one conversation.
    """
    ship(turns.sparkSession)
    return _ordered(turns).mapInArrow(_digests(template or Template()), DIGEST_SCHEMA)


SEGMENT_SCHEMA = "conv_id long, turn long, segment int, text string, loss boolean"


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, formatter = object(), Formatter(template)
        for given in batches:
            rows = []
            for conv, turn, role, text in zip(*(given.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if conv != conversation:
                    conversation, formatter = conv, Formatter(template)
                rows += [(conv, turn, i, s, learned) for i, (s, learned) in enumerate(formatter.turn(role or "", text or ""))]
            yield batch(SEGMENT_SCHEMA, *(zip(*rows) if rows else [[]] * 5))

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, turn, segment, text, loss``: the output's segments; joined in order they are the formatted conversation.

    Nulls, ties and repeated rows as in ``digest_conversations``; other columns are left out, an empty table gives no rows.
    """
    ship(turns.sparkSession)
    return _ordered(turns).mapInArrow(_segments(template or Template()), SEGMENT_SCHEMA)


def digest_sql(template: Template | None = None) -> str:
    """DuckDB SQL for ``digest_conversations`` of the table ``turns``, without ``error``; roles other than the template's are escaped as texts are."""
    t = template or Template()

    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for x in t.controls():
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.roles.items())
    marks = f"CASE {marks} ELSE {sum(map(len, t.other))} + length({escaped('role')}) END"
    allowed = " OR ".join(f"(coalesce(before, '') = '{a}' AND role IN ({', '.join(repr(x) for x in b)}))" for a, b in t.order.items())
    final = ", ".join(repr(x) for x in t.final)
    learned = ", ".join(repr(x) for x in sorted(t.learned))
    return f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, lag(coalesce(role, '')) OVER w AS before, row_number() OVER w AS k,
  lead(turn) OVER w IS NULL AS at_end FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({learned})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({learned})), '')) AS loss_sha256,
  (sum(length({escaped('text')}) + {marks}) + {len(t.start)})::BIGINT AS formatted_chars,
  bool_and(({allowed}) AND (NOT at_end OR role IN ({final}))) AS in_order
FROM o GROUP BY conv_id"""
