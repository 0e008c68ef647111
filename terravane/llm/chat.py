r"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template.

Rows (conversation, turn, role, text) are dealt by conversation, sorted, and streamed: the machine
holds some megabytes of rows at a time, so a conversation of any length needs no memory for its turns.
Each turn gives three segments: header, content, end. Control strings inside a role or text are
escaped with a backslash, and the escapes are undone on reading, so formatting is reversible.

Defined results: a null text is empty; rows with a null conversation id form one conversation; turns
are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one order and
all stay; unknown or null roles are formatted under a marked header, carry no loss, and make the
conversation invalid. Invalid conversations are flagged, never dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles carry loss, and which role may follow which.

    `follows` maps a state (the last role; "" at the start) to the roles that may come next;
    a conversation may end in a state of `final`.
    """

    open: str = "### "
    role_end: str = ": "
    close: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: str, role: bool = False) -> str:
        """A backslash before each backslash and before each start of a control string (in a role, the end of a role too)."""
        controls = (self.open, self.close.strip(), *((self.role_end.strip(),) if role else ()))
        return re.sub("|".join([r"\\", *(f"(?={re.escape(x)})" for x in controls)]), lambda m: "\\" + m[0], text)

    def header(self, role: str | None) -> str:
        label = self.labels.get(role) if role is not None else "role?"
        return f"{self.open}{label if label else 'role=' + self.escape(role, True)}{self.role_end}"

    def role_of(self, header: str) -> str | None:
        label = header[len(self.open) : -len(self.role_end)]
        if label == "role?":
            return None
        return unescape(label[5:]) if label.startswith("role=") else {v: k for k, v in self.labels.items()}[label]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, turn_no long, part string, segment string, loss boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def format_chats(rows: DataFrame, template: Template = Template(), id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Segments of all conversations, in order within each partition: conv_id, turn_no (from 0), part (header, content, end), segment, loss, valid (the turn was in order)."""
    picked = rows.select(
        F.col(id_column).cast("long").alias("c"), F.col(turn_column).cast("long").alias("n"), F.col(role_column).cast("string").alias("r"), F.col(text_column).cast("string").alias("t")
    )
    dealt = picked.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = object(), "", 0
        for batch in slices(batches, "t"):
            out: list[tuple] = []
            for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("c", "r", "t")), strict=True):
                if c != now:
                    now, state, number = c, "", 0
                valid = r in template.follows.get(state, ())
                loss = r in template.loss
                out.append((c, number, "header", template.header(r), False, valid))
                out.append((c, number, "content", template.escape(t or ""), loss, valid))
                out.append((c, number, "end", template.close, False, valid))
                state, number = r, number + 1
            yield _batch(out, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()], SEGMENTS)

    return in_arrow(dealt, run, SEGMENTS)


def _batch(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads the formatted text of each conversation again and returns its digests.

    It takes the segments as format_chats() leaves them (each conversation in order in one
    partition); turn borders, roles and texts come from the formatted text alone: the loss flag
    is the only other thing used.
    """
    control = re.compile(rf"\\.|{re.escape(template.close)}", re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), None
        for batch in slices(batches, "segment"):
            out: list[tuple] = []
            for c, text, loss, valid in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segment", "loss", "valid")), strict=True):
                if c != now:
                    if held:
                        out.append(held.done())
                    now, held = c, _Reader(c, template, control)
                held.take(text, loss, valid)
            yield _batch(out, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()], DIGEST)
        if held:
            yield _batch([held.done()], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()], DIGEST)

    return in_arrow(segments, run, DIGEST)


class _Reader:
    """Parses the formatted text of one conversation as it comes in; it holds one turn."""

    def __init__(self, conv_id, template: Template, control: re.Pattern):
        self.conv_id, self.template, self.control = conv_id, template, control
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.last, self.pending = True, "", ""

    def take(self, segment: str, loss: bool, valid: bool) -> None:
        self.chars += len(segment)
        self.valid &= valid
        if loss:
            plain = unescape(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.pending += segment
        if self.pending.endswith(self.template.close):
            self._turn()

    def _turn(self) -> None:
        """If the pending text is a whole turn, takes it in."""
        t = self.template
        end = next((m.start() for m in self.control.finditer(self.pending) if m[0] == t.close), -1)
        if end < 0:
            return
        head = re.match(rf"{re.escape(t.open)}(?:\\.|[^\\])*?{re.escape(t.role_end)}", self.pending, re.S)[0]
        role = t.role_of(head)
        self.turns.update(f"{role if role is not None else ''}\n{unescape(self.pending[len(head) : end])}\n".encode())
        self.n_turns, self.last, self.pending = self.n_turns + 1, role, ""

    def done(self) -> tuple:
        valid = self.valid and self.last in self.template.final
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid
