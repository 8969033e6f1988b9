"""Conversations as training text: turns between marks, control strings in texts escaped, read back by a parser."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handed on at once.
ROWS = 256


@dataclass(frozen=True)
class Template:
    """Marks around turns. A turn of a role in `marks` is opening, text, closing; any other is `other`'s opening,
    role, separator, text, closing. `also`: control strings that no mark uses. `learned`: roles under the loss mask.

    No mark lies in another or overlaps it, so each is found where it stands and escapes can be undone."""

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    also: tuple[str, ...] = ()
    learned: tuple[str, ...] = ("assistant",)

    def control(self) -> list[str]:
        found = [*(m for _, *pair in self.marks for m in pair), *self.other, *self.also]
        for (i, a), (j, b) in product(enumerate(found), repeat=2):
            if len(a) < 2 or a[1] == "\\" or b in a[1:] or any(b.startswith(a[k:]) for k in range(i == j, len(a))):
                raise ValueError(f"control strings {a!r} and {b!r} overlap or can't be escaped")
        return found


class Malformed(ValueError):
    """Text that is not a sequence of turns."""


class Grammar:
    """Writes turns of a template and reads them back.

    Escape: one backslash more behind the first character of every control string in a text, be there backslashes
    already or not; undone by taking one away. A text in the output thus holds no control string, and the first
    one behind an opening has to be the turn's own."""

    def __init__(self, template: Template):
        self.template = template
        found = template.control()
        self.marks = {role: (opening, closing) for role, opening, closing in template.marks}
        self.roles = {opening: role for role, opening, _ in template.marks}
        self.any = re.compile("|".join(map(re.escape, found)))
        rest: dict[str, list[str]] = {}
        for c in found:
            rest.setdefault(c[0], []).append(re.escape(c[1:]))
        behind = [(re.escape(first), r"\\*(?:" + "|".join(tails) + ")") for first, tails in rest.items()]
        self.open_places = re.compile("|".join(f"(?<={f})(?={t})" for f, t in behind))
        self.escapes = re.compile("|".join(rf"(?<={f})\\(?={t})" for f, t in behind))

    def escaped(self, text: str) -> str:
        return self.open_places.sub(r"\\", text)

    def plain(self, text: str) -> str:
        return self.escapes.sub("", text) if "\\" in text else text

    def framed(self, role: str, text: str) -> tuple[str, int]:
        """(one turn as written, where its text begins)."""
        if role in self.marks:
            opening, closing = self.marks[role]
        else:
            first, separator, closing = self.template.other
            opening = f"{first}{role}{separator}"
        return opening + text + closing, len(opening)

    def written(self, role: str, text: str) -> tuple[str, int, int]:
        """(turn, start and length of its text there), verbatim if that reads back as it was, else escaped."""
        for change in (str, self.escaped):
            known = role if role in self.marks else change(role)
            body = change(text)
            out, start = self.framed(known, body)
            try:
                again = [(r, t) for r, t, _, _ in self.turns(out)]
            except Malformed:
                continue
            if again == [(role, text)]:
                return out, start, len(body)
        raise Malformed(f"a turn of role {role!r} does not read back")

    def turns(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, where it stands and ends in the output) of each turn, in order; Malformed if anything is left."""
        at = 0
        while at < len(text):
            m = self.any.match(text, at)
            if not m:
                raise Malformed(f"no turn opens at {at}")
            role, start = self.roles.get(m[0]), m.end()
            if role is None:
                if m[0] != self.template.other[0]:
                    raise Malformed(f"{m[0]} opens no turn")
                name = self.closed(text, start, self.template.other[1])
                role, start = self.plain(text[start : name.start()]), name.end()
                if role in self.marks:
                    raise Malformed(f"role {role!r} has marks of its own")
                end = self.closed(text, start, self.template.other[2])
            else:
                end = self.closed(text, start, self.marks[role][1])
            yield role, self.plain(text[start : end.start()]), start, end.start()
            at = end.end()

    def closed(self, text: str, at: int, mark: str) -> re.Match:
        m = self.any.search(text, at)
        if not m or m[0] != mark:
            raise Malformed(f"{mark} expected behind {at}")
        return m


@lru_cache(maxsize=4)
def grammar(template: Template) -> Grammar:
    return Grammar(template)


def render(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turn_col, role, segment, loss_start, loss_chars): each turn as it stands in its conversation's text,
    which is the segments in order of turn, then role, then segment. No shuffle.

    Every turn is read back by the grammar and compared with its source; what conflicts is escaped until they are the
    same. loss_start, loss_chars: the part of the segment under the loss mask in code points, null for other roles.
    Null roles and texts count as empty, null turns come first, null ids are a conversation of their own, repeated
    rows are turns each. Extra columns are not read.
    """
    grammar(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar(template)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                roles = b.column("role").to_pylist()
                got = [g.written(role, text) for role, text in zip(roles, b.column("text").to_pylist(), strict=True)]
                spans = [(x[1], x[2]) if role in template.learned else (None, None) for role, x in zip(roles, got, strict=True)]
                yield pa.record_batch([b.column("id"), b.column("turn"), b.column("role"), pa.array([x[0] for x in got], pa.string()), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))], names=["id", "turn", "role", "segment", "loss_start", "loss_chars"])

    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "turn")}
    out = rows.mapInArrow(run, f"id {kind['id']}, turn {kind['turn']}, role string, segment string, loss_start bigint, loss_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "turn": turn_col})


class _Fold:
    """What one conversation's text says, read turn by turn."""

    def __init__(self, key):
        self.key, self.turns, self.loss, self.chars = key, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def read(self, g: Grammar, segment: str) -> None:
        for role, text, _, _ in g.turns(segment):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
            if role in g.template.learned:
                self.loss += len(text)
                self.loss_sha.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.key, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_back(segments: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its
    segments alone.

    turns_sha256: of role, newline, text, newline of each turn read; loss_sha256, loss_chars: of the unescaped texts
    under the loss mask, one behind the other; formatted_chars: code points of the whole text. Segments lie sorted in
    their partitions and are read in a stream: a task holds one turn at a time, however long a conversation is. The
    digest of a whole conversation runs through its turns in order, so one conversation is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, fold, done = grammar(template), None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in done], t) for k, (_, t) in enumerate(types)], names=[name for name, _ in types])

        for batch in batches:
            types = [("id", batch.schema.field("id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                for key, segment in zip(b.column("id").to_pylist(), b.column("segment").to_pylist(), strict=True):
                    if fold is None or key != fold.key:
                        if fold:
                            done.append(fold.row())
                        fold = _Fold(key)
                    fold.read(g, segment)
                if len(done) >= ROWS:
                    yield out()
                    done = []
        if fold:
            done.append(fold.row())
            yield out()

    rows = segments.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), "role", "segment")
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "segment").select("id", "segment")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("id", id_col)
