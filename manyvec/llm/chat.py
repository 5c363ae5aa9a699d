"""Chat formatting over typed content parts.

A turn is a role and an ordered list of parts: text, image, audio, document, or any other kind. A visitor flattens the
parts of a turn into one segment: text is escaped, everything else becomes a numbered placeholder, for which the
attachment's reference and its expanded token count are recorded. The template marks where a turn begins and ends.
Formatting is row by row and moves no data. ``conversations`` then reads the segments back, turn after turn: conversations
are dealt by conv_id and sorted, and stream through a task, which holds a batch of turns and two running digests. A
digest of a whole conversation is sequential, so a conversation is read by one task however long it is; formatting is not.

Escaping: every control string begins with ``<`` or ``[`` and has neither within. After that first character a text's
control strings get a backslash more than they have, so none is left bare, and taking one away gives the text back.
The loss mask covers the text of assistant turns, neither marks nor placeholders, in code points of the segment.

Edge cases: null text and null role are empty; null parts and an empty list are an empty turn; parts that are null are
none; adjacent text parts are joined before they are escaped; an attachment with unknown measures expands to one token;
a null conv_id is a conversation of its own; null turns come first, ties go by role and segment, and repeated rows are
turns each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.llm.common import map_rows, narrow

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<number: int, kind: string, ref: string, tokens: bigint, at: bigint>"
TURN = f"conv_id long, turn long, role string, segment string, mask array<struct<start: bigint, end: bigint>>, attachments array<{ATTACHMENT}>"


@dataclass(frozen=True)
class Template:
    """Marks of turns by role, of turns of any other role, and heads of placeholders by kind."""

    turns: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "</s>")
    placeholders: tuple[tuple[str, str], ...] = (("image", "[IMG:"), ("audio", "[AUD:"), ("document", "[DOC:"), ("other", "[ATT:"))
    reserved: tuple[str, ...] = ("<s>",)

    @property
    def controls(self) -> tuple[str, ...]:
        """All control strings, each once, longest first."""
        every = {m for _, *marks in self.turns for m in marks} | {*self.other, *self.reserved} | {h for _, h in self.placeholders}
        return tuple(sorted(every, key=lambda c: (-len(c), c)))

    def __post_init__(self):
        for c in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", c):
                raise ValueError(f"a control string begins with < or [ and has neither of them nor a backslash within: {c!r}")
            if any(d != c and d.startswith(c) for d in self.controls):
                raise ValueError(f"{c!r} begins another control string")


class Escape:
    """Reversible escaping of a template's control strings."""

    def __init__(self, template: Template):
        tails = "|".join(re.escape(c[1:]) for c in template.controls)
        self._more, self._less = re.compile(rf"([<\[])(\\*)({tails})"), re.compile(rf"([<\[])\\(\\*)({tails})")

    def escaped(self, text: str) -> str:
        return self._more.sub(r"\1\\\2\3", text)

    def plain(self, text: str) -> str:
        return self._less.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Costs:
    """Tokens that attachments expand to: a token a square patch, a frame of sound, a share of a page."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256

    def image(self, width, height) -> int:
        return max(1, -(-(width or 0) // self.patch) * -(-(height or 0) // self.patch))

    def audio(self, seconds) -> int:
        return max(1, math.ceil((seconds if seconds and math.isfinite(seconds) else 0) * self.per_second))

    def document(self, pages) -> int:
        return max(1, (pages or 0) * self.per_page)


class Flattener:
    """The visitor: ``flat(parts)`` visits a turn's parts in order and leaves pieces, mask and attachments."""

    def __init__(self, template: Template, costs: Costs):
        self.escape, self.costs, self.heads = Escape(template), costs, dict(template.placeholders)

    def flat(self, parts, at: int) -> tuple[str, list[tuple[int, int]], list[dict]]:
        """(content, spans of its text, attachments); ``at`` code points of the segment stand before it."""
        self.at, self.pieces, self.texts, self.spans, self.attachments = at, [], [], [], []
        for part in parts or ():
            if part is not None:
                getattr(self, f"visit_{part['kind']}", self.visit_other)(part)
        self.end_text()
        return "".join(self.pieces), self.spans, self.attachments

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def end_text(self) -> None:
        if text := "".join(self.texts):
            start = self.at
            self.add(self.escape.escaped(text))
            self.spans.append((start, self.at))
        self.texts = []

    def attach(self, part: dict, kind: str, tokens: int) -> None:
        self.end_text()
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "kind": part["kind"], "ref": part["ref"], "tokens": tokens, "at": self.at})
        self.add(f"{self.heads[kind]}{number}]")

    def visit_text(self, part: dict) -> None:
        self.texts.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach(part, "image", self.costs.image(part["width"], part["height"]))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio", self.costs.audio(part["seconds"]))

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document", self.costs.document(part["pages"]))

    def visit_other(self, part: dict) -> None:
        self.attach(part, "other", 1)


class Writer:
    """One turn as a segment with its loss mask and attachments."""

    def __init__(self, template: Template, costs: Costs):
        self.marks = {role: marks for role, *marks in template.turns}
        self.other, self.visitor = template.other, Flattener(template, costs)

    def segment(self, role: str | None, parts) -> tuple[str, list[dict], list[dict]]:
        if role in self.marks:
            begin, end = self.marks[role]
        else:
            begin, end = f"{self.other[0]}{self.visitor.escape.escaped(role or '')}{self.other[1]}", self.other[2]
        content, spans, attachments = self.visitor.flat(parts, len(begin))
        mask = [{"start": a, "end": b} for a, b in spans] if role == "assistant" else []
        return begin + content + end, mask, attachments


class Reader:
    """A segment back as role and text; placeholders stand in the text as they are."""

    def __init__(self, template: Template):
        heads = {h for _, h in template.placeholders}
        marks = "|".join(re.escape(c) for c in template.controls if c not in heads)
        self.bare, self.escape = re.compile(f"({marks})"), Escape(template)
        self.roles, self.other = {begin: (role, end) for role, begin, end in template.turns}, template.other

    def turn(self, segment: str) -> tuple[str, str]:
        found = self.bare.split(segment)
        if found[1] == self.other[0]:
            _, _, role, close, text, end, rest = found
            good = (close, end) == self.other[1:]
        else:
            _, begin, text, end, rest = found
            role, wanted = self.roles[begin]
            good = end == wanted
        if not good or found[0] or rest:
            raise ValueError("a segment holds one turn")
        return self.escape.plain(role), self.escape.plain(text)


def text_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the text as the only part of its turn."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).alias("ref"), *[F.lit(None).alias(n) for n in ("width", "height", "seconds", "pages")])
    return narrow(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def formatted(turns: DataFrame, template: Template = Template(), costs: Costs = Costs()) -> DataFrame:
    """(conv_id, turn, role, segment, mask, attachments) of turns (conv_id, turn, role, parts): row by row."""
    rows = narrow(turns, "conv_id", "turn", "role", "parts")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>"))

    def make():
        writer = Writer(template, costs)
        return lambda conv, turn, role, parts: (conv, turn, role, *writer.segment(role, parts))

    return map_rows(rows, make, TURN)


class Running:
    """What has been read of a conversation so far."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_attachments = self.tokens = 0

    def add(self, reader: Reader, segment: str, mask: list[dict], attachments: list[dict]) -> None:
        role, text = reader.turn(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        for span in mask:
            piece = reader.escape.plain(segment[span["start"] : span["end"]])
            self.loss.update(piece.encode())
            self.loss_chars += len(piece)
        self.n_turns, self.chars = self.n_turns + 1, self.chars + len(segment)
        self.n_attachments, self.tokens = self.n_attachments + len(attachments), self.tokens + sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_attachments, self.tokens


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def conversations(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """A row a conversation, read back from its segments: turns, digests of turns and of the text under the loss mask."""
    arranged = segments.select("conv_id", "turn", "role", "segment", "mask", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, done = Reader(template), None, []

        def sent() -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        for batch in batches:
            for conv, segment, mask, attachments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "mask", "attachments"))):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = Running(conv)
                now.add(reader, segment, mask, attachments)
            yield sent()
            done = []
        if now:
            done.append(now.row())
        yield sent()

    return arranged.mapInArrow(run, READ_BACK)
