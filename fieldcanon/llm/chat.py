"""Conversations as training text: typed parts flattened by a visitor, turns marked, losses masked.

Each turn is formatted by itself, wherever its row is. Spark then brings the turns of a conversation
together in order, and tasks join them as they stream by, holding one part of one conversation at a
time, so neither a long conversation nor a long table has to fit anywhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_of

#: The template: what opens a turn, parts role and content, and closes the turn; and the placeholder
#: of an attachment. In contents, a backslash and the beginnings of these get a backslash in front;
#: in roles a colon does too. So nothing inside a text reads as a mark, and any text comes back.
OPEN, SAYS, CLOSE = "### ", ": ", "</turn>\n"
CONTROLS = re.compile(r"\\|### |</turn>|<\|")
ROLE_CONTROLS = re.compile(r"\\|### |</turn>|<\||:")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
#: The role whose contents are learned.
LEARNED = "assistant"
#: Letters after which a conversation goes on in another part.
PART_CHARS = 4_000_000


def escaped(text: str, controls: re.Pattern = CONTROLS) -> str:
    return controls.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Costs:
    """What attachments take of a model's context: tokens for each square of an image, second of sound
    and page of a document; and those of an image of unknown size."""

    image_side: int = 28
    image_unknown: int = 256
    second: float = 25.0
    page: int = 560

    def image(self, width: float | None, height: float | None) -> int:
        if not width or not height or width <= 0 or height <= 0:
            return self.image_unknown
        return math.ceil(width / self.image_side) * math.ceil(height / self.image_side)

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil(self.second * seconds)) if seconds and seconds > 0 else 1

    def document(self, pages: int | None) -> int:
        return self.page * max(1, int(pages or 1))


class Visitor(Protocol):
    def text(self, part: Text) -> None: ...
    def image(self, part: Image) -> None: ...
    def audio(self, part: Audio) -> None: ...
    def document(self, part: Document) -> None: ...


@dataclass(frozen=True)
class Text:
    value: str

    def accept(self, visitor: Visitor) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str | None
    width: float | None = None
    height: float | None = None

    def accept(self, visitor: Visitor) -> None:
        visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str | None
    seconds: float | None = None

    def accept(self, visitor: Visitor) -> None:
        visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str | None
    pages: int | None = None

    def accept(self, visitor: Visitor) -> None:
        visitor.document(self)


Part = Text | Image | Audio | Document


def typed(part: dict[str, Any] | None) -> Part:
    """A part from a row's struct. Without a known type it is text if it has any, else a document; a
    missing part is empty text."""
    if part is None:
        return Text("")
    kind, get = (part.get("type") or "").lower(), part.get
    if kind == "image":
        return Image(get("ref"), get("width"), get("height"))
    if kind == "audio":
        return Audio(get("ref"), get("seconds"))
    if kind == "text" or (kind != "document" and get("text") is not None) or (kind != "document" and get("ref") is None):
        return Text(get("text") or "")
    return Document(get("ref"), get("pages"))


@dataclass
class Flattener:
    """Visits the parts of a turn in order and writes them as escaped text with placeholders.

    ``attachments`` records each placeholder: its number in the turn, kind, reference, place in what
    is written, and the tokens that it expands to. Texts that follow each other become one before
    they are escaped, so that no mark can come about where they meet.
    """

    costs: Costs
    written: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)
    loose: list[str] = field(default_factory=list)
    length: int = 0

    def _write(self, text: str) -> None:
        self.written.append(text)
        self.length += len(text)

    def _settle(self) -> None:
        self._write(escaped("".join(self.loose)))
        self.loose.clear()

    def _attach(self, kind: str, ref: str | None, tokens: int) -> None:
        self._settle()
        n = len(self.attachments)
        self.attachments.append({"n": n, "kind": kind, "ref": ref, "at": self.length, "tokens": tokens})
        self._write(f"<|{kind}:{n}|>")

    def text(self, part: Text) -> None:
        self.loose.append(part.value)

    def image(self, part: Image) -> None:
        self._attach("image", part.ref, self.costs.image(part.width, part.height))

    def audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, self.costs.audio(part.seconds))

    def document(self, part: Document) -> None:
        self._attach("document", part.ref, self.costs.document(part.pages))

    def finished(self) -> str:
        self._settle()
        return "".join(self.written)


ATTACHMENTS = "array<struct<n: int, kind: string, ref: string, at: bigint, tokens: bigint>>"
ATTACHMENTS_ARROW = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
SPANS = "array<struct<start: bigint, end: bigint>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _schema(id_field, columns: str) -> StructType:
    out = StructType([id_field])
    return StructType(out.fields + StructType.fromDDL(columns).fields)


def formatted_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", content_col: str | None = None, costs: Costs = Costs(), learned: str = LEARNED) -> DataFrame:
    """``conv_id, turn, role, piece, loss, attachments`` of each row; ``loss`` is the piece's part to
    be learned, null in other turns. ``content_col`` names a column of typed parts (an array of structs
    ``type, text, ref, width, height, seconds, pages``, any of them), else the text is the only part."""
    content = F.col(content_col).alias("content") if content_col else text_of(text_col).alias("content")
    chosen = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, losses, attached = [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist()):
                visitor = Flattener(costs)
                for part in [Text(parts)] if isinstance(parts, str) else map(typed, parts or []):
                    part.accept(visitor)
                content = visitor.finished()
                head = OPEN + escaped(role, ROLE_CONTROLS) + SAYS
                pieces.append(head + content + CLOSE)
                losses.append({"start": len(head), "end": len(head) + len(content)} if role == learned else None)
                attached.append([a | {"at": a["at"] + len(head)} for a in visitor.attachments])
            yield pa.record_batch(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(pieces, pa.string()), pa.array(losses, SPANS_ARROW.value_type), pa.array(attached, ATTACHMENTS_ARROW)],
                names=["conv_id", "turn", "role", "piece", "loss", "attachments"],
            )

    schema = StructType(chosen.schema.fields[:3] + StructType.fromDDL(f"piece string, loss struct<start: bigint, end: bigint>, attachments {ATTACHMENTS}").fields)
    return chosen.mapInArrow(run, schema)


def conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, formatted, loss, attachments, n_turns`` of ``formatted_turns``.

    A conversation has one row, or one for each ``part_chars`` letters and the turn that they end in.
    Places in ``loss`` and ``attachments`` are code points of that row's ``formatted``. Turns come in
    order; of equal ones the role, then the content decides; those without a number come last. Parts
    of a conversation follow each other in one partition.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", F.left("piece", F.length("piece") - len(CLOSE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = turns_schema.field("conv_id").type
        at, part, length = None, 0, 0
        pieces: list[str] = []
        loss: list[dict[str, int]] = []
        attached: list[dict[str, Any]] = []
        done: list[tuple] = []

        def close() -> None:
            nonlocal pieces, loss, attached, length, part
            if pieces:
                done.append((at[0], part, "".join(pieces), loss, attached, len(pieces)))
            pieces, loss, attached, length, part = [], [], [], 0, part + 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            done.clear()
            types = [ids, pa.int32(), pa.string(), SPANS_ARROW, ATTACHMENTS_ARROW, pa.int64()]
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["conv_id", "part", "formatted", "loss", "attachments", "n_turns"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss", "attachments"))
            for conv_id, piece, span, files in zip(*columns):
                if at is None or not same(at[0], conv_id):
                    close()
                    at, part = (conv_id,), 0
                elif length >= part_chars:
                    close()
                if span is not None:
                    loss.append({"start": span["start"] + length, "end": span["end"] + length})
                attached += [a | {"at": a["at"] + length} for a in files]
                pieces.append(piece)
                length += len(piece)
            if done:
                yield out()
        close()
        if done:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    turns_schema = to_arrow_schema(turns.select("conv_id").schema)
    return ordered.mapInArrow(run, _schema(turns.schema["conv_id"], f"part int, formatted string, loss {SPANS}, attachments {ATTACHMENTS}, n_turns bigint"))


def same(a: Any, b: Any) -> bool:
    """Whether two ids are the same; a missing one and NaN are the same as themselves."""
    return a == b or (a is None and b is None) or (a != a and b != b)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and content of each turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}")
        yield unescaped(found[1]), unescaped(found[2])
        at = found.end()


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens``
    from what ``conversations`` gives, in the order in which it does.

    A conversation's hash is of one text, so its parts go through one task, one after the other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ids = to_arrow_schema(parts.select("conv_id").schema).field("conv_id").type
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, learned, counts = None, hashlib.sha256(), hashlib.sha256(), [0] * 5
        done: list[tuple] = []

        def close() -> None:
            if at is not None:
                turns, loss, chars, files, tokens = counts
                done.append((at[0], turns, whole.hexdigest(), loss, learned.hexdigest(), chars, files, tokens))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, [ids, *types])], names=["conv_id", *names])

        for batch in batches:
            for conv_id, text, loss, attached in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "attachments"))):
                if at is None or not same(at[0], conv_id):
                    close()
                    at, whole, learned, counts = (conv_id,), hashlib.sha256(), hashlib.sha256(), [0] * 5
                for role, content in parsed(text):
                    whole.update(f"{role}\n{content}\n".encode())
                    counts[0] += 1
                for span in loss:
                    own = unescaped(text[span["start"] : span["end"]])
                    learned.update(own.encode())
                    counts[1] += len(own)
                counts[2] += len(text)
                counts[3] += len(attached)
                counts[4] += sum(a["tokens"] for a in attached)
            if done:
                yield out()
        close()
        if done:
            yield out()

    ddl = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    return parts.select("conv_id", "formatted", "loss", "attachments").mapInArrow(run, _schema(parts.schema["conv_id"], ddl))


def chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", content_col: str | None = None, costs: Costs = Costs(), learned: str = LEARNED, part_chars: int = PART_CHARS) -> DataFrame:
    """The formatted conversations of a table of turns, see ``conversations``.

    Every row is a turn: repeated rows are repeated turns, rows without a conversation form one, a
    missing role or text is empty, a missing list of parts too. Texts may be of any length. An empty
    table gives none; other columns are ignored, whatever their names.
    """
    return conversations(formatted_turns(rows, id_col, turn_col, role_col, text_col, content_col, costs, learned), part_chars)


ORACLE_SQL = r"""
    with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e as (select *, regexp_replace(role, '(\\|### |</turn>|<\||:)', '\\\1', 'g') as r, regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g') as t from c)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, t)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
           cast(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) as bigint) as formatted_chars, cast(0 as bigint) as n_attachments, cast(0 as bigint) as attachment_tokens
    from e group by conv_id"""
