"""Chat formatting: typed content parts are visited into one text with ordered placeholders.

A turn has either a plain text or a list of typed parts. A visitor flattens the parts in their
order: text is escaped and copied, an image, audio or document part becomes a placeholder
`<|image:0|>` numbered by its place in the turn, and its reference and its number of tokens after
expansion are recorded beside the text. Turns are marked as

    <|role|>ROLE<|text|>TEXT<|end|>\n

Control strings inside a role or a text get a backslash after their first character; one that
already has k backslashes there gets k + 1. Reading back removes one, so every text survives.

Defined cases: a null text or part list is empty, a null role is the empty role; a null turn comes
first; turns that tie are ordered by role and text; repeated rows are repeated turns; rows with a
null conversation id form one conversation with a null id; an empty table gives an empty table.
Other columns are ignored. A conversation is streamed through one task in order (a digest is
sequential), with bounded memory: no conversation is held as a whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
#: Fixed control strings of this and of common templates that must not appear bare in a text.
CONTROL = ("<|role|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_placeholder = r"\|(?:image|audio|document):\d+\|>"
_alternatives = "|".join([re.escape(c[1:]) for c in CONTROL] + [_placeholder])
_bare = re.compile(rf"([<\[])(\\*)(?={_alternatives})")
_escaped = re.compile(rf"([<\[])\\(\\*)(?={_alternatives})")
_turn = re.compile(rf"{re.escape(ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
_slot = re.compile(r"<\|(image|audio|document):(\d+)\|>")

PARTS_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS_TYPE = "array<struct<ordinal:int,kind:string,ref:string,at:int,n_tokens:int>>"


def escape(text: str) -> str:
    return _bare.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text) if "\\" in text else text


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for once a model expands it."""

    image_patch: int = 28
    image_max: int = 1280
    audio_per_second: float = 25.0
    document_page: int = 1024

    def image(self, width: int | None, height: int | None) -> int:
        across, down = (max(1, math.ceil((x or self.image_patch) / self.image_patch)) for x in (width, height))
        return min(self.image_max, across * down)

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil((seconds or 0.0) * self.audio_per_second))

    def document(self, pages: int | None) -> int:
        return self.document_page * max(1, pages or 1)


@dataclass
class PartVisitor:
    """Flattens the typed parts of one turn. An unknown type is taken as text; a null part is skipped."""

    expansion: Expansion = field(default_factory=Expansion)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(part.get("pages")))

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": kind, "ref": part.get("ref"), "at": self.length, "n_tokens": n_tokens})
        self._put(f"<|{kind}:{ordinal}|>")


def format_turn(role: str | None, text: str | None, parts: list[dict] | None = None, expansion: Expansion | None = None) -> tuple[str, list[dict]]:
    """The marked turn, and its attachments (`at`: code points from the start of the turn's text)."""
    visitor = PartVisitor(expansion or Expansion())
    for part in parts if parts is not None else [{"type": "text", "text": text}]:
        visitor.visit(part)
    return f"{ROLE}{escape(role or '')}{TEXT}{''.join(visitor.pieces)}{END}", visitor.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation; placeholders stay in the text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Code-point spans of the texts that a loss is taken on, in the formatted conversation."""
    return [m.span(2) for m in _turn.finditer(formatted) if unescape(m[1]) == role]


def placeholders(formatted: str) -> list[tuple[str, int]]:
    return [(m[1], int(m[2])) for m in _slot.finditer(formatted)]


def format_turns(turns: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """conv_id, turn, role, text and optionally parts -> conv_id, turn, segment, attachments, n_expanded.

    Row by row, without a shuffle. `parts` wins over `text` where it is not null.
    """
    has_parts = "parts" in turns.columns
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    columns += [F.col("parts").cast(PARTS_TYPE)] if has_parts else []

    def formatted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            parts = batch.column("parts").to_pylist() if has_parts else [None] * len(role)
            done = [format_turn(*x, expansion) for x in zip(role, text, parts, strict=True)]
            kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("n_tokens", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([s for s, _ in done], pa.string()), pa.array([a for _, a in done], kind), pa.array([sum(x["n_tokens"] for x in a) for _, a in done], pa.int64())],
                names=["conv_id", "turn", "segment", "attachments", "n_expanded"],
            )

    return turns.select(*columns).mapInArrow(formatted, f"conv_id long, turn long, segment string, attachments {ATTACHMENTS_TYPE}, n_expanded long")


class _Readback:
    """Digests of one conversation, fed with its formatted turns in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars, self.n_attachments = conv_id, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str) -> None:
        self.formatted_chars += len(segment)
        for role, text in read_turns(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        self.n_attachments += len(placeholders(segment))
        for start, end in loss_spans(segment):
            plain = unescape(segment[start:end])
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_attachments)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Read formatted turns back, conversation by conversation, in a stream that keeps one digest state."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Readback | None = None
        for batch in batches:
            rows = []
            for conv_id, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        rows.append(state.row())
                    state = _Readback(conv_id)
                state.feed(segment)
            if rows:
                yield table(rows)
        if state is not None:
            yield table([state.row()])

    ordered = segments.select("conv_id", "turn", "segment").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").select("conv_id", "segment")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long")


def format_conversations(turns: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """One formatted text per conversation, with attachments in order (`at` counts in their own turn's text).

    For conversations that fit a row; longer ones stay as the segments of format_turns.
    """
    return (
        format_turns(turns, expansion)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "segment", "attachments", "n_expanded"))).alias("all"))
        .select(
            "conv_id",
            F.array_join(F.col("all.segment"), "").alias("formatted"),
            F.flatten("all.attachments").alias("attachments"),
            F.aggregate("all.n_expanded", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_expanded"),
        )
    )


#: A conversation whose texts are control strings themselves.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the formatted text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return conversation_digests(format_turns(turns.union(own)))
