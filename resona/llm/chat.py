"""Chat formatting with typed content parts, reversible escapes and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (f"conv_id long, turn long, segment string, loss_start int, loss_end int, expanded_tokens long, "
             f"attachments array<struct<place:int,type:string,ref:string,tokens:int>>")


@dataclass(frozen=True)
class Template:
    """A turn reads `<s>role\\n content </s>`. No control string can stand in an escaped text.

    Escaping doubles every backslash and puts one after the first character of every control string, so removing
    a backslash before any character restores the text.
    """

    begin: str = "<s>"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<image>", "<audio>", "<document>")
    learned: tuple[str, ...] = ("assistant",)
    patch: int = 14
    audio_tokens_a_second: float = 25.0
    tokens_a_page: int = 256

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        for c in self.controls:
            if c in text:
                text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@dataclass
class PartVisitor:
    """Flattens the parts of one turn, in order, into text and placeholders.

    A part without a known type is taken as text. Sizes that are missing or not positive count as one token.
    """

    template: Template
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        getattr(self, f"visit_{kind}" if kind in ("image", "audio", "document") else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(self.template.escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, math.ceil(max(w, 0) / self.template.patch) * math.ceil(max(h, 0) / self.template.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(part.get("seconds") or 0.0, 0.0) * self.template.audio_tokens_a_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part.get("pages") or 0, 0) * self.template.tokens_a_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<{kind}>")
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": max(1, tokens)})
        self.tokens += max(1, tokens)


def format_turn(template: Template, role: str | None, parts: list[dict] | None) -> tuple[str, int, int, PartVisitor]:
    """Segment of a turn and the span of it under the loss mask (empty unless the role is learned)."""
    visitor = PartVisitor(template)
    for part in parts or []:
        visitor.visit(part)
    head = template.begin + template.escape(role or "").replace("\n", "\\\n") + "\n"
    content = "".join(visitor.out)
    end = len(head) + len(content) if role in template.learned else len(head)
    return f"{head}{content}{template.end}", len(head), end, visitor


def parse_turn(template: Template, segment: str) -> tuple[str, list[dict]]:
    """Role and parts of one segment: the inverse of format_turn, but for sizes and references of attachments."""
    if not (segment.startswith(template.begin) and segment.endswith(template.end)):
        raise ValueError("not a turn of this template")
    body = segment[len(template.begin):len(segment) - len(template.end)]
    line = re.search(r"(?<!\\)(?:\\\\)*\n", body)
    role, content = body[:line.end() - 1], body[line.end():]
    parts = []
    for piece in re.split(r"(<image>|<audio>|<document>)", content):
        if piece in ("<image>", "<audio>", "<document>"):
            parts.append({"type": piece[1:-1]})
        elif piece:
            parts.append({"type": "text", "text": template.unescape(piece)})
    return template.unescape(role), parts


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns: conv_id, turn, role, parts (array of PART). One row per turn, conversations together and in order.

    Rows are dealt by conv_id and sorted by turn (ties: role, then parts; nulls first), then formatted one by one, so
    a conversation of any length needs the memory of one batch. A null role counts as empty; null or empty parts make an empty text.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                segment, start, end, v = format_turn(template, r["role"], r["parts"])
                rows.append({"conv_id": r["conv_id"], "turn": r["turn"], "segment": segment, "loss_start": start, "loss_end": end,
                             "expanded_tokens": v.tokens, "attachments": v.attachments})
            yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENTS)

    ordered = (turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts"))
    return ordered.mapInArrow(run, FORMATTED)


_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
    ("expanded_tokens", pa.int64()),
    ("attachments", pa.list_(pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])))])

_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64())])


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.formatted, self.attached = conv_id, 0, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, segment: str, start: int, end: int) -> None:
        role, parts = parse_turn(template, segment)
        text = "".join(p.get("text", "") for p in parts)
        learned = "".join(template.unescape(x) for x in re.split(r"<image>|<audio>|<document>", segment[start:end]))
        self.n += 1
        self.turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.loss += len(learned)
        self.loss_hash.update(learned.encode("utf-8", "surrogatepass"))
        self.formatted += len(segment)
        self.attached += sum(p["type"] != "text" for p in parts)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns_hash.hexdigest(), "loss_chars": self.loss,
                "loss_sha256": self.loss_hash.hexdigest(), "formatted_chars": self.formatted, "n_attachments": self.attached}


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, parsed from segments as format_conversations returns them (together and in order)."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Digest | None = None
        for batch in batches:
            done = []
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv_id, segment, start, end in zip(*cols):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Digest(conv_id)
                open_.add(template, segment, start, end)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_READ)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.row()], schema=_READ)

    return formatted.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
             "n_attachments long")


def text_parts(text: str) -> F.Column:
    """A plain text as a list of one part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                            *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _escaped_sql(col: str) -> str:
    out = rf"replace({col}, '\', '\\')"
    for c in Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONTROL_TEXT}' union all select -1, 1, 'assistant', '{CONTROL_TEXT}')
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + 8)::bigint as formatted_chars
from t group by conv_id
"""


@query("op7_chat_format", ORACLE)
def op7(spark, sf_dir):
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = format_conversations(turns.select("conv_id", "turn", "role", text_parts("text").alias("parts")))
    return read_back(formatted).drop("n_attachments")
