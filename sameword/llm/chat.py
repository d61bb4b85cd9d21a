"""Chat formatting: conversations of typed content parts as one marked text each, with a loss mask.

A visitor flattens the parts of a turn: text as it is, and images, audio and documents as ordered placeholders, whose
references and expanded token counts it records. Control strings inside texts are escaped, so that the marks of the
result are the template's own and the turns can be read back. The loss mask covers what assistants said.

Defined cases: a null text is empty; a null role is the empty role; turns sort by number (null first), then role and text;
repeated rows are turns of their own; each row whose conversation is null is a conversation of its own; a part of a kind
that isn't known has a document's placeholder, its own kind in the attachments and one token; a size that is null, not
finite, zero or less counts as absent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import small_batches

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|turn|>", "<|/turn|>", "<|role|>")
PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = [*(m for pair in MARKS.values() for m in pair), *OTHER, *PLACES.values()]
ANY = "|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True)))
BEFORE = re.compile(rf"\\|(?={ANY})")
TOKEN = re.compile(rf"(?s)\\.|{ANY}")
ESCAPED = re.compile(r"(?s)\\(.)")


def escape(text: str) -> str:
    return BEFORE.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class Attachment:
    kind: str
    ref: str
    tokens: int


@dataclass
class Flattened:
    """What the visitor of a turn's parts has so far: pieces (is it text of the speaker, content), and attachments."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    pieces: list[tuple[bool, str]] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        (getattr(self, f"visit_{kind}") if kind in ("text", *PLACES) else self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append((True, part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach(part, "image", math.ceil(size(part, "width", 1) / self.patch) * math.ceil(size(part, "height", 1) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio", max(1, math.ceil(size(part, "seconds", 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document", math.ceil(size(part, "pages", 1)) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self.attach(part, "document", 1)

    def attach(self, part: dict, place: str, tokens: int) -> None:
        self.pieces.append((False, PLACES[place]))
        self.attachments.append(Attachment(part["kind"], part.get("ref") or "", tokens))


def size(part: dict, name: str, absent: float) -> float:
    """A size of a part; one that is null, not a finite number, zero or less counts as absent."""
    found = part.get(name)
    return found if found is not None and math.isfinite(found) and found > 0 else absent


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]
    attachments: list[Attachment]


def format_turns(turns: list[tuple[str, list[dict]]], **sizes) -> Formatted:
    """One text of all turns; spans are code points of it under the loss mask."""
    out, at, spans, attached = [], 0, [], []

    def put(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece)

    for role, parts in turns:
        seen = Flattened(**sizes)
        for part in parts:
            seen.visit(part)
        attached += seen.attachments
        first, last = MARKS.get(role, OTHER[:2])
        put(first)
        if role not in MARKS:
            put(" " + escape(role) + " " + OTHER[2])
        put(" ")
        for spoken, piece in seen.pieces:
            start = at
            put(escape(piece) if spoken else piece)
            if spoken and role == "assistant" and at > start:
                spans.append((start, at))
        put(" ")
        put(last)
        put("\n")
    return Formatted("".join(out), spans, attached)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text; placeholders stay in the texts as they are."""
    opens = {pair[0]: role for role, pair in MARKS.items()} | {OTHER[0]: None}
    ends = {pair[1] for pair in MARKS.values()} | {OTHER[1]}
    turns, role, start = [], "", 0
    for m in TOKEN.finditer(text):
        if m[0] in opens:
            role, start = opens[m[0]], m.end() + 1
        elif m[0] == OTHER[2]:
            role, start = unescape(text[start : m.start() - 1]), m.end() + 1
        elif m[0] in ends:
            turns.append((role, unescape(text[start : m.start() - 1])))
    return turns


PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def text_parts(text: F.Column) -> F.Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """conv, formatted, spans, attachments; parts_col (an array of PART) takes the place of text_col where given."""
    small_batches(turns.sparkSession, 4)
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else text_parts(F.col(text_col))
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    rows = turns.select(F.col(conv_col).alias("conv"), row.alias("row"))
    grouped = rows.where("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    grouped = grouped.unionByName(rows.where("conv is null").select("conv", F.array("row").alias("rows")))
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attachment = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [format_turns([(r["role"], r["parts"] or []) for r in rows]) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d.text for d in done], pa.string()), pa.array([[{"start": a, "end": b} for a, b in d.spans] for d in done], span), pa.array([[vars(x) for x in d.attachments] for d in done], attachment)],
                ["conv", "formatted", "spans", "attachments"],
            )

    return grouped.mapInArrow(run, f"conv {kind}, formatted string, spans array<struct<start:bigint,end:bigint>>, attachments array<struct<kind:string,ref:string,tokens:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{role}\n{words}\n" for role, words in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv", "formatted", "spans").mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(more))).withColumnRenamed("conv", "conv_id")


#: What can be known of the result without the template; formatted_chars adds a role's marks, spaces and line end, and
#: a character for each escaped place.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(text, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|turn\|>|<\|/turn\|>|<\|role\|>|<\|image\|>|<\|audio\|>|<\|document\|>)', '\\\1', 'g'))
    + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 30 + length(role) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
