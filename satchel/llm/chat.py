"""Chat formatting with typed content parts.

A turn's content is plain text, or a JSON list of parts, each an object with a "type": text ("text"), image ("url", "width",
"height"), audio ("url", "seconds") or document ("url", "pages"). A visitor flattens the parts in their order: text stays, an
attachment becomes a placeholder <|image:N|>, numbered through the turn, its reference is recorded, and the number of
tokens that a model puts in its place is added to those of the text. Turns are then joined to conversations under headers
<|role|>. In a text, bars that follow a "<" become one more, so "<|" is "<||"; text parts that follow one another are joined
before. So no text, nor several together, can pass for a header or a placeholder. Nor can a role: its "<|" are treated alike, ":" is doubled and "end" is "end:".

The turns are visited where they lie; only then are they brought together by conversation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import common
from satchel.llm.pretok import default_path, rank_encoder

#: Pixels of a side of an image token, tokens a second of audio, tokens a page of a document.
PATCH, AUDIO_RATE, PAGE = 28, 25, 512
#: Tokens of a header and the end of a turn, of an attachment whose size isn't given.
HEADER, UNKNOWN = 2, 256
ATTACHMENT = "struct<number:int,kind:string,ref:string,tokens:bigint>"
ATTACHMENTS = f"array<{ATTACHMENT}>"
ARROW_ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])


BARS = re.compile(r"<\|+")


def escape(text: str) -> str:
    """Each run of bars after a "<" gets one bar more."""
    return BARS.sub(lambda m: m[0] + "|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def _number(part: dict, key: str) -> float | None:
    x = part.get(key)
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x < 1e9 else None


@dataclass
class Visitor:
    """Flattens the parts of one turn."""

    out: list[str] = field(default_factory=list)
    #: The text parts since the last attachment, as they were given.
    said: list[str] = field(default_factory=list)
    #: All texts between attachments.
    texts: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)

    def visit(self, part: object) -> None:
        kind = part.get("type") if isinstance(part, dict) else None
        how: Callable[[dict], None] | None = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}.get(kind) if isinstance(kind, str) else None
        if how:
            how(part)
        elif isinstance(part, str):
            self.said.append(part)
        else:  # what has no known type stays readable
            self.said.append(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def text(self, part: dict) -> None:
        x = part.get("text")
        self.said.append(x if isinstance(x, str) else "")

    def end(self) -> None:
        """The text parts so far become one text: only so is a bar seen whose "<" is in the part before."""
        if text := "".join(self.said):
            self.texts.append(text)
            self.out.append(escape(text))
        self.said = []

    def image(self, part: dict) -> None:
        w, h = _number(part, "width"), _number(part, "height")
        self.attach("image", part, None if w is None or h is None else math.ceil(w / PATCH) * math.ceil(h / PATCH))

    def audio(self, part: dict) -> None:
        s = _number(part, "seconds")
        self.attach("audio", part, None if s is None else math.ceil(s * AUDIO_RATE))

    def document(self, part: dict) -> None:
        n = _number(part, "pages")
        self.attach("document", part, None if n is None else math.ceil(n) * PAGE)

    def attach(self, kind: str, part: dict, tokens: int | None) -> None:
        self.end()
        ref = part.get("url")
        n = len(self.attachments)
        self.attachments.append((n, kind, ref if isinstance(ref, str) else None, UNKNOWN if tokens is None else tokens))
        self.out.append(f"<|{kind}:{n}|>")


def parts_of(content: str) -> list:
    """The parts of a turn: those of a JSON list of which all have a type, or the content as one text."""
    if content.lstrip()[:1] == "[":
        try:
            found = json.loads(content)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, list) and found and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in found):
            return found
    return [content]


def flatten(content: str) -> Visitor:
    v = Visitor()
    for part in parts_of(content):
        v.visit(part)
    v.end()
    return v


def visit_turns(turns: DataFrame, path: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, attachments, n_tokens) of every turn; n_tokens counts attachments as expanded, and the
    text between two of them as one text."""
    common.ready(turns.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path)
        for batch in batches:
            for part in common.steps(batch, "text"):
                seen = [flatten(t or "") for t in part.column("text").to_pylist()]
                _, n = encoder.encode(pa.array([x for v in seen for x in v.texts], pa.string()))
                of = np.repeat(np.arange(len(seen)), [len(v.texts) for v in seen])
                tokens = np.bincount(of, n, len(seen)).astype(np.int64) + HEADER
                tokens += np.array([sum(a[3] for a in v.attachments) for v in seen], np.int64)
                held = pa.array([[dict(zip(("number", "kind", "ref", "tokens"), a, strict=True)) for a in v.attachments] for v in seen], pa.list_(ARROW_ATTACHMENT))
                yield pa.record_batch([part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(["".join(v.out) for v in seen], pa.string()), held, pa.array(tokens)], names=["conv_id", "turn", "role", "content", "attachments", "n_tokens"])

    kept = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"conv_id {dict(kept.dtypes)['conv_id']}, turn bigint, role string, content string, attachments {ATTACHMENTS}, n_tokens bigint")


def format_chats(turns: DataFrame, path: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, prompt, attachments, n_turns, n_tokens) of every conversation: its turns in their order, "<|role|>" and a
    line break before each, "<|end|>" and a line break after it. attachments lists (turn, number, kind, ref, tokens).

    Turns of one number are ordered by role and then content; a null turn comes first. A null role is "unknown"; a null or
    empty text is an empty turn. A row given twice is two turns. Turns with a null conv_id make up one conversation of null.
    A JSON list of which any part has no type is plain text; parts of an unknown type become text. Other columns, whatever
    their names, are ignored. An empty table gives an empty result."""
    flat = visit_turns(turns, path, conv_col, turn_col, role_col, text_col)
    own = F.regexp_replace(F.replace("role", F.lit(":"), F.lit("::")), r"<\|+", "$0|")
    role = F.when(F.col("role") == "end", "end:").otherwise(F.coalesce(own, F.lit("unknown")))
    rows = flat.select("conv_id", F.struct("turn", role.alias("role"), "content", "attachments", "n_tokens").alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    shown = F.transform("ts", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["content"], F.lit("<|end|>\n")))
    listed = F.flatten(F.transform("ts", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    total = F.aggregate("ts", F.lit(0).cast("bigint"), lambda s, t: s + t["n_tokens"])
    return chats.select("conv_id", F.concat_ws("", shown).alias("prompt"), listed.alias("attachments"), F.size("ts").alias("n_turns"), total.alias("n_tokens"))
