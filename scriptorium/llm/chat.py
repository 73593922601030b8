"""Speaker turns as chat text with a loss mask, and back."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "doc_id bigint, pos bigint, role string, content string, loss_from int, loss_to int, "
    "attachments array<struct<number:int,type:string,uri:string,tokens:bigint>>, expanded_tokens bigint"
)
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Every ``<|`` gets a backslash between its signs, one more if some stand there: no control string is left."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _header(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


@dataclass
class PartVisitor:
    """Flattens typed parts in order: texts are escaped, all others become numbered placeholders."""

    patch: int = 28
    tokens_a_second: float = 12.5
    tokens_a_page: int = 600
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part or {})

    def visit_text(self, part):
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part):
        across, down = (-(-max(0, part.get(side) or 0) // self.patch) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part):
        self._attach("audio", part, int(-(-max(0.0, part.get("seconds") or 0.0) * self.tokens_a_second // 1)))

    def visit_document(self, part):
        self._attach("document", part, max(0, part.get("pages") or 0) * self.tokens_a_page)

    def visit_other(self, part):
        self._attach("other", part, 0)

    def _attach(self, kind, part, tokens):
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": kind, "uri": part.get("uri"), "tokens": tokens})
        self.out.append(f"<|{kind}:{number}|>")


def format_turns(turns: DataFrame, *, doc_id: str = "doc_id", pos: str = "pos", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row a turn with its formatted ``content``; a chat is its turns' contents in order.

    ``parts`` is an array of typed parts; texts keep their order with placeholders such as
    ``<|image:1|>``, which are numbered in a turn. ``attachments`` records what they stand
    for and how many tokens each expands to, ``expanded_tokens`` their sum. ``loss_from`` and
    ``loss_to`` bound the characters of a ``trained`` role's text, null for other turns. Null
    parts, texts and roles count as empty; a part of an unknown type becomes a placeholder
    ``other``. Rows without id make one chat; a repeated row is a turn of its own. Turns are
    formatted one by one, so a chat of any length is never held in one row.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, at, who, own in zip(*(c.to_pylist() for c in batch.columns)):
                visitor = PartVisitor()
                for part in own or []:
                    visitor.visit(part)
                head, body = f"{OPEN}{_header(who or '')}\n", "".join(visitor.out)
                loss = (len(head), len(head) + len(body)) if who in trained else (None, None)
                rows.append((doc, at, who or "", f"{head}{body}{CLOSE}\n", *loss, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            if rows:
                kind = pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), kind, pa.int64())
                names = ("doc_id", "pos", "role", "content", "loss_from", "loss_to", "attachments", "expanded_tokens")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

    columns = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(pos).cast("bigint").alias("pos"), F.col(role).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")]
    return turns.select(*columns).mapInArrow(run, FORMATTED)


class _Chat:
    """What is read back of one chat, turn by turn."""

    def __init__(self, doc):
        self.doc, self.turns, self.chars, self.loss_chars = doc, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, content: str, start: int | None, end: int | None) -> None:
        self.chars += len(content)
        if start is not None:
            text = unescape(content[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        turn = _TURN.fullmatch(content)
        if not turn:
            raise ValueError(f"a turn of chat {self.doc} is not as it was formatted")
        self.turns += 1
        self.all.update(f"{_role(turn[1])}\n{unescape(turn[2])}\n".encode())

    def row(self):
        return self.doc, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_chats(formatted: DataFrame) -> DataFrame:
    """doc_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted turns.

    The turns of a chat come in order of ``pos`` (nulls first), ties by content; they pass
    one by one, so memory does not grow with a chat.
    """
    schema = "doc_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        chat = None
        for batch in batches:
            done = []
            for doc, content, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if chat is None or chat.doc != doc:
                    if chat is not None:
                        done.append(chat.row())
                    chat = _Chat(doc)
                chat.add(content, start, end)
            if done:
                yield _rows(done)
        if chat is not None:
            yield _rows([chat.row()])

    def _rows(done):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [c.split()[0] for c in schema.split(", ")])

    ordered = formatted.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "content")
    return ordered.select("doc_id", "content", "loss_from", "loss_to").mapInArrow(run, schema)
