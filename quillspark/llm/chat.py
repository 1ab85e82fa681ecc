"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens it in order: text as it is, with control
strings escaped; each image, audio or document part as one placeholder, with an attachment record (kind,
reference, place in the output) and the tokens that the placeholder stands for once expanded. Turns are
marked by a template; text inside a turn can't form a mark, and reading back restores it exactly.

Escape: a backslash becomes two; a control string gets a backslash after its first character. Reading:
two backslashes are one, a lone one goes. So ``</s>`` in a text is written ``<\\/s>``.

Rows of one conversation are sorted within their partition and streamed; only the turn at hand is held, so
one conversation may hold any share of the rows.

Cases: null text is empty; null or unknown roles are kept as they are (null: empty); a null conv_id is a
conversation of its own; turns with equal numbers are ordered by role and text, repeated rows stay; a
conversation without an assistant has an empty loss mask; empty tables give empty results; other columns
are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Marks of the template, and other control strings that models act on.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = [TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_CONTROL = re.compile("|".join([r"\\", *(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True))]))
_ESCAPED = re.compile(r"\\(\\?)")
_MARK = re.compile("|".join(re.escape(x) for x in (TURN, BODY, END, *PLACEHOLDERS.values())))

#: Tokens that a part stands for when its own record doesn't say: per image tile, audio second, document page.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass(frozen=True)
class Part:
    """kind: text, image, audio or document; units: tiles, seconds or pages."""

    kind: str
    text: str = ""
    uri: str = ""
    units: int = 1

    def accept(self, visitor: Flattener) -> None:
        handler = getattr(visitor, f"visit_{self.kind}", None)
        if handler is None:
            raise ValueError(f"unknown kind of part: {self.kind!r}")
        handler(self)


@dataclass
class Flattener:
    """Visits parts in order; collects output, attachments and expanded token counts.

    Adjacent texts are escaped as one, as a control string could begin in one and end in the next."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0
    texts: list[str] = field(default_factory=list)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _flush(self) -> None:
        if self.texts:
            self._put(escape("".join(self.texts)))
            self.texts = []

    def visit_text(self, part: Part) -> None:
        self.texts.append(part.text)

    def _attach(self, part: Part) -> None:
        self._flush()
        tokens = max(0, part.units) * TOKENS[part.kind]
        self.attachments.append({"kind": part.kind, "uri": part.uri, "at": self.length, "tokens": tokens})
        self.expanded_tokens += tokens
        self._put(PLACEHOLDERS[part.kind])

    visit_image = visit_audio = visit_document = _attach

    def body(self) -> str:
        self._flush()
        return "".join(self.out)


def format_turn(role: str, parts: list[Part]) -> tuple[str, int, int, Flattener]:
    """The formatted turn, bounds of its body, and what the visitor collected (places within the body)."""
    visitor = Flattener()
    for part in parts:
        part.accept(visitor)
    head = TURN + escape(role) + BODY
    body = visitor.body()
    return head + body + END, len(head), len(head) + len(body), visitor


def read_turn(formatted: str) -> tuple[str, list[str]]:
    """Role and body of a formatted turn: texts unescaped, placeholders as they stand."""
    marks = list(_MARK.finditer(formatted))
    if len(marks) < 3 or marks[0][0] != TURN or marks[1][0] != BODY or marks[-1][0] != END or marks[0].start() or marks[-1].end() != len(formatted):
        raise ValueError("not one formatted turn")
    pieces, at = [], marks[1].end()
    for m in marks[2:]:
        if at < m.start():
            pieces.append(unescape(formatted[at : m.start()]))
        if m[0] != END:
            pieces.append(m[0])
        at = m.end()
    return unescape(formatted[marks[0].end() : marks[1].start()]), pieces


FORMATTED = (
    "conv_id long, turn_no long, role string, formatted string, loss_start long, loss_end long, "
    "attachments array<struct<kind:string,uri:string,at:long,tokens:long>>, expanded_tokens long"
)


def _sorted(conversations: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    # Ties are ordered by the content itself, so that the result is the same wherever rows come from.
    return conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, parts_col: str | None = None) -> DataFrame:
    """A formatted row for each turn, in order: the text of a conversation is its rows' ``formatted`` joined.

    ``loss_start`` and ``loss_end`` bound the loss mask in the row (equal: none). With ``parts_col``
    (array<struct<kind,text,uri,units>>) content comes from there, else from ``text``."""
    content = [F.col("text")] if parts_col is None else [F.col("text"), F.col(parts_col).alias("parts")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), *content)
    rows = _sorted(rows, rows.columns, ["turn", "role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, turn_no = object(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(low, 500).to_pylist():
                    turn_no = turn_no + 1 if r["conv_id"] == last else 0
                    last = r["conv_id"]
                    parts = [Part("text", r["text"] or "")]
                    if r.get("parts") is not None:
                        parts = [Part(p["kind"] or "text", p["text"] or "", p["uri"] or "", 1 if p["units"] is None else p["units"]) for p in r["parts"]]
                    text, start, end, seen = format_turn(r["role"] or "", parts)
                    loss = (start, end) if r["role"] == "assistant" else (end, end)
                    attached = [a | {"at": a["at"] + start} for a in seen.attachments]
                    out.append((r["conv_id"], turn_no, r["role"], text, *loss, attached, seen.expanded_tokens))
                yield _batch(out)

    return rows.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    attachment = pa.struct([("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
    names = [x.split()[0] for x in ("conv_id", "turn_no", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(attachment), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted rows and loss mask alone.

    The rows must be as ``format_conversations`` leaves them: one partition a conversation, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done() -> pa.RecordBatch:
            values = [state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            closed = []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state["id"] != conv:
                    if state is not None:
                        closed.append(done())
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                role, pieces = read_turn(text)
                state["n"] += 1
                state["turns"].update(f"{role}\n{''.join(pieces)}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(text[start:end])
                state["chars"] += len(loss)
                state["loss"].update(loss.encode("utf-8", "surrogatepass"))
                state["formatted"] += len(text)
            if closed:
                yield from pa.Table.from_batches(closed).combine_chunks().to_batches()
        if state is not None:
            yield done()

    columns = formatted.select("conv_id", "formatted", "loss_start", "loss_end")
    return columns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame(
        [Row(conv_id=-7, turn=0, role="user", text=text), Row(conv_id=-7, turn=1, role="assistant", text=text)], "conv_id long, turn long, role string, text string"
    )
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.unionByName(probe)
