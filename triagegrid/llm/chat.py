"""Chat formatting with typed content parts.

A turn is a list of parts.  A visitor flattens them in order: text as it is, images, audio and documents as placeholders, with a list of the
attachments and the number of tokens each placeholder will expand to.  Turns are marked by control strings; control strings
inside texts are escaped, so the formatted conversation can be read back exactly.

A formatted conversation is a run of rows in order, each of whole turns and some megabyte at most, so that no conversation has to fit
into memory; digests are made while its rows stream by.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.llm.tables import stash

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that mean something to this template or to common others; texts never hold them unescaped.
CONTROL = (TURN, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
LEARNED_ROLE = "assistant"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
CHUNK_CHARS = 1 << 19
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_control = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_escaped = re.compile(r"\\(.)", re.S)
_pieces = re.compile(r"\\.|" + "|".join(re.escape(c) for c in PLACEHOLDERS.values()), re.S)


def escape(text: str) -> str:
    """Backslashes doubled, and one behind the first character of every control string."""
    return _control.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "\n")


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(part.get(side) or 0, 1) / PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach("audio", part, max(1, math.ceil(seconds * AUDIO_RATE)) if math.isfinite(seconds) else 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        """A part of another type counts as its text."""
        self.visit_text(part)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(PLACEHOLDERS[kind])
        self.attachments.append({"type": kind, "ref": part.get("ref"), "tokens": tokens})


def as_parts(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with their text as the only part of each turn."""
    part = F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return turns.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, mask_from, mask_to, attachments): each turn by itself; the mask covers an assistant's content, in code points."""
    kind = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out, begins, ends, files = [], [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                flat = Flattener()
                for part in parts or ():
                    flat.visit(part or {})
                head, body = f"{TURN}{escape_role(role or '')}\n", "".join(flat.pieces)
                out.append(head + body + END)
                begins.append(len(head) if role == LEARNED_ROLE else None)
                ends.append(len(head) + len(body) if role == LEARNED_ROLE else None)
                files.append(flat.attachments)
            kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(files, kind)],
                ["conv_id", "turn", "formatted", "mask_from", "mask_to", "attachments"],
            )

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, formatted string, mask_from long, mask_to long, attachments array<struct<type:string,ref:string,tokens:long>>"
    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(work, schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, text, mask, attachments): the formatted conversations, in chunks of whole turns.

    ``turns``: conv_id, turn, role, parts.  Turns go by turn number, null last, ties by what they say; a null role is empty, null or empty parts
    and null texts are empty text.  ``mask``: the ranges of a chunk to learn from.  A null conv_id is a conversation of its own.
    Other columns are ignored.  No rows: no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]):
        now: list = []

        def batch_of(rows):
            columns = list(zip(*rows))
            mask = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            files = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.string(), mask, files))], ["conv_id", "chunk", "text", "mask", "attachments"])

        id_type = pa.int64()
        conv, chunk, size, parts, mask, files = (), 0, 0, [], [], []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if conv and (row["conv_id"] != conv[0] or size + len(row["formatted"]) > CHUNK_CHARS) and parts:
                    now.append((conv[0], chunk, "".join(parts), mask, files))
                    chunk = chunk + 1 if row["conv_id"] == conv[0] else 0
                    size, parts, mask, files = 0, [], [], []
                conv = (row["conv_id"],)
                if row["mask_from"] is not None:
                    mask.append({"from": size + row["mask_from"], "to": size + row["mask_to"]})
                places = [size + m.start() for m in _pieces.finditer(row["formatted"]) if m[0] in PLACEHOLDERS.values()]
                files += [f | {"at": at} for f, at in zip(row["attachments"], places)]
                parts.append(row["formatted"])
                size += len(row["formatted"])
            if now:
                yield batch_of(now)
                now = []
        if parts:
            yield batch_of([(conv[0], chunk, "".join(parts), mask, files)])

    ordered = format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "formatted")
    schema = f"conv_id {kind}, chunk long, text string, mask array<struct<from:long,to:long>>, attachments array<struct<type:string,ref:string,tokens:long,at:long>>"
    return ordered.mapInArrow(gather, schema)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, content) of every turn of a formatted text, unescaped; placeholders stay as they are."""
    out = []
    for turn in text.split(TURN)[1:]:
        turn = turn.removesuffix(END)
        line = re.match(r"((?:[^\\\n]|\\.)*)\n", turn, re.S)
        out.append((unescape(line[1]), unescape(turn[line.end() :])))
    return out


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted conversations."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]):
        done: list = []
        conv, state = (), None
        id_type = pa.int64()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def close():
            done.append((conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((id_type, *kinds))], names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                conv_id, text = batch.column("conv_id")[i].as_py(), batch.column("text")[i].as_py()
                if not conv or conv_id != conv[0]:
                    if conv:
                        close()
                    conv, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                for span in batch.column("mask")[i].as_py():
                    learned = unescape(text[span["from"] : span["to"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield made()
                done.clear()
        if conv:
            close()
            yield made()

    ordered = chunks.select("conv_id", "chunk", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(read, schema)


def written_conversations(turns: DataFrame) -> DataFrame:
    """The formatted conversations as a table in the shared folder, read again."""
    return stash(format_conversations(turns), "chat")
