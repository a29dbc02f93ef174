"""Line dedup over content-defined chunks of lines.

A chunk ends behind a line when a rolling hash over that line and the two before it is divisible by ``spread``; so boundaries depend on
nearby lines only, and a passage inserted above shifts no boundary below.  A chunk of several lines that stands anywhere
else, in another document or the same one, is removed everywhere but at its first place (smallest doc_id, then smallest position); equality is decided by bytes,
hashes only find the candidates.

``passage_dedup`` removes repeated passages whole: chunks as above, and every run of sentences and lines that has words enough.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import free_name, stash

SPREAD = 3
LEAST_LINES = 2
#: Multipliers of a line and of the two above it in the rolling hash.
ROLL = (1, 31, 961)
#: Words of a run of units from which it is a passage; a unit has at least a word for every so many bytes, for scripts without spaces.
LEAST_WORDS = 25
WORD_BYTES = 12
#: Bytes that may stand between the mark that ends a sentence and white space, and how many of them.
CLOSERS, MOST_CLOSERS = np.isin(np.arange(256), list(b"\"')]")), 3
STOPS = np.isin(np.arange(256), list(b".!?"))
#: Sentence marks that no white space follows.
WIDE_STOPS = np.array([list(x.encode()) for x in "。！？"], np.uint8)
#: Numbers for bytes, for a second hash.
OTHER_BYTES = tb.mixed(np.arange(1, 257, dtype=np.uint64) * tb.STEP)


def _chunks(text: bytes, spread: int) -> list[tuple[int, int, int, bool]]:
    """(from, to, lines, whether a line end closes it) of the chunks of a text, as byte ranges that cover it, line ends included."""
    if not text:
        return []
    lines = text.split(b"\n")
    marks = np.array([int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines], np.int64)
    rolling = ROLL[0] * marks
    for back in (1, 2):
        rolling[back:] += ROLL[back] * marks[:-back]
    ends = np.flatnonzero(rolling % spread == 0) + 1
    if not len(ends) or ends[-1] < len(lines):
        ends = np.append(ends, len(lines))
    byte_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    byte_at[-1] = len(text)
    begins = np.concatenate([[0], ends[:-1]])
    return [(int(byte_at[b]), int(byte_at[e]), int(e - b), bool(e < len(lines))) for b, e in zip(begins, ends)]


def _body(text: bytes, chunk: tuple[int, int, int, bool]) -> bytes:
    """The lines of a chunk joined by line ends; the end of its last line is not part of it."""
    return text[chunk[0] : chunk[1] - 1] if chunk[3] else text[chunk[0] : chunk[1]]


def _hash(body: bytes) -> int:
    return int.from_bytes(hashlib.md5(body).digest()[:8], "big", signed=True)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
    raw = data.tobytes()
    return [raw[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)]


def removed_chunks(docs: DataFrame, spread: int = SPREAD, least_lines: int = LEAST_LINES) -> DataFrame:
    """(key, gone): for each row key of ``docs`` (with ``__key``) the numbers and hashes of the chunks to remove."""

    def list_chunks(batches):
        for batch in tb.slices(batches, "text"):
            keys = batch.column(batch.schema.get_field_index("__key")).to_pylist()
            rows = []
            for key, text in zip(keys, _texts(batch)):
                rows += [(key, i, _hash(_body(text, chunk))) for i, chunk in enumerate(_chunks(text, spread)) if chunk[2] >= least_lines]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["__key", "chunk", "hash"])

    each = docs.mapInArrow(list_chunks, "__key long, chunk int, hash long").distinct()
    often = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = each.join(often, "hash").groupBy("__key").agg(F.collect_set("chunk").alias("chunks"))

    def fetch(batches):
        for batch in tb.slices(batches, "text"):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            rows = []
            for key, doc_id, text, chunks in zip(column("__key").to_pylist(), column("doc_id").to_pylist(), _texts(batch), column("chunks").to_pylist()):
                found = _chunks(text, spread)
                for i in chunks:
                    if i < len(found):
                        body = _body(text, found[i])
                        rows.append((key, doc_id, i, _hash(body), body))
            kinds = (pa.int64(), batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["__key", "doc_id", "chunk", "hash", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bodies = docs.join(wanted, "__key").mapInArrow(fetch, f"__key long, doc_id {kind}, chunk int, hash long, body binary").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key", "chunk")
    first = bodies.groupBy("hash", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = bodies.join(first, ["hash", "body"]).where(~((F.col("__key") == F.col("first.__key")) & (F.col("chunk") == F.col("first.chunk"))))
    return again.groupBy("__key").agg(F.collect_set(F.struct("chunk", "hash")).alias("gone"))


def line_dedup(docs: DataFrame, spread: int = SPREAD, least_lines: int = LEAST_LINES) -> DataFrame:
    """``docs`` with text cut, and n_lines, n_removed_lines, n_removed_chunks added.

    Lines end at \\n.  The lines of a removed chunk go with their line ends; a text may become empty, its row stays.  A null text stays null and
    has no lines; an empty text has one.  Rows equal in doc_id and text are one place: what they repeat among
    themselves stays.  A null doc_id comes after all others.  Columns named like the added ones are replaced.  No rows: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    key, mark = free_name(names, "__key"), free_name(names, "__gone")
    place = F.xxhash64("doc_id", "text")
    gone = removed_chunks(docs.select("doc_id", "text", place.alias("__key")), spread, least_lines).toDF(key, mark)
    docs = docs.select(*names, place.alias(key))
    schema = docs.select(*names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            texts, lines, out_lines, out_chunks = [], [], [], []
            valid = column("text").is_valid().to_pylist()
            for text, have, gone in zip(_texts(batch), valid, column(mark).to_pylist()):
                lines.append(text.count(b"\n") + 1 if have else 0)
                hit = {(x["chunk"], x["hash"]) for x in gone or ()}
                kept, removed, chunks = [], 0, 0
                if hit:
                    for i, chunk in enumerate(_chunks(text, spread)):
                        if (i, _hash(_body(text, chunk))) in hit:
                            removed, chunks = removed + chunk[2], chunks + 1
                        else:
                            kept.append(text[chunk[0] : chunk[1]])
                    text = b"".join(kept)
                texts.append(text if have else None)
                out_lines.append(removed)
                out_chunks.append(chunks)
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            columns = [made.get(c, column(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(out_lines, pa.int64()), pa.array(out_chunks, pa.int64())], [*names, "n_lines", "n_removed_lines", "n_removed_chunks"])

    held = docs.join(gone, key, "left")
    return held.mapInArrow(cut, fields + ", n_lines long, n_removed_lines long, n_removed_chunks long")


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, from, behind its last word, words) of the lines of the texts, cut behind sentences; blank ones are none."""
    starts, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    wide = np.zeros(len(data) + 1, bool)
    for stop in WIDE_STOPS:
        hit = np.flatnonzero(data[:-2] == stop[0]) if len(data) > 2 else np.zeros(0, np.int64)
        wide[hit[(data[hit + 1] == stop[1]) & (data[hit + 2] == stop[2])] + 3] = True
    cut = np.flatnonzero(wide[:-1])
    cut = cut[tb.NOT_SPACE[data[cut]] & (starts[np.minimum(np.searchsorted(starts, cut), len(starts) - 1)] != cut)]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        row = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last = ends - 1
    for _ in range(MOST_CLOSERS):
        last = np.where(CLOSERS[data[last]] & (last > starts), last - 1, last)
    edge = np.ones(len(starts), bool)
    edge[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[ends[:-1]]) | STOPS[data[last[:-1]]] | wide[ends[:-1]]
    first = np.flatnonzero(edge)
    n = np.diff(np.append(first, len(starts)))
    return row[first], starts[first], ends[first + n - 1], n


def _pieces(data: np.ndarray, offsets: np.ndarray, spread: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(row, place, hash, other hash, anchor) of every piece that may repeat: shortest passages, and chunks of several lines with fewer words.

    Of every unit the shortest passage that begins with it and the shortest that ends with it are pieces.  A run of units with
    ``least_words`` words is covered by those inside it, so it repeats whole if its pieces do, whatever stands around it.  ``place``:
    first byte and byte behind the white space after it, packed.  ``anchor``: the least unit hash; equal pieces have equal anchors.
    """
    row, begin, end, words = _units(data, offsets)
    size = np.concatenate([[0], np.cumsum(np.maximum(words, (end - begin) // WORD_BYTES))])
    at, every = tb.runs(row, len(offsets) - 1), np.arange(len(row))
    ends = np.searchsorted(size, size[:-1] + least_words)
    begins = np.searchsorted(size, size[1:] - least_words, side="right") - 1
    ahead, back = ends <= at[row + 1], begins >= at[row]
    spans = np.unique(np.concatenate([every[ahead] * (len(row) + 1) + ends[ahead], begins[back] * (len(row) + 1) + every[back] + 1]))
    x, y = spans // (len(row) + 1), spans % (len(row) + 1)
    named = [tb.span_hash(tb.prefix_hash(kind[data] if kind is not None else data), begin, end) for kind in (None, OTHER_BYTES)]
    hashes = [tb.span_hash(tb.prefix_hash(name), x, y) for name in named]
    anchor = np.minimum.reduceat(np.append(named[0], np.uint64(0)), np.stack([x, y], 1).ravel())[::2] if len(x) else np.zeros(0, np.uint64)
    of = row[x]
    first = np.where(x == at[of], 0, begin[x] - offsets[of])
    behind = np.where(y == at[of + 1], offsets[of + 1], np.append(begin, 0)[y]) - offsets[of]
    raw, short = data.tobytes(), []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = raw[a:b]
        for chunk in _chunks(text, spread) if b"\n" in text else ():
            if chunk[2] >= LEAST_LINES:
                body = _body(text, chunk)
                if len(body.split()) < least_words:
                    short.append((i, _place(chunk[0], chunk[1]), *struct.unpack("<QQ", hashlib.md5(body).digest())))
    row, place, one, two = (np.array([c[j] for c in short], t) for j, t in enumerate((np.int64, np.int64, np.uint64, np.uint64)))
    parts = ((of, row), (_place(first, behind), place), (hashes[0], one), (hashes[1], two), (anchor, one))
    return tuple(np.concatenate(p) for p in parts)


def _place(begin, end):
    return begin * (1 << 31) + end


def _listed(lists: pa.Array, *fields: str) -> np.ndarray:
    """A 64-bit name of every (row, value) of a column of lists, or (row, fields of the value)."""
    values = lists.flatten()
    values = [values.field(f) for f in fields] if fields else [values]
    return _named(pa.compute.list_parent_indices(lists).to_numpy(), *[v.to_numpy() for v in values])


def _named(row: np.ndarray, *values: np.ndarray) -> np.ndarray:
    out = row.astype(np.uint64)
    for v in values:
        out = tb.mixed(out * tb.STEP + v.view(np.uint64) + np.uint64(1))
    return out


def repeated_pieces(docs: DataFrame, spread: int = SPREAD, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, gone): for each row key of ``docs`` (with ``__key``) the pieces that also stand at an earlier place.

    Anchors come first: pieces are listed only where their anchor stands at two places.
    """

    def list_anchors(batches):
        for batch in tb.slices(batches, "text"):
            row, _, one, _, anchor = _pieces(*tb.column_bytes(batch.column("text")), spread, least_words)
            # The anchor of a piece that repeats inside its text counts twice there.
            name = _named(row, one)
            _, kind_of, n = np.unique(name, return_inverse=True, return_counts=True)
            order = np.lexsort((-n[kind_of], anchor, row))
            row, anchor, n = row[order], anchor[order], n[kind_of][order]
            edge = np.ones(len(row), bool)
            edge[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            keys = batch.column("__key").take(pa.array(row[edge]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(anchor[edge].view(np.int64)), pa.array(np.minimum(n[edge], 2).astype(np.int32))], ["__key", "anchor", "n"])

    def list_pieces(batches):
        for batch in tb.slices(batches, "text"):
            row, place, one, two, anchor = _pieces(*tb.column_bytes(batch.column("text")), spread, least_words)
            keep = np.isin(_named(row, anchor), _listed(batch.column("anchors")))
            taken = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key").take(taken), batch.column("doc_id").take(taken), pa.array(place[keep]), pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64))],
                ["__key", "doc_id", "place", "hash", "more"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = docs.select("__key", "text").mapInArrow(list_anchors, "__key long, anchor long, n int")
    anchors = stash(anchors, "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = anchors.select("__key", "anchor").join(often, "anchor", "left_semi").groupBy("__key").agg(F.collect_set("anchor").alias("anchors"))
    each = docs.join(wanted, "__key").mapInArrow(list_pieces, f"__key long, doc_id {kind}, place long, hash long, more long")
    each = stash(each, "pieces")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key", "place")
    first = each.groupBy("hash", "more").agg(F.min(order).alias("first"), F.max(order).alias("other")).where("first <> other").drop("other")
    later = each.join(first, ["hash", "more"]).where((F.col("__key") != F.col("first.__key")) | (F.col("place") != F.col("first.place")))
    return later.groupBy("__key").agg(F.collect_set(F.struct("place", "hash")).alias("gone"))


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``text`` without the spans, and how many separate runs they are.  A line that loses its end only keeps its line end."""
    runs: list[list[int]] = []
    for begin, to in sorted(spans):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], to)
        else:
            runs.append([begin, to])
    kept, end = [], 0
    for begin, to in runs:
        kept.append(text[end:begin])
        closed = text[begin:to]
        if begin and text[begin - 1 : begin] != b"\n" and to < len(text) and b"\n" in closed[len(closed.rstrip()) :]:
            kept.append(b"\n")
        end = to
    kept.append(text[end:])
    return b"".join(kept), len(runs)


def passage_dedup(docs: DataFrame, spread: int = SPREAD, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with text cut, and n_lines, n_removed_bytes, n_removed_passages added.

    A unit is a line or a sentence of it, without the white space around it.  Every run of units with ``least_words`` words that stands
    anywhere else, in another document or the same one, is removed everywhere but at its first place (smallest doc_id, then smallest
    position), and so are repeated chunks of lines.  Units are compared by two 64-bit hashes; how passages are broken into lines between
    sentences does not matter.  A passage that begins or ends inside a sentence keeps that part of it.  Of every removed unit an equal one stays.
    n_removed_passages counts maximal removed runs.  Nulls, empty texts, equal rows and columns: as in ``line_dedup``.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_bytes", "n_removed_passages")]
    key, mark = free_name(names, "__key"), free_name(names, "__gone")
    place = F.xxhash64("doc_id", "text")
    gone = repeated_pieces(docs.select("doc_id", "text", place.alias("__key")), spread, least_words).toDF(key, mark)
    docs = docs.select(*names, place.alias(key))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            texts, lines, out_bytes, out_runs = [], [], [], []
            valid = column("text").is_valid().to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in valid]
            hit = np.flatnonzero(column(mark).is_valid().to_numpy(zero_copy_only=False))
            chosen = batch.take(pa.array(hit))
            row, place, one, *_ = _pieces(*tb.column_bytes(chosen.column(chosen.schema.get_field_index("text"))), spread, least_words)
            keep = np.isin(_named(row, place, one), _listed(chosen.column(chosen.schema.get_field_index(mark)), "place", "hash"))
            for i, p in zip(hit[row[keep]].tolist(), place[keep].tolist()):
                spans[i].append((p >> 31, p & (1 << 31) - 1))
            for text, have, own in zip(_texts(batch), valid, spans):
                lines.append(text.count(b"\n") + 1 if have else 0)
                left, runs = _without(text, own) if own else (text, 0)
                texts.append(left if have else None)
                out_bytes.append(len(text) - len(left))
                out_runs.append(runs)
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            columns = [made.get(c, column(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in (lines, out_bytes, out_runs)]], [*names, "n_lines", "n_removed_bytes", "n_removed_passages"])

    held = docs.join(gone, key, "left")
    return held.mapInArrow(cut, fields + ", n_lines long, n_removed_bytes long, n_removed_passages long")
