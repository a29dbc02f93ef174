"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ``window`` neighbouring words (a shorter item is one window).  A window is a set of
word shingles, and a document can contain it only if it contains all of them: of the shingles ordered by rarity in the documents,
the necessary prefix is the rarest one.  Documents meet windows at that token only; length and position bounds drop
windows that would reach past the document, and the words of the item-sized stretch are compared byte by byte.

Items are taken in blocks of a bounded number of windows, so what is broadcast has a fixed size; all documents are held against every
block, and finds are carried along.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import free_name, stash

#: Windows in a block: with shingles, words and ids some 200 MB at the driver and 100 MB broadcast.
BLOCK_WINDOWS = 500_000
SHINGLE = 3
FOUND = "doc_id {kind}, n_words int, starts array<int>, lengths array<int>, items array<string>"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(words, m, items): the distinct windows of all items as lower-case words joined by spaces, their length and item ids."""

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column("text"))
            data = tb.LOWER[data]
            starts, ends, row = tb.words(data, offsets, tb.ALNUM)
            at = tb.runs(row, batch.num_rows)
            ids = batch.column("item_id").to_pylist()
            out_words, out_n, out_id = [], [], []
            for i in range(batch.num_rows):
                have = [data[starts[j] : ends[j]].tobytes() for j in range(at[i], at[i + 1])]
                m = min(window, len(have))
                for j in range(len(have) - m + 1 if m else 0):
                    out_words.append(b" ".join(have[j : j + m]))
                    out_n.append(m)
                    out_id.append(ids[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_words, pa.binary()), pa.array(out_n, pa.int32()), pa.array(out_id, pa.string())], ["words", "m", "item"]
            )

    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    each = items.mapInArrow(cut, "words binary, m int, item string")
    return each.groupBy("words", "m").agg(F.collect_set("item").alias("items"))


@dataclass
class Block:
    """Windows ready to be looked up: their words, and for each its necessary prefix token."""

    data: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    items: list
    shingles: np.ndarray
    shingle_at: np.ndarray
    tokens: np.ndarray
    token_window: np.ndarray
    token_place: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Block:
        data, offsets = tb.column_bytes(rows.column("words").combine_chunks())
        starts, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
        hashes = tb.span_hash(tb.prefix_hash(data), starts, ends)
        at = tb.runs(row, rows.num_rows)
        found = [tb.rolled(hashes[at[i] : at[i + 1]], min(SHINGLE, at[i + 1] - at[i])) for i in range(rows.num_rows)]
        shingle_at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        nothing = np.zeros(0, np.int64)
        return Block(data, offsets, rows.column("m").to_numpy(), rows.column("items").to_pylist(), np.concatenate(found) if found else np.zeros(0, np.uint64), shingle_at, nothing, nothing, nothing)

    def order_by_rarity(self, known: np.ndarray, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle; windows with a shingle that no document has cannot occur."""
        if not len(known) or not len(self.shingles):
            self.shingles = np.zeros(0, np.uint64)
            return
        place = np.minimum(np.searchsorted(known, self.shingles), len(known) - 1)
        often = np.where(known[place] == self.shingles, counts[place], 0)
        window = np.repeat(np.arange(len(self.lengths)), np.diff(self.shingle_at))
        inside = np.arange(len(self.shingles)) - self.shingle_at[window]
        order = np.lexsort((inside, self.shingles, often, window))
        first = order[np.searchsorted(window, np.arange(len(self.lengths)))]
        first = first[often[first] > 0]
        first = first[np.argsort(self.shingles[first], kind="stable")]
        self.tokens, self.token_window, self.token_place = self.shingles[first], window[first], inside[first]
        self.shingles = np.zeros(0, np.uint64)


def _positions(batch: pa.RecordBatch, sizes: list[int]):
    """Words of the documents of a batch, and for each shingle size the hashes at every word (no row bound)."""
    data, offsets = tb.column_bytes(batch.column("text"))
    data = tb.LOWER[data]
    starts, ends, row = tb.words(data, offsets, tb.ALNUM)
    hashes = tb.span_hash(tb.prefix_hash(data), starts, ends)
    return data, starts, ends, row, {k: tb.rolled(hashes, k) for k in sizes}


def shingle_counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, occurrences in all documents) of the wanted shingles, sorted; those that never occur are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in tb.slices(batches, "text"):
            _, _, _, row, by_size = _positions(batch, sizes)
            for k, hashes in by_size.items():
                hashes = hashes[row[: len(hashes)] == row[k - 1 :]] if len(hashes) else hashes
                place = np.searchsorted(wanted, hashes)
                place[place == len(wanted)] = 0
                total += np.bincount(place[wanted[place] == hashes], minlength=len(wanted))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[used].view(np.int64)), pa.array(total[used])], ["shingle", "n"])

    sums = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    shingles, counts = sums.column("shingle").to_numpy().view(np.uint64), sums.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def merged(starts: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """The same ranges without overlaps, in order; touching ranges become one."""
    spans = []
    for start, end in sorted((s, s + n) for s, n in zip(starts, lengths)):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [s for s, _ in spans], [e - s for s, e in spans]


def _held_against(docs: DataFrame, block: Block, sizes: list[int], carried: bool, last: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches):
        b = shared.value
        for batch in tb.slices(batches, "text"):
            data, starts, ends, row, by_size = _positions(batch, sizes)
            n = batch.num_rows
            at = tb.runs(row, n)
            first, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for hashes in by_size.values():
                if not len(b.tokens) or not len(hashes):
                    continue
                low = np.searchsorted(b.tokens, hashes, side="left")
                place = np.flatnonzero(b.tokens[np.minimum(low, len(b.tokens) - 1)] == hashes)
                low = low[place]
                many = np.searchsorted(b.tokens, hashes[place], side="right") - low
                which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                begin = np.repeat(place, many) - b.token_place[which]
                here = row[np.repeat(place, many)]
                # Position and length bounds: the whole window has to lie inside the document.
                fits = (begin >= at[here]) & (begin + b.lengths[b.token_window[which]] <= at[here + 1])
                first.append(begin[fits])
                window.append(b.token_window[which][fits])
            first, window = np.concatenate(first), np.concatenate(window)
            true = np.zeros(len(first), bool)
            for i, (f, w) in enumerate(zip(first, window)):
                m = b.lengths[w]
                have = b" ".join([data[s:e].tobytes() for s, e in zip(starts[f : f + m], ends[f : f + m])])
                true[i] = have == b.data[b.offsets[w] : b.offsets[w + 1]].tobytes()
            first, window = first[true], window[true]
            where = row[first] if len(first) else first
            out_s, out_n, out_i = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
            if carried:
                for i in range(n):
                    out_s[i], out_n[i], out_i[i] = batch.column("starts")[i].as_py(), batch.column("lengths")[i].as_py(), set(batch.column("items")[i].as_py())
            for r, f, w in zip(where, first, window):
                out_s[r].append(int(f - at[r]))
                out_n[r].append(int(b.lengths[w]))
                out_i[r].update(b.items[w])
            for r in np.unique(where):
                out_s[r], out_n[r] = merged(out_s[r], out_n[r])
            columns = [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int32)), pa.array(out_s, pa.list_(pa.int32())), pa.array(out_n, pa.list_(pa.int32())), pa.array([sorted(x) for x in out_i], pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "starts", "lengths", "items"]
            if not last:
                columns, names = [*columns, batch.column("text")], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(find, FOUND.format(kind=kind) + ("" if last else ", text string"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, hits (merged word ranges from, to), items.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.  A word inside any occurrence of a
    window of an item is hit; ``items`` are the ids, as strings in order, of the items with occurring windows.  Null, empty and wordless texts
    have no words and no hits; such items have no window.  Repeated items and documents are rows of their own; an item without item_id
    hits words but is not listed.  Other columns are ignored.  No items: no hits.
    """
    kept = stash(item_windows(items, window), "windows")
    blocks = max(1, -(-kept.count() // block_windows))
    held, found = docs.select("doc_id", "text"), None
    for i in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i).toArrow()
        block = Block.of(rows)
        sizes = sorted({min(SHINGLE, int(m)) for m in block.lengths})
        known, counts = shingle_counts(docs, np.unique(block.shingles), sizes) if len(block.shingles) else (block.shingles, block.shingles)
        block.order_by_rarity(known, counts)
        found = _held_against(held, block, sizes, carried=i > 0, last=i == blocks - 1)
        held = stash(found, "found") if i < blocks - 1 else None
    n_hit = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)
    hits = F.transform(F.arrays_zip("starts", "lengths"), lambda x: F.struct(x["starts"].alias("from"), (x["starts"] + x["lengths"]).alias("to")))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), hits.alias("hits"), "items")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs.  Rows without doc_id are judged by their text like all others."""
    # Equal ids are told apart by their text, so that a clean row does not go with a contaminated one.
    mark, of, of_mark = (free_name(docs.columns, x) for x in ("__mark", "__of", "__of_mark"))
    held = docs.withColumn(mark, F.xxhash64("text"))
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc_id"), "text")
    gone = contamination(keyed, items, window).where("n_hit > 0").select(F.col("doc_id.doc_id").alias(of), F.col("doc_id.text").alias(of_mark)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(mark) == F.col(of_mark))
    return held.join(gone, same, "left_anti").select(docs.columns)
