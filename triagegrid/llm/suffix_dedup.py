"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

Every start of such a string belongs to the anchor of its window: the k-gram of least hash in it.  Equal windows have equal anchors,
so only segments (neighbouring starts with one anchor, and the bytes they reach) with a common anchor can hold equal
windows.  Segments whose anchor occurs once are settled by counting; equal segments are one, with a
count.  The rest is dealt to shards by anchor.  Each shard sorts the suffixes of its segments (Larsson-Sadakane: ranks by 8 bytes, then groups that
are not yet sorted refined by the rank twice as far on) and measures common prefixes of neighbours (Kasai).
An anchor with very many segments is spread over several shards; their sorted windows are merged by binary search.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import stash

ANCHOR = 32
SHARD_BYTES = 2 << 20
#: Distinct segments of an anchor from which they are spread over shards, and as many to a shard.
SPREAD_FROM = 2000
#: Bytes of a text that are anchored at once, and bits for a place among them.
STRETCH_BYTES = 1 << 20
PLACE_BITS = 28


def _anchors(data: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """For every window start the position of its anchor: the first of the k-grams with the least hash."""
    n = len(data) - ANCHOR + 1
    at = np.arange(n)
    hashes = tb.span_hash(prefix, at, at + ANCHOR)
    least = (hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | at.astype(np.uint64)
    width, have = length - ANCHOR + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(key, at, n, anchor, segment): the segments of every text; ``at``: first start, ``n``: starts, then two hashes."""

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
            keys = batch.column(batch.schema.get_field_index("key"))
            # A long text goes in stretches that overlap by all but one byte of a window: each window lies whole in one of them.
            for low in range(0, max(0, len(data) - length + 1), STRETCH_BYTES):
                part = data[low : low + STRETCH_BYTES + length - 1]
                prefix = tb.prefix_hash(part)
                anchor = _anchors(part, prefix, length)
                starts = np.arange(len(anchor))
                row = np.searchsorted(offsets, starts + low, side="right") - 1
                fits = starts + low + length <= offsets[row + 1]
                starts, row, anchor = starts[fits], row[fits], anchor[fits]
                if not len(starts):
                    continue
                edge = np.ones(len(starts), bool)
                edge[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(edge)
                n = np.diff(np.append(first, len(starts)))
                begin, where = starts[first], anchor[first]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row[first])), pa.array((begin + low - offsets[row[first]]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(tb.span_hash(prefix, where, where + ANCHOR).view(np.int64)),
                     pa.array(tb.span_hash(prefix, begin, begin + n + length - 1).view(np.int64))],
                    ["key", "at", "n", "anchor", "segment"],
                )

    return docs.select("key", "text").mapInArrow(cut, "key long, at int, n int, anchor long, segment long")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of a byte string, by Larsson and Sadakane's refinement of unsorted groups."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key).astype(np.int32)
    # A rank is the place of the last suffix of its group; padding counts below every byte through the shorter suffix's place.
    rank = np.empty(n, np.int32)
    spots = np.arange(n, dtype=np.int32)
    _number(order, key[order], rank, spots)
    depth = 8
    spots = _unsorted(rank[order], spots)
    while len(spots):
        members = order[spots]
        ahead = members + depth
        further = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead)
        own = rank[members]
        by = np.argsort(own.astype(np.int64) * (2 * n + 1) + (further + n))
        members, own, further = members[by], own[by], further[by]
        order[spots] = members
        edge = np.ones(len(spots), bool)
        edge[:-1] = (own[1:] != own[:-1]) | (further[1:] != further[:-1])
        last = spots[np.flatnonzero(edge)]
        rank[members] = last[np.cumsum(np.concatenate([[0], edge[:-1]]))]
        spots = _unsorted(rank[members], spots)
        depth *= 2
    return order, rank


def _number(order: np.ndarray, keys: np.ndarray, rank: np.ndarray, spots: np.ndarray) -> None:
    edge = np.ones(len(order), bool)
    edge[:-1] = keys[1:] != keys[:-1]
    last = spots[np.flatnonzero(edge)]
    rank[order] = last[np.cumsum(np.concatenate([[0], edge[:-1]]))] if len(order) else 0


def _unsorted(ranks: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The spots whose rank is shared with a neighbour."""
    same = ranks[1:] == ranks[:-1]
    shared = np.zeros(len(spots), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return spots[shared]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, begin: np.ndarray, steps: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix, up to ``most``, of each suffix with the one before it in order.

    Measured for the first ``steps`` suffixes of each stretch that starts at ``begin``; the stretches are walked side by side, eight bytes at a time.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + most + 8, 8), (1, 1))
    out = np.zeros(n, np.int32)
    by_length = np.argsort(-steps, kind="stable")
    begin, steps = begin[by_length], steps[by_length]
    have = np.zeros(len(begin), np.int64)
    for t in range(int(steps[0]) if len(steps) else 0):
        live = int(np.searchsorted(-steps, -t, side="left"))
        i = begin[:live] + t
        h = np.maximum(have[:live] - 1, 0)
        place = rank[i]
        j = order[np.maximum(place - 1, 0)]
        h[place == 0] = 0
        todo = np.flatnonzero((place > 0) & (h < most))
        while len(todo):
            x, y = i[todo] + h[todo], j[todo] + h[todo]
            inside = y < n
            same = words[x] == words[np.minimum(y, n)]
            count = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
            count[~inside] = 0
            h[todo] += count
            todo = todo[(count == 8) & (h[todo] < most)]
        h = np.maximum(np.minimum(np.minimum(h, most), n - np.maximum(i, j)), 0)
        out[i] = h
        have[:live] = h
    return out


def repeated_starts(texts: list[bytes], starts: list[int], many: list[bool], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each segment the starts whose window occurs again, and for each start the number of its group of equal windows.

    A window of a segment that occurs several times (``many``) stands for as many windows.
    """
    at, parts, place = [], [], 0
    for no, text in enumerate(texts):
        at.append(place)
        # Separators hold bytes that UTF-8 never uses, and differ from each other.
        tail = bytes([0xFF, *(0xF8 + (no >> 2 * k & 3) for k in range(11, -1, -1)), 0xFF])
        parts += [text, tail]
        place += len(text) + len(tail)
    whole = np.frombuffer(b"".join(parts), np.uint8)
    order, rank = suffix_array(whole)
    begin, n = np.array(at, np.int64), np.array(starts, np.int64)
    common = common_prefixes(whole, order, rank, begin, n, length)
    weight = np.zeros(len(whole) + 1, np.int64)
    np.add.at(weight, begin, 1 + np.array(many, np.int64))
    np.add.at(weight, begin + n, -1 - np.array(many, np.int64))
    weight = np.cumsum(weight)[:-1][order]
    # A group: neighbours in order that share ``length`` bytes, each a window of a segment.
    joined = (common[order] >= length) & (weight > 0)
    joined[1:] &= weight[:-1] > 0
    joined[:1] = False
    group = np.cumsum(~joined) - 1
    flag, name = np.zeros(len(whole), bool), np.zeros(len(whole), np.int64)
    flag[order] = np.bincount(group, weight)[group] > 1 if len(whole) else False
    name[order] = group
    return [np.flatnonzero(flag[b : b + k]) for b, k in zip(begin, n)], [name[b : b + k] for b, k in zip(begin, n)]


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers, as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()))


#: What a shard tells: ranges (first, last) of repeated starts; or, of an anchor that is spread over shards, the names of a segment's
#: windows with their starts; or such names once more, sorted, for the bucket in which the shards of the anchor meet.
TOLD = "anchor long, segment long, n int, first int, last int, shard long, bucket long, starts binary, names binary"


def _window_names(text: bytes, anchor: int, n: int, length: int) -> np.ndarray:
    at = np.arange(n)
    windows = tb.span_hash(tb.prefix_hash(np.frombuffer(text, np.uint8)), at, at + length)
    return tb.mixed(np.array([anchor], np.int64).view(np.uint64)) ^ tb.mixed(windows + tb.STEP)


def _shard(length: int):
    """The work of a shard: see ``TOLD``."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = [field.split()[0] for field in TOLD.split(", ")]

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        once = {x: i for i, x in enumerate(zip(*(rows.column(c).to_pylist() for c in ("anchor", "segment", "n"))))}
        rows = rows.take(pa.array(list(once.values()), pa.int64()))
        anchor, segment, n = (rows.column(c).to_pylist() for c in ("anchor", "segment", "n"))
        texts, parts, shard = rows.column("bytes").to_pylist(), rows.column("parts").to_pylist(), rows.column("shard").to_pylist()
        found, groups = repeated_starts(texts, n, rows.column("many").to_pylist(), length)
        out = [(anchor[i], segment[i], n[i], a, b, None, None, None, None) for i in range(len(texts)) for a, b in spans_of(found[i])]
        wide = [i for i in range(len(texts)) if parts[i] > 1]
        # Of equal windows inside the shard, which are settled, one is offered to the others.
        _, first = np.unique(np.concatenate([groups[i] for i in wide]) if wide else np.zeros(0, np.int64), return_index=True)
        first = np.sort(first)
        ends = np.cumsum([n[i] for i in wide])
        by_bucket: dict[int, list[np.ndarray]] = {}
        for i, end in zip(wide, ends):
            starts = first[np.searchsorted(first, end - n[i]) : np.searchsorted(first, end)] - (end - n[i])
            if not len(starts):
                continue
            names = _window_names(texts[i], anchor[i], n[i], length)[starts]
            out.append((anchor[i], segment[i], n[i], None, None, shard[i], None, starts.astype(np.int32).tobytes(), names.tobytes()))
            bucket = tb.mixed(np.array([anchor[i]], np.int64).view(np.uint64) + names % np.uint64(parts[i]))
            for x in np.unique(bucket):
                by_bucket.setdefault(int(x.view(np.int64)), []).append(names[bucket == x])
        for x, names in by_bucket.items():
            out.append((None, None, None, None, None, shard[0], x, None, np.sort(np.concatenate(names)).tobytes()))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=columns)

    return work


def _names_of(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs]


def _held_in(names: np.ndarray, sorted_names: np.ndarray) -> np.ndarray:
    """Which names a binary search finds."""
    if not len(sorted_names):
        return np.zeros(len(names), bool)
    return sorted_names[np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)] == names


def _merge(rows: pa.Table) -> pa.Table:
    """(shard, names): of the sorted names of each shard those that another shard holds too."""
    runs = _names_of(rows.column("names"))
    whole = np.sort(np.concatenate(runs))
    met = np.unique(whole[1:][whole[1:] == whole[:-1]])
    return pa.table([rows.column("shard"), pa.array([run[_held_in(run, met)].tobytes() for run in runs], pa.binary())], names=["shard", "names"])


def _settled(offers: pa.Table, met: pa.Table) -> pa.Table:
    """(anchor, segment, n, first, last) of the offered starts whose names other shards hold."""
    known = np.sort(np.concatenate([np.zeros(0, np.uint64), *_names_of(met.column("names"))]))
    spans = []
    for i, (names, starts) in enumerate(zip(_names_of(offers.column("names")), offers.column("starts"))):
        starts = np.frombuffer(starts.as_buffer(), np.int32)
        spans += [(i, a, b) for a, b in spans_of(starts[_held_in(names, known)])]
    taken = offers.select(["anchor", "segment", "n"]).take(pa.array([x[0] for x in spans], pa.int64()))
    return taken.append_column("first", pa.array([x[1] for x in spans], pa.int32())).append_column("last", pa.array([x[2] for x in spans], pa.int32()))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, spans): for each row key of ``docs`` (doc_id, text, key) the ranges (from, to) of starts of repeated windows."""
    each = stash(segments(docs, length), "segments")
    place = F.struct("key", "at")
    distinct = each.groupBy("anchor", "segment", "n").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    per_anchor = distinct.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes")).where("all > 1")
    chosen = stash(distinct.join(per_anchor.drop("all"), "anchor"), "chosen")
    total = chosen.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    parts = F.ceil(F.col("kinds") / SPREAD_FROM)
    part = F.pmod(F.xxhash64("segment"), parts)
    chosen = chosen.select(
        F.col("place.key").alias("of"), F.struct(F.col("place.at").alias("at"), "n", "anchor", "segment", (F.col("copies") > 1).alias("many"), parts.alias("parts"),
        F.pmod(F.xxhash64("anchor", part), F.lit(shards)).alias("shard")).alias("s"),
    )
    lists = chosen.groupBy("of").agg(F.collect_list("s").alias("list"))

    def fetch(batches):
        names = ["at", "n", "anchor", "segment", "many", "parts", "shard"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        last = None
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
            raw = data.tobytes()
            rows, parts = [], []
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            for i, wanted in enumerate(batch.column(batch.schema.get_field_index("list")).to_pylist()):
                # Rows equal in doc_id and text have one key and come one after another.
                if keys[i] == last:
                    continue
                last = keys[i]
                for x in wanted:
                    begin = int(offsets[i]) + x["at"]
                    rows.append(x)
                    parts.append(raw[begin : begin + x["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([*[pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], pa.array(parts, pa.binary())], [*names, "bytes"])

    held = docs.join(lists, docs["key"] == lists["of"])
    fetched = held.mapInArrow(fetch, "at int, n int, anchor long, segment long, many boolean, parts long, shard long, bytes binary").drop("at")
    told = stash(fetched.groupBy("shard").applyInArrow(_shard(length), TOLD), "told")
    # A shard settles what repeats inside it; what it holds once is sure to be repeated if another shard offers it too.
    met = told.where("bucket is not null").select("bucket", "shard", "names").groupBy("bucket").applyInArrow(_merge, "shard long, names binary")
    offers = told.where("starts is not null").select("shard", "anchor", "segment", "n", "starts", "names")
    columns = "anchor long, segment long, n int, first int, last int"
    across = offers.groupBy("shard").cogroup(met.groupBy("shard")).applyInArrow(_settled, columns)
    found = told.where("first is not null").select("anchor", "segment", "n", "first", "last").union(across)
    where = each.join(found, ["anchor", "segment", "n"])
    span = F.struct((F.col("at") + F.col("first")).alias("from"), (F.col("at") + F.col("last")).alias("to"))
    return where.groupBy("key").agg(F.collect_set(span).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same text or another; overlaps count, and strings are
    judged on the input.  Matches never cross texts.  n_spans counts maximal removed runs.  Null and empty texts have no bytes; texts shorter
    than ``length`` stay whole; rows that repeat a text, with equal doc_id or not, repeat each other's strings.  Other columns are ignored.  No
    rows: no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
            raw = data.tobytes()
            removed, spans, kept = [], [], []
            for i, gone in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                left, end, n, total = [], 0, 0, 0
                for start, last in sorted((x["from"], x["to"] + length) for x in gone or ()):
                    if start > end or not n:
                        left.append(text[end:start])
                        n, total, end = n + 1, total + last - start, last
                    elif last > end:
                        total, end = total + last - end, last
                left.append(text[end:])
                removed.append(total)
                spans.append(n)
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    held = docs.join(repeated_spans(docs, length), "key", "left").select("doc_id", "text", "spans")
    return held.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
