"""Prefix trie of conversations: every shared beginning, who shares it and what a prefix cache saves.

Conversations become paths of 16-byte turn codes, sorted over the whole table and cut into blocks of neighbours.  Within a block the common
prefixes of neighbours (LCPs) stand in a sparse table for range minima; each candidate prefix, a row and a depth beyond its LCP, binary-searches
its left and right extent in that table by itself, which gives the interval of its members without a stack.  All figures of a node are sums
over its interval, so nodes that go on in the next block are added up by a hash of their prefix.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triagegrid.llm.tables import stash
from triagegrid.llm.textbytes import column_bytes

CODE_BYTES = 16
#: Turns and rows of a block; bounds the memory of a task (some 200 bytes a turn).
BLOCK_TURNS = 1 << 16
#: Conversation ids of a node that spans blocks travel in pieces of so many.
PIECE_IDS = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

BLOCK = "part int, seq int, rows binary, sizes binary, codes binary, lengths binary, lcp_in int, lcp_next int, first binary, last binary"
NODE = (
    "kind string, block long, ref long, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, parent_ref long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation as an array of (code, n_chars) in order of ``turn``, null first, ties by code.

    ``turns``: conv_id, turn, role, text; other columns are ignored.  A null role or text is empty; rows without conv_id take no part.
    A conversation is one row of some 50 bytes a turn, texts left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE_BYTES)
    one = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", code.alias("code"), F.length(text).cast("long").alias("n_chars")).alias("t"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def branched(convs: DataFrame, block: int, kept: Column, most: int) -> DataFrame:
    """Conversations rebuilt as branches: the first ``kept`` (at most ``most``) turns of the conversation at the head of a block of ids, then their own."""
    head = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    own = convs.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % block).withColumn("kept", kept.cast("int"))
    both = own.join(head, "head_id", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("kept")), F.slice("turns", F.col("kept") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", turns.alias("turns"))


def _lcps(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Common prefix, in turns, of each row with the row before; the first has -1."""
    size = np.diff(offsets)
    out = np.full(len(size), -1, np.int64)
    most = np.minimum(size[1:], size[:-1])
    out[1:] = most
    row = np.repeat(np.arange(1, len(size)), most)
    at = np.cumsum(most) - most
    k = np.arange(len(row)) - np.repeat(at, most)
    same = (codes[offsets[row] + k] == codes[offsets[row - 1] + k]).all(axis=1)
    full = np.flatnonzero(most)
    if len(full):
        out[1 + full] = np.minimum.reduceat(np.where(same, most[row - 1], k), at[full])
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // CODE_BYTES
    differ = (np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)).reshape(-1, 2).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks; a block waits for the next one of its task, to learn the LCP between them."""
    part, seq, held = TaskContext.get().partitionId(), 0, None
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *[(n, pa.binary()) for n in ("rows", "sizes", "codes", "lengths")], ("lcp_in", pa.int32()), ("lcp_next", pa.int32()), ("first", pa.binary()), ("last", pa.binary())])

    def made(row: dict, end: bool) -> pa.RecordBatch:
        row = row | {"first": row["first"] if row["seq"] == 0 else None, "last": row["last"] if end else None}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        data, at = column_bytes(batch.column("path"))
        lengths = batch.column("lengths")
        lengths = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = at // CODE_BYTES
        load = offsets + np.arange(len(offsets))
        start = 0
        while start < len(conv):
            end = min(max(int(np.searchsorted(load, load[start] + BLOCK_TURNS, side="right")) - 1, start + 1), len(conv))
            row = {
                "part": part, "seq": seq, "rows": conv[start:end].astype(np.int64).tobytes(), "sizes": np.diff(offsets[start : end + 1]).astype(np.int64).tobytes(),
                "codes": data[at[start] : at[end]].tobytes(), "lengths": lengths[offsets[start] : offsets[end]].tobytes(), "lcp_in": None, "lcp_next": None,
                "first": data[at[start] : at[start + 1]].tobytes(), "last": data[at[end - 1] : at[end]].tobytes(),
            }
            if held is not None:
                held["lcp_next"] = row["lcp_in"] = _common(held["last"], row["first"])
                yield made(held, False)
            held, seq, start = row, seq + 1, end
    if held is not None:
        yield made(held, True)


class Extents:
    """Sparse table of range minima over the LCPs of a block."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of each range, both ends included."""
        level = np.frexp(right - left + 1)[1] - 1
        out = np.empty(len(left), np.int64)
        for k, table in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
        return out

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row that shares ``depth`` turns with a row: widths are tried from the largest down."""
        pos = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = pos + (1 << k) < self.n
            inside[inside] = self.levels[k][pos[inside] + 1] >= depth[inside]
            pos[inside] += 1 << k
        return pos

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row that shares ``depth`` turns with a row."""
        pos = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = pos - (1 << k) >= 0
            inside[inside] = self.levels[k][pos[inside] - (1 << k) + 1] >= depth[inside]
            pos[inside] -= 1 << k
        return pos


def _prefix_keys(path: np.ndarray, depth: int) -> list[bytes]:
    """A hash of each of the first 0..depth turns of a path."""
    running, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(running.digest())
        if d < depth:
            running.update(path[d].tobytes())
    return out


def _block_nodes(block: dict) -> list[pa.RecordBatch]:
    """The nodes of a block.  ``kind``: node (its members end inside), part (it goes on in a neighbour), piece (ids that end at a part)."""
    conv, size = (np.frombuffer(block[c], np.int64) for c in ("rows", "sizes"))
    codes, length = np.frombuffer(block["codes"], np.uint64).reshape(-1, 2), np.frombuffer(block["lengths"], np.int64)
    n, offsets = len(conv), np.concatenate([[0], np.cumsum(size)])
    lcp_in, lcp_next = (-1 if block[c] is None else block[c] for c in ("lcp_in", "lcp_next"))
    lcp = _lcps(codes, offsets)
    chars = np.concatenate([[0], np.cumsum(length)])

    def before(row, depth):
        return chars[offsets[row] + depth] - chars[offsets[row]]

    # Candidates: every depth of a row beyond its LCP; those of the first row begin at the root.
    count = size - lcp
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - first[row] + lcp[row] + 1
    extents = Extents(lcp)
    left, right = extents.left(row, depth), extents.right(row, depth)
    above = np.maximum(depth - 1, 0)
    home = extents.left(row, above)
    parent = first[home] + above - (lcp[home] + 1)
    goes_left, goes_right = (left == 0) & (depth <= lcp_in), (right == n - 1) & (depth <= lcp_next)
    part = goes_left | goes_right

    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], lcp_next) < size)])
    shared = before(np.arange(n), np.maximum(lcp, 0))
    shared[0] = before(0, max(lcp_in, 0))
    sums = np.concatenate([[0], np.cumsum(shared)])
    known = before(row, above)
    members = right - left + 1
    again = members - 1 + goes_left
    saved = sums[right + 1] - sums[left + ~goes_left] - again * known
    children = np.bincount(parent[(depth > 0) & ~goes_left], minlength=len(row))
    smallest = Extents(conv).least(left, right)

    ends = np.array([NOTHING], object).repeat(len(row))
    same = np.zeros(n, bool)
    same[1:] = (lcp[1:] == size[1:]) & (size[1:] == size[:-1])
    begins = np.flatnonzero(~same)
    stops = np.append(begins[1:], n)
    pieces = []
    block_id = (block["part"] << 32) | block["seq"]
    keys = {0: _prefix_keys(codes[: offsets[1]], max(lcp_in, 0)), 1: _prefix_keys(codes[offsets[n - 1] :], max(lcp_next, 0))}
    side = np.where(goes_left, 0, 1)
    # A sequence whose node began in an earlier row has no candidate of its own here; it cannot, as equal rows are one run.
    for a, b in zip(begins.tolist(), stops.tolist()):
        node = first[a] + size[a] - (lcp[a] + 1)
        if part[node]:
            for at in range(a, b, PIECE_IDS):
                ids = conv[at : min(b, at + PIECE_IDS)]
                pieces.append((int(ids[0]), keys[side[node]][size[a]], ",".join(map(str, ids.tolist())).encode()))
        else:
            ends[node] = hashlib.sha256(",".join(map(str, conv[a:b].tolist())).encode()).hexdigest()

    def column(name, kind, values, rows):
        return pa.array([None] * rows, kind) if values is None else pa.array(values, kind)

    kinds = {"kind": pa.string(), "ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.binary()}
    names = [c.split()[0] for c in NODE.split(", ")]

    def batch(rows, **values):
        return pa.RecordBatch.from_arrays([column(c, kinds.get(c, pa.int64()), values.get(c), rows) for c in names], names)

    ref = depth * 2 + side
    out = []
    for kind, at in (("node", np.flatnonzero(~part)), ("part", np.flatnonzero(part))):
        up = parent[at]
        open_up = part[up]
        more = {}
        if kind == "part":
            own = [keys[s] for s in side[at]]
            more = {"ref": ref[at], "key": [k[d] for k, d in zip(own, depth[at])], "parent_key": [k[d - 1] if d else None for k, d in zip(own, depth[at])]}
        else:
            none = (depth[at] == 0) | open_up
            more = {
                "parent_conv_id": pa.array(smallest[up], mask=none), "parent_ref": pa.array(ref[up], mask=~open_up | (depth[at] == 0)), "ends_sha256": ends[at],
            }
        if len(at):
            out.append(batch(
                len(at), kind=[kind] * len(at), block=np.full(len(at), block_id), depth=depth[at], conv_id=smallest[at], n_convs=members[at],
                n_children=children[at], n_leaves=leaf[right[at] + 1] - leaf[left[at]], saved_tokens=saved[at], **more,
            ))
    for smallest_id, key, text in pieces:
        out.append(batch(1, kind=["piece"], block=[block_id], conv_id=[smallest_id], key=[key], ends=[text]))
    return out


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key, from its pieces as they stream by in order."""
    key, running = None, None
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for now, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if now != key:
                if key is not None:
                    done.append({"key": key, "ends_sha256": running.hexdigest()})
                key, running = now, hashlib.sha256(text)
            else:
                running.update(b"," + text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": running.hexdigest()}], schema)


def _seams(blocks: DataFrame) -> DataFrame:
    """(part, seam_in, seam_next): the LCPs of a task's first and last row with the tasks before and behind; one short row a task."""
    ends = blocks.where("first is not null or last is not null").groupBy("part").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    order = W.orderBy("part")
    pairs = ends.select("part", "first", "last", F.lag("last").over(order).alias("above"))

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [None if a is None else _common(a, b) for a, b in zip(batch.column("above").to_pylist(), batch.column("first").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(found, pa.int32())], ["part", "seam_in"])

    return pairs.mapInArrow(work, "part int, seam_in int").withColumn("seam_next", F.lead("seam_in").over(order))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``convs`` (conv_id long, turns array of (code, n_chars), see ``sequences``).

    conv_id: smallest member; depth; parent_conv_id: smallest member of the prefix one turn shorter (root: null); n_convs: members;
    n_children; n_leaves: childless nodes below, itself included; saved_tokens: over the nodes below, itself included, members but one times the
    characters of the last turn; ends_sha256: of the ids of members that end there, ascending, comma-joined.  No conversations: no rows.
    """
    code = F.transform("turns", lambda t: t["code"])
    paths = convs.select("conv_id", F.unhex(F.array_join(code, "")).alias("path"), F.transform("turns", lambda t: t["n_chars"]).alias("lengths"))
    ordered = stash(paths, "paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    blocks = stash(ordered.mapInArrow(_blocks, BLOCK), "path-blocks")
    # Broadcast: a part number and two LCPs for each task of the sort.
    seams = F.broadcast(_seams(blocks))
    whole = blocks.join(seams, "part").select(
        "part", "seq", "rows", "sizes", "codes", "lengths", F.coalesce("lcp_in", F.when(F.col("seq") == 0, F.col("seam_in"))).alias("lcp_in"),
        F.coalesce("lcp_next", F.when(F.col("last").isNotNull(), F.col("seam_next"))).alias("lcp_next"),
    )

    def nodes(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block in batch.to_pylist():
                yield from _block_nodes(block)

    found = stash(whole.mapInArrow(nodes, NODE), "trie")
    parts = found.where("kind = 'part'")
    figures = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *figures)
    pieces = found.where("kind = 'piece'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    digests = pieces.mapInArrow(_joined_ends, "key binary, ends_sha256 string")
    merged = stash(merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie-spanning")
    ids = merged.select("key", F.col("conv_id").alias("open_conv_id"))
    spanning = merged.join(ids.withColumnRenamed("key", "parent_key").withColumnRenamed("open_conv_id", "parent_conv_id"), "parent_key", "left")
    # The open parents of a block's nodes are named by block, so that a prefix many nodes hang on is as many keys as blocks.
    names = parts.select("key", "block", F.col("ref").alias("parent_ref")).join(ids, "key").drop("key")
    own = found.where("kind = 'node'")
    hung = own.where("parent_ref is not null").drop("parent_conv_id").join(names, ["block", "parent_ref"]).withColumnRenamed("open_conv_id", "parent_conv_id")
    return own.where("parent_ref is null").select(OUT).union(hung.select(OUT)).union(spanning.select(OUT))
