"""Vectorised work on the UTF-8 bytes of Arrow text columns: words, hashes, shingles."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Text of a slice: arrays of 8 bytes for each byte of it, a dozen at a time, stay within some 50 MB.
SLICE_BYTES = 512 << 10

#: Bytes of a word: everything but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(table: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    if len(table) < n:
        steps = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; a null has none."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text, or one row.

    So memory is some hundred times ``limit``, or the longest text if that is longer.
    """
    for batch in batches:
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: those of a substring follow from two entries (see ``span_hash``)."""
    global _powers
    _powers = _grown(_powers, BASE, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to each end; equal bytes have equal hashes wherever they stand."""
    global _inverses
    _inverses = _grown(_inverses, BASE_INVERSE, len(prefix) + 1)
    return mixed((prefix[ends] - prefix[starts]) * _inverses[starts])


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind the last, row) of every maximal run of bytes of a kind, never across rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kind[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the rows 0..n-1 in a sorted array of row numbers."""
    return np.searchsorted(values, np.arange(n + 1))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * STEP + hashes[j : j + n]
    return mixed(total)


def word_shingles(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``k``-word shingle; a row of fewer words, but not none, has one over all its words."""
    starts, ends, row = words(data, offsets, kind)
    hashes = span_hash(prefix_hash(data), starts, ends)
    whole = rolled(hashes, k)
    full = row[: len(whole)] == row[k - 1 :] if len(whole) else np.zeros(0, bool)
    rows, out = row[: len(whole)][full], whole[full]
    count = np.bincount(row, minlength=len(offsets) - 1)
    at = runs(row, len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = [rolled(hashes[at[i] : at[i + 1]], int(count[i]))[0] for i in short]
        rows, out = np.concatenate([rows, short]), np.concatenate([out, np.array(extra, np.uint64)])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, sorted."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]
