"""Target-distribution importance resampling: the documents most like a target, by a draw without replacement.

Bags of hashed word runs of the corpus and of the target give each bucket a gain, an array of fixed length that scores whole texts.  Gumbel noise
from the id turns scores into a draw: the largest are the sample.  Ranks come from a distributed radix sort, least digit first: each pass
counts digits per block of neighbours, prefix offsets over (digit, block) give every row its place, and the next pass reads the rows in that order.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import stash

#: Buckets of word runs, and the longest run.
BUCKETS, LONGEST = 10_000, 3
SLICE_BYTES = 1 << 20
#: Bits of a digit of the radix sort.
DIGIT_BITS = 12
#: Rows of a block of the sort; it grows beyond ``BLOCKS`` blocks, so that a digit's offsets stay a short list.
LEAST_BLOCK, BLOCKS = 256, 1 << 16

# CRC-32 tables: of a byte, and of the register moved on by 2^k zero bytes, for each byte of the register.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _doubled(table: np.ndarray) -> np.ndarray:
    """The move by twice as many bytes."""
    return np.stack([_apply(table, row) for row in table])


_one = np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
_MOVES = [(_CRC[_one & 255] ^ (_one >> 8)).astype(np.uint32)]
for _ in range(31):
    _MOVES.append(_doubled(_MOVES[-1]))
#: Moves by 0..63 bytes: what most words need is one step.
_SHORT = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
for _ in range(63):
    _SHORT.append(np.stack([_apply(_MOVES[0], row) for row in _SHORT[-1]]))
_SHORT = np.stack(_SHORT)


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as if ``n`` zero bytes had followed, without the conditioning at both ends."""
    low = n & 63
    flat = _SHORT.reshape(-1)
    at = low * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    for k in range(6, int(n.max(initial=0)).bit_length()):
        far = np.flatnonzero((n >> k) & 1)
        out[far] = _apply(_MOVES[k], out[far])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each word: byte by byte over all words, long ones by themselves."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(size, kind="stable")
    begins = np.searchsorted(size[order], np.arange(64), side="right")
    for j in range(min(int(size.max(initial=0)), 64)):
        at = order[begins[j] :]
        out[at] = _CRC[(out[at] ^ data[starts[at] + j]) & 255] ^ (out[at] >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every run of one to three words of the rows' lower-cased bytes, and each row's number of words."""
    starts, ends, row = tb.words(data, offsets, tb.ALNUM)
    crc, size = word_crcs(data, starts, ends), ends - starts
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    buckets, rows, run = [crc], [row], crc
    for k in range(1, LONGEST):
        if len(row) <= k:
            break
        # crc(left + " " + word) from the parts: the left side moved on by their bytes.
        left = moved(run[:-1], one.repeat(len(run) - 1)) ^ space
        run = moved(left, size[k:]) ^ crc[k:]
        inside = row[k:] == row[:-k]
        buckets.append(run[inside])
        rows.append(row[k:][inside])
    return (np.concatenate(buckets) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(rows), np.bincount(row, minlength=len(offsets) - 1)


def feature_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): word runs of the column ``text``; each task adds up its own rows first.  A null text has none."""

    def work(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(BUCKETS, np.int64)
        for batch in tb.slices(batches, "text", SLICE_BYTES):
            data, offsets = tb.column_bytes(batch.column("text"))
            total += np.bincount(features(tb.LOWER[data], offsets)[0], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of each bucket in thousandths: the log of its smoothed share of the target over that of the corpus.  ``BUCKETS`` numbers reach the driver."""
    n = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for into, texts in zip(n, (corpus, target)):
        for bucket, count in feature_counts(texts).collect():
            into[bucket] = count
    s, t = (x.astype(np.float64) for x in n)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def text_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over all word runs of a text; a text without words weighs 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches, "text", SLICE_BYTES):
            data, offsets = tb.column_bytes(batch.column("text"))
            bucket, row, n_words = features(tb.LOWER[data], offsets)
            n = np.bincount(row, minlength=batch.num_rows)
            order = np.argsort(row, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (n_words, n, sums[at[1:]] - sums[at[:-1]])]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def _steps(rows: DataFrame, keys: list[str]) -> tuple[int, list[tuple[str, int, int, int]]]:
    """Number of rows, and the digits in which they differ at all, least first: (key, smallest value, largest, shift)."""
    ends = rows.agg(F.count("*"), *[f(F.col(k)) for k in keys for f in (F.min, F.max)]).first()
    steps = []
    for i in reversed(range(len(keys))):
        low, high = ends[1 + 2 * i], ends[2 + 2 * i]
        if low is not None:
            steps += [(keys[i], low, high, shift) for shift in range(0, (high - low).bit_length(), DIGIT_BITS)]
    return ends[0], steps


def _far_digit(key: Column, low: int, shift: int) -> Column:
    """The bits from ``shift`` on of a difference that may not fit a long: long division in halves of 32 bits."""
    difference = key.cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")
    upper = F.floor(difference / F.lit("4294967296").cast("decimal(20,0)")).cast("long")
    lower = (difference - upper.cast("decimal(20,0)") * F.lit("4294967296").cast("decimal(20,0)")).cast("long")
    return F.shiftright(upper, shift - 32) if shift >= 32 else F.shiftright(upper.bitwiseAND((1 << shift) - 1 if shift else 0) * (1 << 32) + lower, shift)


def radix_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2... in ascending order of the columns ``keys`` (long, no nulls), equal rows in any order.

    A pass for each digit in which the keys differ.  A pass cuts the rows in their present order into blocks, counts each digit per block, and adds the
    counts up in order of (digit, block): a row's new place is its pair's offset and its turn within the pair, so the pass keeps the order
    of equal digits.  No task holds more than the rows of a block that share a digit.  Each pass is written to the shared folder.
    """
    names = rows.columns
    held = stash(rows.withColumn("place", F.monotonically_increasing_id()), "radix")
    n, steps = _steps(held, keys)
    block_rows = max(LEAST_BLOCK, -(-n // BLOCKS))
    # The first order is that of the file: partition number and row, which leaves gaps between partitions.
    block = ((F.shiftright("place", 33) * ((1 << 33) // block_rows + 1)) + F.expr("place & 8589934591") / F.lit(block_rows)).cast("long")
    for key, low, high, shift in steps or [(keys[0], 0, 0, 0)]:
        digit = F.shiftright(F.col(key) - F.lit(low), shift) if high - low < 1 << 63 else _far_digit(F.col(key), low, shift)
        digit = digit.bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
        now = held.withColumn("__digit", digit).withColumn("__block", block)
        counts = now.groupBy("__digit", "__block").agg(F.count("*").alias("__n"))
        totals = counts.groupBy("__digit").agg(F.sum("__n").alias("__total"))
        # One row per digit, 4096 at most, in one task; then the blocks of a digit, ``BLOCKS`` and the writers' tasks at most, in one.
        below = totals.select("__digit", (F.sum("__total").over(W.orderBy("__digit")) - F.col("__total")).alias("__below"))
        within = F.sum("__n").over(W.partitionBy("__digit").orderBy("__block")) - F.col("__n")
        offsets = counts.withColumn("__before", within).join(F.broadcast(below), "__digit").select("__digit", "__block", (F.col("__before") + F.col("__below")).alias("__offset"))
        turn = F.row_number().over(W.partitionBy("__digit", "__block").orderBy("place")) - 1
        placed = now.withColumn("__turn", turn).join(offsets.hint("merge"), ["__digit", "__block"])
        held = stash(placed.select(*names, (F.col("__offset") + F.col("__turn")).alias("place")), "radix")
        block = F.floor(F.col("place") / block_rows)
    return held


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, seed: str = "42") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per document, all drawn without replacement by importance.

    ``docs``: doc_id (any integer type), text; ``target``: text; other columns are ignored.  Of the N documents of ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the smaller doc_id, null last; the others' rank is null.
    A null text has no words.  Repeated rows each stand for themselves.  No target texts: gains compare with an even spread.
    """
    gains = bucket_gains(docs, target)
    scored = text_weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gains)
    scored = stash(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    rows = scored.where(F.col("n_words") >= least_words)
    # Ascending in (minus score, null last, id).
    keys = {"__score": -F.col("score"), "__none": F.col("doc_id").isNull().cast("long"), "__id": F.coalesce("doc_id", F.lit(0)).cast("long")}
    placed = radix_ranks(rows.withColumns(keys), list(keys))
    drawn = placed.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).union(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
