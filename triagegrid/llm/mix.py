"""Mixing sources to target weights.

The words of each source, document by document, form one stream that is packed into blocks of ``block_words``.  Output slots are dealt
to shards; each shard draws how many of its slots every source fills (multinomial, without exceeding what is left of the source's target).
The n-th slot of a source takes the block that a pseudorandom permutation of the source's block numbers gives for n; every
pass over a source has a permutation of its own, so no block is taken an (e+1)-th time before all were taken e times.  Slots and
blocks are joined by block number.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import stash

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 65536
BUCKET_ROWS = 2000
#: Rounds of the permutation's network.
ROUNDS = 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> list[dict]:
    """Targets in words for (source, size): a share of all words by weight, at most ``most`` times the source, the excess reshared.

    One row for each source reaches the driver.
    """
    rows = sorted((r.asDict() for r in sizes.collect()), key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    total = float(sum(r["size"] for r in rows))
    open_rows, left = [], total
    for i, r in enumerate(rows):
        r["weight"], r["target"] = weights[i % len(weights)], 0.0
        open_rows.append(r)
    while open_rows:
        weight = sum(r["weight"] for r in open_rows)
        over = [r for r in open_rows if left * r["weight"] / weight > most * r["size"]]
        if not over:
            for r in open_rows:
                r["target"] = left * r["weight"] / weight
            break
        for r in over:
            r["target"] = float(most * r["size"])
        open_rows = [r for r in open_rows if not any(r is o for o in over)]
        left = total - sum(r["target"] for r in rows if not any(r is o for o in open_rows))
    return rows


def shard_counts(quotas: np.ndarray, shard_slots: int, seed: int) -> list[np.ndarray]:
    """For each output shard, the slots of every source: multinomial draws by what is left, summing to the quotas."""
    rng = np.random.default_rng(seed)
    left, out = quotas.astype(np.int64).copy(), []
    while left.sum() > 0:
        slots = int(min(shard_slots, left.sum()))
        drawn = np.zeros_like(left)
        while (need := slots - int(drawn.sum())) > 0:
            room = left - drawn
            drawn += np.minimum(rng.multinomial(need, room / room.sum()), room)
        left -= drawn
        out.append(drawn)
    return out


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..size-1 sends each number: a Feistel network, walked until inside the range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    outside = np.ones(len(out), bool)
    while outside.any():
        left, right = out[outside] >> half, out[outside] & mask
        for turn in range(ROUNDS):
            salt = tb.mixed(np.array([(key * ROUNDS + turn) & (1 << 64) - 1], np.uint64))
            left, right = right, left ^ (tb.mixed(right ^ salt) & mask)
        out[outside] = (left << half) | right
        outside = out >= np.uint64(size)
    return out.astype(np.int64)


def _slots(draws: DataFrame, seed: int) -> DataFrame:
    """(shard, slot, source_no, pass, block) of draws (shard, source_no, first, n, blocks, slot): where every slot's block comes from."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number = np.arange(row["first"], row["first"] + row["n"])
                turn, inside = number // row["blocks"], number % row["blocks"]
                block = np.empty(len(number), np.int64)
                for e in np.unique(turn):
                    own = turn == e
                    block[own] = permuted(inside[own], row["blocks"], (seed * 1_000_003 + row["source_no"]) * 64 + int(e))
                n = len(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["shard"])), pa.array(row["slot"] + np.arange(n)), pa.array(np.full(n, row["source_no"])), pa.array(turn), pa.array(block)],
                    ["shard", "slot", "source_no", "pass", "block"],
                )

    return draws.mapInArrow(deal, "shard long, slot long, source_no long, pass long, block long")


def _pieces(docs: DataFrame, block_words: int, with_text: bool) -> DataFrame:
    """(source_no, block, doc_id, from_word, n_words[, text]): the part of each document that lies in each block.

    ``docs``: source_no, doc_id, start (words of the source before the document), size[, text].
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not with_text:
        last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
        each = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
        begin = F.greatest("start", F.col("block") * block_words)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
        return each.select("source_no", "block", "doc_id", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"))

    def cut(batches):
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
            begins, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
            start = batch.column(batch.schema.get_field_index("start")).to_numpy()
            at = tb.runs(row, batch.num_rows)
            place = np.arange(len(row)) - at[row]
            block = (start[row] + place) // block_words
            edge = np.ones(len(row), bool)
            edge[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(edge)
            behind = np.append(first[1:], len(row))
            raw = data.tobytes()
            texts = pa.array([raw[begins[a] : ends[b - 1]] for a, b in zip(first, behind)], pa.binary()).cast(pa.string())
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_no").take(take), pa.array(block[first]), batch.column("doc_id").take(take), pa.array(place[first]), pa.array(behind - first), texts],
                ["source_no", "block", "doc_id", "from_word", "n_words", "text"],
            )

    docs = docs.select("source_no", "doc_id", "start", "text")
    return docs.mapInArrow(cut, f"source_no long, block long, doc_id {kind}, from_word long, n_words long, text string")


def mix(docs: DataFrame, with_text: bool = False, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(pieces, sources): the mixed stream and what was aimed at.

    ``pieces``: shard, slot, source, pass, block, doc_id, from_word, n_words and, on request, text: shard by shard and slot by slot the parts of
    documents that fill the slot's block.  ``sources``: source, source_size, target.  A null source is one source, the last; null,
    empty and wordless texts take no part; repeated rows and ids are documents of their own.  Reruns agree.  Other columns are ignored; no words: no pieces.
    """
    spark = docs.sparkSession
    text = ["text"] if with_text else []
    sized = docs.select("doc_id", "source", *text, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    if not with_text:
        sized = stash(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = source_targets(totals)
    for no, r in enumerate(rows):
        r["source_no"], r["blocks"] = no, -(-r["size"] // block_words)
        # Blocks are full but for the last, so the mean block is what a slot brings.
        r["quota"] = min(round(r["target"] * r["blocks"] / r["size"]), MOST_PASSES * r["blocks"]) if r["size"] else 0
        r["buckets"] = -(-r["n"] // BUCKET_ROWS)
    schema = "source string, source_no long, source_size long, target double, blocks long, buckets long"
    plain = [(r["source"], r["source_no"], r["size"], r["target"], r["blocks"], r["buckets"]) for r in rows]
    sources = spark.createDataFrame(plain, schema)

    held = sized.join(sources.select(F.col("source").alias("name"), "source_no", "buckets"), F.col("source").eqNullSafe(F.col("name")))
    held = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), "buckets"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = held.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    by_bucket = by_bucket.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(by_bucket, ["source_no", "bucket"])
    pieces = _pieces(held.withColumn("start", F.col("ahead") + F.col("inside")), block_words, with_text)

    draws, first = [], np.zeros(len(rows), np.int64)
    for shard, counts in enumerate(shard_counts(np.array([r["quota"] for r in rows], np.int64), shard_slots, seed)):
        slot = 0
        for no in np.flatnonzero(counts):
            draws.append((shard, int(no), int(first[no]), int(counts[no]), rows[no]["blocks"], slot))
            slot += int(counts[no])
        first += counts
    draws = spark.createDataFrame(draws, "shard long, source_no long, first long, n long, blocks long, slot long")
    slots = _slots(draws.repartition(spark.sparkContext.defaultParallelism, "shard", "source_no"), seed)
    # The planner takes what the slots grow from for their size; without the hint it would broadcast them.
    mixed = slots.hint("merge").join(pieces, ["source_no", "block"]).join(sources.select("source_no", "source"), "source_no")
    columns = ["shard", "slot", "source", "pass", "block", "doc_id", "from_word", "n_words", *text]
    return mixed.select(columns), sources.select("source", "source_size", "target")


def words_taken(docs: DataFrame, pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target and the words the mix takes of it.

    Rows that repeat a doc_id share their words taken evenly by size."""
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = pieces.groupBy("doc_id").agg(F.sum("n_words").alias("all_taken"))
    many = base.groupBy("doc_id").agg(F.sum("size").alias("all_size"))
    many = many.join(taken, many["doc_id"].eqNullSafe(taken["doc_id"]), "left").select(many["doc_id"].alias("id"), "all_size", "all_taken")
    named = sources.select(F.col("source").alias("name"), "source_size", "target")
    held = base.join(many, F.col("doc_id").eqNullSafe(F.col("id"))).join(named, F.col("source").eqNullSafe(F.col("name")))
    own = F.when(F.col("size") == F.col("all_size"), F.col("all_taken")).otherwise(F.floor(F.col("all_taken") * F.col("size") / F.col("all_size")))
    return held.select("doc_id", "size", "source_size", "target", F.coalesce(own, F.lit(0)).cast("long").alias("taken"))
