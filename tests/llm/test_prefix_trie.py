"""The prefix trie against a plain dictionary of prefixes, in one block and in many."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagegrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows, block=100, most=5):
    """Rows of the trie from (conv_id, turn, role, text, ...) rows with different turn numbers in each conversation."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = own.get(c - c % block, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    convs = prefix_trie.sequences(turns)
    kept = F.crc32(F.col("conv_id").cast("string")) % 6
    got = prefix_trie.prefix_trie(prefix_trie.branched(convs, 100, kept, 5))
    assert got.columns == prefix_trie.OUT
    return sorted((tuple(r) for r in got.collect()), key=str)


def made_up(seed, n):
    """Few texts, so that many conversations share their beginnings; some are equal, one is long, ids leave gaps."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 1000), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 60 if c % 50 == 0 else 4])):
            rows.append((c, t if t else None, rng.choice(["user", None, "assistant"]), rng.choice(["ein", "zwei Wörter", "", None]), 1))
    return rows


@pytest.mark.parametrize("seed, n, batch", [(1, 60, 10000), (2, 80, 7), (3, 80, 1)])
def test_trie_matches_plain_prefixes(spark, seed, n, batch):
    """Small batches make many blocks, seven partitions many tasks, so prefixes go on over seams of both kinds."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": 7 if batch < 100 else 1}
    held = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        rows = made_up(seed, n)
        assert found(spark, rows) == brute(rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_one_hot_conversation_over_many_blocks(spark):
    """Most conversations are equal: one node ends in all blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(c * 100, t, "user", f"turn {t}", 0) for c in range(90) for t in range(3)] + [(7, 0, "user", "turn 0", 0), (9999, 0, None, None, 0)]
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_turnless_rows_and_no_rows(spark):
    rows = [(100, 0, "user", "a", 0), (205, 0, "user", "gone unless its head keeps none", 0), (None, 0, "user", "x", 0), (-3, 1, "user", "é" * 5000, 0)]
    assert found(spark, rows) == brute(rows, 100)
    assert found(spark, []) == []


def test_repeated_turns_are_ordered_by_what_they_say(spark):
    rows = [(1, 0, "user", x, 0) for x in ("b", "a", "a")]
    one = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))).collect()
    two = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame(rows[::-1], SCHEMA))).collect()
    assert sorted(one) == sorted(two) and max(r.depth for r in one) == 3


def test_extents_are_the_widest_runs():
    rng = np.random.default_rng(0)
    lcp = rng.integers(0, 4, 50)
    lcp[0] = -1
    extents = prefix_trie.Extents(lcp)
    row, depth = np.divmod(np.arange(250), 5)
    left, right = extents.left(row, depth), extents.right(row, depth)
    for i, d, a, b in zip(row, depth, left, right):
        assert all(x >= d for x in lcp[a + 1 : b + 1]) and (a == 0 or lcp[a] < d) and (b == 49 or lcp[b + 1] < d) and a <= i <= b
