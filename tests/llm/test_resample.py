"""Importance resampling: word runs, radix ranks and the draw against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import ALNUM_WORD, lower
from pyspark.sql import functions as F

from triagegrid.llm import resample
from triagegrid.llm import textbytes as tb

TEXTS = ["Hello World foo", None, "", "a", "x" * 200 + " b " + "y" * 64 + " é ÑANDÚ, Zz", "one two three four " * 9, "\x00\x01", "w" * 5000, "0 1 2 3 4 5 6 7 8 9 " * 300]


def runs_of(text):
    w = ALNUM_WORD.findall(lower(text))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent, least):
    def bucket(x):
        return zlib.crc32(x.encode()) % 10000

    s = Counter(bucket(g) for _, t in rows for g in runs_of(t)[1])
    t = Counter(bucket(g) for x in target for g in runs_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out, drawable = [], []
    for i, (doc, text) in enumerate(rows):
        words, grams = runs_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, grams))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(grams), weight, score, None])
        if len(words) >= least:
            drawable.append((-score, doc is None, doc or 0, i))
    for rank, (*_, i) in enumerate(sorted(drawable)[: percent * len(drawable) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def test_features_are_the_crcs_of_all_runs():
    data, offsets = tb.column_bytes(pa.array(TEXTS))
    bucket, row, n_words = resample.features(tb.LOWER[data], offsets)
    want = Counter((i, zlib.crc32(g.encode()) % 10000) for i, t in enumerate(TEXTS) for g in runs_of(t)[1])
    assert Counter(zip(row.tolist(), bucket.tolist())) == want
    assert n_words.tolist() == [len(runs_of(t)[0]) for t in TEXTS]


@pytest.mark.parametrize("percent, least", [(5, 20), (40, 1), (100, 0), (0, 20)])
def test_draw_matches_plain_python(spark, percent, least):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Übung"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += list(enumerate(TEXTS, 300)) + [(None, "no id " * 20), (None, "no id " * 20), (7, rows[7][1]), (-5, "below zero " * 15)]
    target = [" ".join(vocabulary[:10]), None, "", "w1 w2 w3 w1"]
    docs = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, score int, place int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, goal, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, percent, least)


def test_no_documents_and_no_target(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id int, text string")
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none, 5).count() == 0
    assert [tuple(r) for r in resample.resample(docs, none, 100, 1).collect()] == brute([(1, "some words here")], [], 100, 1)


@pytest.mark.parametrize("low, high", [(0, 3), (-5000, 5000), (-(1 << 63), (1 << 63) - 1), (0, (1 << 62) + 5)])
def test_radix_places_are_the_order_of_the_keys(spark, monkeypatch, low, high):
    """Blocks of a few rows: most passes meet many blocks; and one block for all."""
    rng = random.Random(low)
    rows = [(rng.choice([low, high, rng.randint(low, high)]), rng.randint(0, 5), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "a long, b long, i long").repartition(3)
    for block, blocks in ((8, 1 << 16), (1 << 20, 1 << 16), (1, 10)):
        monkeypatch.setattr(resample, "LEAST_BLOCK", block)
        monkeypatch.setattr(resample, "BLOCKS", blocks)
        got = sorted(resample.radix_ranks(frame, ["a", "b"]).collect(), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(400)) and {r.i for r in got} == set(range(400))
        assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in rows)


def test_noise_is_gumbel(spark):
    got = [r[0] for r in spark.range(5000).select(resample.noise(F.col("id"), "42")).collect()]
    assert abs(np.mean(got) - 577) < 60 and abs(np.std(got) - 1282) < 80
    assert re.fullmatch("long|bigint", spark.range(1).select(resample.noise(F.col("id"), "1").alias("n")).schema["n"].dataType.simpleString())
