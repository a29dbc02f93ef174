"""Fingerprints: the walk step by step, edited texts and their neighbours, bands and verification."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagegrid.llm import edit_print as ep
from triagegrid.llm import queries

SCHEMA = "doc_id long, text string, stretch int, near_next string"
TEXTS = {3: "the first text, of some length " * 5, 5: None, 8: "", 13: "x", 14: "é€𝄞 and more", 21: "word " * 20000, 22: "word " * 20000, None: "no id"}


def stepped(text, steps):
    """The index read at each step, one step at a time."""
    at, index, out = [], 0, {}
    points = [ord(c) for c in text]
    for step in range(max(steps, default=0) + 1):
        if index == len(points):
            break
        out[step] = index
        number = (((points[index] * 2654435761) % (1 << 32)) >> 16) % ep.CLASSES
        moves = ep._LANDING[number * ep.PERIOD + step % ep.PERIOD] == (step + 1) % ep.PERIOD
        index += moves
    return [out.get(s, -1) for s in steps]


def slots_of(text):
    steps = ep.sampled_steps(len(text))
    return ep._print(ep._points(text), steps, np.array(stepped(text, steps.tolist())))


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa" * 300, "Zwölf Boxkämpfer 𝄞 " * 40])
def test_walk_reads_what_single_steps_read(text):
    assert (ep.prints(text)[0] == slots_of(text)).all()


def test_long_texts_are_walked_in_stretches(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ghijk") for _ in range(5000))
    whole = ep.prints(text)[0]
    monkeypatch.setattr(ep, "STRETCH", 700)
    assert (ep.prints(text)[0] == whole).all() and (whole == slots_of(text)).all()


def test_steps_are_samples_that_lengths_share():
    for n in (1, 10, 1000, 10**6, 10**9):
        assert (ep.sampled_steps(n) < 2 * n).all()
    spread = ep.sampled_steps(100000)
    assert np.unique(spread).size > 120 and 60000 < np.median(spread) < 140000
    assert (ep.sampled_steps(100000) == ep.sampled_steps(103000)).mean() > 0.9


def test_likeness_follows_edits():
    rng = random.Random(1)
    near = {}
    for edits in (1, 10, 40, 400):
        found = []
        for _ in range(10):
            text = [rng.choice("etaoin shrdlu") for _ in range(4000)]
            other = list(text)
            for _ in range(edits):
                i = rng.randrange(len(other))
                other[i : i + rng.randrange(2)] = rng.choice("xyz") * rng.randrange(3)
            found.append(float(ep._likeness(ep.prints("".join(text))[0], ep.prints("".join(other))[0])))
        near[edits] = np.mean(found)
    assert near[1] > 0.95 and near[10] > 0.8 and near[1] > near[10] > near[40] > near[400]
    strangers = [float(ep._likeness(ep.prints("".join(rng.choice("etaoin") for _ in range(3000)))[0], ep.prints("".join(rng.choice("etaoin") for _ in range(3000)))[0])) for _ in range(10)]
    assert np.mean(strangers) < 0.1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        kept = len(text) - len(text) // 2
        edited = text[:kept] + after[: len(text) // 2]
        a, b, c = map(slots_of, (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), ep._hex(a), ep._hex(b), float(ep._likeness(a, b)), float(ep._likeness(a, c)),
                    int((ep._bands(a[None]) == ep._bands(b[None])).sum()), int((ep._bands(a[None]) == ep._bands(c[None])).sum())))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_neighbours_over_stretches(spark, monkeypatch, least):
    monkeypatch.setattr(ep, "LEAST_ROWS", least)
    rng = random.Random(least)
    rows = [(i * i % 997 - 50, "".join(rng.choice("abc de") for _ in range(rng.randint(0, 90))), 1, "x") for i in range(40)]
    rows += [(k, (t or "")[:3000] if t is not None else None, 0, None) for k, t in TEXTS.items()] + [rows[3], rows[3], (None, "other", 0, "")]
    got = ep.edited_prints(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(9, "alone in its table", 0, "")]
    assert [tuple(r) for r in ep.edited_prints(spark.createDataFrame(rows, SCHEMA)).collect()] == brute(rows)
    assert ep.edited_prints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_propose_and_fingerprints_verify(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(2500))
        rows += [(i * 10, text), (i * 10 + 1, text[:700] + "!" + text[701:]), (i * 10 + 2, text), (i * 10 + 3, text[: 100 + 40 * i] + text[2000:])]
    rows += [(None, rows[0][1]), (5000, None)]
    prints = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", ep.fingerprint(F.col("text")))
    got = {(r.query_id, r.doc_id): r.likeness for r in ep.banded_matches(prints.where("doc_id % 20 = 0"), prints, 0.8).collect()}
    held = {r.doc_id: r.fingerprint for r in prints.where("doc_id is not null").collect()}
    slots = {k: ep._slots([v])[0] for k, v in held.items()}
    want = {(a, b): float(ep._likeness(slots[a], slots[b])) for a in slots if a % 20 == 0 for b in slots if a != b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want)
    assert all((i, i + 1) in got and (i, i + 2) in got for i in range(0, 400, 20))
    assert prints.select(ep.likeness(F.col("fingerprint"), F.lit(None).cast("string")).alias("n")).first().n is None


def test_query_tells_edited_from_next(spark):
    got = queries.op13_edit_print(spark, "/root/testdata/sf0.01").where("n_chars >= 100").collect()
    edited, following = (np.array([r[c] for r in got]) for c in ("near_edited", "near_next"))
    assert len(got) > 500 and np.mean(edited > following) > 0.95 and edited.mean() > 0.35 and following.mean() < 0.1
