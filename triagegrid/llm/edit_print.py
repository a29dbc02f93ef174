"""Document fingerprints: a randomised edit embedding, sampled.

A walk over the characters of a text, with random steps that all texts share, stays on a character or moves to the next.  Two texts that differ
by an edit fall into step again soon behind it, so what their walks read agrees at most steps: edit distance becomes Hamming distance.  A
fingerprint holds what the walk reads at sampled steps.  Texts of nearly the same length sample nearly the same steps: slot m takes the step of
least random priority among the first 2n, and those minima are a short list of records.  Bands of slots, sampled alike for all, propose pairs
that the whole fingerprints verify.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.llm.textbytes import mixed

#: Slots of a fingerprint, of four bits each; bands, and the slots that each of them samples.
SLOTS, BANDS, BAND_SLOTS = 128, 32, 8
#: Likeness of texts that share nothing, before it is put to 0.
CHANCE = 1 / 16
#: The walk's coins repeat after so many steps; characters fall into so many classes.
PERIOD, CLASSES = 1 << 12, 64
#: Characters that are walked at a time.
STRETCH = 1 << 16
#: Rows between two bounds of the order, at least; there are at most ``BOUNDS`` bounds, which every task holds.
LEAST_ROWS, BOUNDS = 64, 1 << 16

_rng = np.random.default_rng(20)


def _landings() -> list[int]:
    """Where a walk that comes to a character of a class at a step (both modulo) leaves it."""
    coins = _rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
    coins[:, -1] = 1
    step = np.where(coins == 1, np.arange(PERIOD), PERIOD - 1)
    first = np.minimum.accumulate(step[:, ::-1], axis=1)[:, ::-1]
    # One number object for each value, so that the table stays in the processor's cache.
    numbers = list(range(PERIOD))
    return [numbers[i] for i in ((first + 1) % PERIOD).ravel()]


def _records() -> np.ndarray:
    """For each slot the steps whose priority is below all before them, up to 2^42 and further."""
    out = np.full((SLOTS, 96), np.iinfo(np.int64).max, np.int64)
    for m in range(SLOTS):
        t = 1
        for k in range(96):
            out[m, k] = t - 1
            if t >= 1 << 42:
                break
            t = int(t / (1 - _rng.random())) + 1
    return out


_LANDING, _RECORD = _landings(), _records()
_SALT = _rng.integers(0, 1 << 63, SLOTS).astype(np.uint64)
_BAND = np.stack([_rng.choice(SLOTS, BAND_SLOTS, replace=False) for _ in range(BANDS)])


def sampled_steps(n_chars: int) -> np.ndarray:
    """The step of each slot for a text of so many characters."""
    return _RECORD[np.arange(SLOTS), np.maximum((_RECORD < 2 * n_chars).sum(axis=1) - 1, 0)]


def _walk(points: np.ndarray, step: int, wanted: np.ndarray) -> tuple[int, np.ndarray]:
    """Walk over code points from a step on: the step behind them, and the index read at each wanted step, -1 where the walk is not there."""
    found = np.full(len(wanted), -1, np.int64)
    for start in range(0, len(points), STRETCH):
        classes = ((points[start : start + STRETCH] * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(CLASSES) * np.uint32(PERIOD)
        landing, j = _LANDING, step % PERIOD
        at = np.frombuffer(array("q", [j, *[j := landing[c + j] for c in classes.tolist()]]), np.int64)
        stays = (at[1:] - at[:-1]) % PERIOD
        behind = step + np.cumsum(np.where(stays == 0, PERIOD, stays))
        here = np.flatnonzero((wanted >= step) & (wanted < behind[-1]))
        found[here] = start + np.searchsorted(behind, wanted[here], side="right")
        step = int(behind[-1])
    return step, found


def _print(points: np.ndarray, steps: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Slots of a fingerprint, four bits each: what stands at the sampled steps, three characters, and the step; behind the end nothing."""
    total = steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SALT
    for k, factor in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        at = index + k
        inside = (index >= 0) & (at < len(points))
        read = np.zeros(SLOTS, np.uint64)
        read[inside] = points[at[inside]].astype(np.uint64) + np.uint64(1)
        total = total + read * np.uint64(factor)
    return (mixed(total) >> np.uint64(60)).astype(np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hex(slots: np.ndarray) -> str:
    return (slots[::2] << 4 | slots[1::2]).tobytes().hex()


def _slots(fingerprints: list[str]) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), SLOTS // 2)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(fingerprints), SLOTS)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE), 0.0)


def prints(text: str, edits: tuple[tuple[int, str], ...] = ()) -> list[np.ndarray]:
    """The fingerprint of a text and of each edited text: the first so many characters, then others.  What they share is walked once."""
    points = _points(text)
    kept = min([len(points), *[k for k, _ in edits]])
    all_points = [points, *[np.concatenate([points[:k], _points(tail)]) for k, tail in edits]]
    steps = [sampled_steps(len(p)) for p in all_points]
    step, found = _walk(points[:kept], 0, np.concatenate(steps))
    out = []
    for i, p in enumerate(all_points):
        index = found[i * SLOTS : (i + 1) * SLOTS]
        _, rest = _walk(p[kept:], step, steps[i])
        out.append(_print(p, steps[i], np.where(rest >= 0, rest + kept, index)))
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as ``SLOTS`` hexadecimal digits; a null text is empty."""

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series([_hex(prints(t or "")[0]) for t in texts], dtype=object)

    return work(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints, less what chance gives: 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def work(left: pd.Series, right: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, left.index, dtype=float)
        both = left.notna() & right.notna()
        if both.any():
            out[both] = _likeness(_slots(left[both].tolist()), _slots(right[both].tolist()))
        return out

    return F.when(a.isNotNull() & b.isNotNull(), work(a, b))


def bands(fingerprint: Column) -> Column:
    """The band keys of a fingerprint: ``BANDS`` numbers, each from its own sample of slots."""

    @F.pandas_udf("array<long>")
    def work(prints: pd.Series) -> pd.Series:
        return pd.Series(list(_bands(_slots(prints.tolist())))) if len(prints) else pd.Series([], dtype=object)

    return work(fingerprint)


def _bands(slots: np.ndarray) -> np.ndarray:
    picked = slots[:, _BAND].astype(np.int64) << (4 * np.arange(BAND_SLOTS))
    return (np.arange(BANDS) << (4 * BAND_SLOTS)) + picked.sum(axis=2)


def banded_matches(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(query_id, doc_id, likeness): for each query the documents that share a band with it and are at least so alike, itself left out.

    Both: doc_id, fingerprint.  Equal fingerprints meet once, as one, and are unfolded at the end.  Null ids and null fingerprints take no part.
    A pair of likeness s shares a band with probability 1 - (1 - s^8)^32: 0.997 at 0.8, 0.86 at 0.7.  Each query stands for itself against all rows, so
    the work is the queries' bands times the different fingerprints that share them.
    """
    asked, held = (x.where("doc_id is not null and fingerprint is not null").select("doc_id", "fingerprint") for x in (queries, rows))
    one = [x.select("fingerprint").distinct().withColumn("band", F.explode(bands(F.col("fingerprint")))) for x in (asked, held)]
    met = one[0].withColumnRenamed("fingerprint", "asked").join(one[1], "band").select("asked", "fingerprint").distinct()
    alike = met.withColumn("likeness", likeness(F.col("asked"), F.col("fingerprint"))).where(F.col("likeness") >= least)
    back = alike.join(asked.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("asked")), "asked").join(held, "fingerprint")
    return back.where("query_id <> doc_id").select("query_id", "doc_id", "likeness").distinct()


def _bounds(docs: DataFrame, key: Column) -> np.ndarray:
    """Every so many rows in order the id of one, least first: the borders of stretches of neighbours.  At most ``BOUNDS`` and one a task."""
    every = max(LEAST_ROWS, -(-docs.count() // BOUNDS))

    def work(batches: Iterator[pa.RecordBatch]):
        done = 0
        for batch in batches:
            yield batch.slice(0).take(pa.array(range(-done % every, batch.num_rows, every), pa.int64()))
            done += batch.num_rows

    ids = docs.select(key.alias("id"))
    picked = ids.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(work, "id long")
    return np.unique([r.id for r in picked.collect()]).astype(np.int64)


def edited_prints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and how alike they and the next document's are.

    ``docs``: doc_id (any integer type), text; other columns are ignored.  The next document is that with the next greater doc_id, after the last the
    first; null ids come first, rows with equal ids follow one another by text.  Edited text: the last floor(n_chars / 2) characters are
    replaced by the first as many of the next document, or all.  A null text is empty.  No rows: no rows.
    Out: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the number of bands shared with either.

    Rows go once over the wire, into stretches of neighbours; the first row of a stretch is also sent to the one before, to stand behind its last.
    A task holds two texts and some 20 bytes for each of their characters.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    bounds = _bounds(docs, key)
    last = max(len(bounds) - 1, 0)

    @F.pandas_udf("stretch long, first boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        at = np.maximum(np.searchsorted(bounds, ids.to_numpy(), side="right") - 1, 0)
        return pd.DataFrame({"stretch": at, "first": bounds[at] == ids.to_numpy()})

    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("id")).withColumn("at", place("id"))
    own = F.struct(F.col("at.stretch").alias("stretch"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("at.stretch") == 0, last).otherwise(F.col("at.stretch") - 1).cast("long").alias("stretch"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("at.first"), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "id", "to.stretch", "to.guest").repartition("stretch").sortWithinPartitions("stretch", "guest", "id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"

    def work(batches: Iterator[pa.RecordBatch]):
        # A stretch is its own rows, then one guest or more.  A row's texts are known with the next row, and the next row's fingerprint one row later.
        now = waiting = None
        kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int32()] * 2]
        for batch in batches:
            id_type, out = batch.schema.field("doc_id").type, []
            for i in range(batch.num_rows):
                doc_id, text, guest = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "guest"))
                if now is not None:
                    row = _edited(*now, text)
                    if waiting is not None:
                        out.append(_compared(waiting, row[-2]))
                    waiting = row
                    if guest:
                        out.append(_compared(row, prints(text)[0]))
                        waiting = None
                now = None if guest else (doc_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [id_type, *kinds])], names)

    return dealt.mapInArrow(work, schema)


def _edited(doc_id, text: str, following: str) -> tuple:
    kept = len(text) - len(text) // 2
    tail = following[: len(text) // 2]
    return doc_id, len(text), hashlib.sha256((text[:kept] + tail).encode()).hexdigest(), *prints(text, ((kept, tail),))


def _compared(row: tuple, following: np.ndarray) -> tuple:
    *start, own, edited = row
    others = np.stack([edited, following])
    shared = (_bands(own[None]) == _bands(others)).sum(axis=1)
    return *start, _hex(own), _hex(edited), *_likeness(own, others).tolist(), *shared.tolist()
