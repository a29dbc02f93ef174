"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the covariance of both classes and towards a multiple of the identity.
A score is the logistic of the difference of the two log densities (Mahalanobis distances through Cholesky factors, computed once) plus the
log odds of the classes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.llm import textbytes as tb

#: Byte classes that are counted in each text.
GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"!?", "stop": b".,;:", "symbol": b"#$%&*@^~_=+<>|\\/{}[]()", "quote": b"\"'`-"}
TO_POOLED, TO_IDENTITY = 0.2, 0.02
TEMPERATURE = 4.0
FEATURES = [*GROUPS, "letters", "beyond", "line", "word_length", "distinct", "same_line", "long_word", "size"]

_GROUP = np.zeros(256, np.int64)
for _i, _bytes in enumerate(GROUPS.values(), 1):
    _GROUP[list(_bytes)] = _i
_LETTER, _LINE, _BEYOND = len(GROUPS) + 1, len(GROUPS) + 2, len(GROUPS) + 3
_GROUP[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_GROUP[10], _GROUP[128:] = _LINE, _BEYOND
_KINDS = _BEYOND + 1
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text: shares on a log scale, lengths as logarithms."""
    data, offsets = tb.column_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * _KINDS + _GROUP[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    starts, ends, word_row = tb.words(data, offsets, tb.NOT_SPACE)
    prefix = tb.prefix_hash(data)
    count = np.bincount(word_row, minlength=n).astype(float)
    distinct = np.bincount(tb.distinct_by_row(word_row, tb.span_hash(prefix, starts, ends))[0], minlength=n)
    lengths = (ends - starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, lengths)
    ls, le, line_row = tb.words(data, offsets, _NOT_LINE)
    lines = np.bincount(line_row, minlength=n).astype(float)
    other = np.bincount(tb.distinct_by_row(line_row, tb.span_hash(prefix, ls, le))[0], minlength=n)
    share = lambda x, of: np.log((x + 0.5) / (of + 10.0))
    columns = [share(kinds[:, i], size) for i in range(1, len(GROUPS) + 1)]
    columns += [share(kinds[:, _LETTER], size), share(kinds[:, _BEYOND], size), share(kinds[:, _LINE], count)]
    columns += [np.log((np.bincount(word_row, lengths, minlength=n) + 5.0) / (count + 1.0)), share(distinct, count), share(lines - other, lines)]
    columns += [np.log1p(longest), np.log1p(size)]
    return np.stack(columns, axis=1)


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        far = []
        for mean, factor in zip(self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            far.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip((far[1] - far[0]) / TEMPERATURE + self.offset, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant | None:
    """Fit on all texts of ``docs`` that ``labels`` (doc_id, label 0 or 1) names.

    Texts are measured where they lie, and labels meet the few numbers of each text; sums are made on the executors.  None if either class has no text.
    """
    p = len(FEATURES)
    cells = p * p + p + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for batch in tb.slices(batches, "text"):
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(batch.column("text")).ravel()), p).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    def sums(batches):
        total = np.zeros((2, cells))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, p)
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * cells)), pa.array(total.ravel())], ["cell", "value"])

    held = docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, x array<double>").join(labels, "doc_id").select("x", "label")
    rows = held.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(2 * cells)
    total[rows.column("cell").to_numpy()] = rows.column("value").to_numpy()
    total = total.reshape(2, cells)
    if not (total[:, 0] > 0).all():
        return None
    means = total[:, 1 : p + 1] / total[:, :1]
    own = [total[c, p + 1 :].reshape(p, p) / total[c, 0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (total[0, 0] * own[0] + total[1, 0] * own[1]) / total[:, 0].sum()
    factors = []
    for c in (0, 1):
        spread = (1 - to_pooled) * own[c] + to_pooled * pooled
        spread = (1 - to_identity) * spread + to_identity * max(np.trace(spread) / p, 1e-3) * np.eye(p)
        factors.append(np.linalg.cholesky(spread))
    return Discriminant(means, np.array(factors), float(np.log(total[1, 0] / total[0, 0])))


def with_quality(docs: DataFrame, model: Discriminant | None, column: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 in ``column`` (replaced if there).

    Null and empty texts are scored from the statistics of the empty text.  Without a model every score is 0.5.  Other columns stay.
    """
    names = [c for c in docs.columns if c != column]
    docs = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def score(batches):
        for batch in tb.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            out = model.scores(statistics(texts)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, column])

    return docs.mapInArrow(score, f"{fields}, `{column}` double")


def training_labels(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """(doc_id, label): one label for each doc_id outside the held-out fold; null ids and labels other than 0 and 1 do not count.

    Of contradicting labels the smaller counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    kept = labels.where("doc_id is not null and quality in (0, 1)").where(fold != held)
    return kept.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
