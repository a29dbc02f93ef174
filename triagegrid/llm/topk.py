"""Exact top-k search by no-random-access aggregation.

Candidates lie in blocks; a block keeps one list of its rows for every dimension, sorted by value.  A query reads its lists from the end that gives it
most, in steps, and keeps for each row a lower bound (what was read, the least of every other list for the rest) and an upper bound
(the value just read there).  Rows whose upper bound is below the k-th lower bound, or below what an earlier block gave, cannot qualify;
when few others are left their scores are resolved.  Blocks of queries meet blocks of candidates; per block and query at most k rows leave.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagegrid.llm.tables import stash

BLOCK_ROWS, BLOCK_QUERIES = 4096, 256
#: Lists are read in so many steps, until at most this share of a block can still qualify; a few rows are looked at first.
STEPS, RESOLVE, PROBED = 8, 0.3, 128


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """The sorted lists of one block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        down = np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32))
        self.order = {True: down, False: np.ascontiguousarray(down[:, ::-1])}
        self.value = {side: np.take_along_axis(rows.T, order, axis=1).astype(float) for side, order in self.order.items()}
        self.seen = np.zeros(rows.shape[::-1], np.float32)

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's best rows for a query, at most k, none below ``least``; row id ``own`` takes no part."""
        n, width = self.rows.shape
        sides = [(side, np.flatnonzero(query > 0 if side else query < 0)) for side in (True, False)]
        sides = [(side, dims, query[dims, None].astype(float), (dims * n).astype(np.int32)[:, None]) for side, dims in sides if len(dims)]
        known, seen = np.zeros(n), self.seen
        seen[:] = 0
        flat, bounds = seen.ravel(), np.zeros((2, width))
        for side, dims, weight, _ in sides:
            bounds[0, dims] = self.value[side][dims, -1] * weight[:, 0]
        mine = self.ids == own
        probe = slice(0, n, max(1, n // PROBED))
        read, alive = 0, np.ones(n, bool)
        while read < n:
            upto = min(n, read + max(1, -(-n // STEPS)))
            for side, dims, weight, at in sides:
                rows = self.order[side][dims, read:upto]
                gain = self.value[side][dims, read:upto]
                gain *= weight
                known += np.bincount(rows.ravel(), gain.ravel(), minlength=n)
                rows += at
                flat[rows.ravel()] = 1
                bounds[1, dims] = gain[:, -1]
            read = upto
            # What the lists not yet read for a row can add at least and at most, in single precision with slack.
            single, total = bounds.astype(np.float32), bounds.sum(axis=1)
            slack = 1e-5 * (np.abs(bounds).sum() + 1)
            few = max(k, RESOLVE * n)
            if read < n and np.mean(known[probe] + total[1] - single[1] @ seen[:, probe] + slack >= least) * n > few:
                # Most of a few rows still qualify against the bar from elsewhere: so do too many of all.
                if least > -np.inf:
                    continue
            left = total[:, None] - single @ seen
            lower = known + left[0] - slack
            lower[mine] = -np.inf
            bar = max(least, np.partition(lower, n - k)[n - k]) if n > k else least
            alive = (known + left[1] + slack >= bar) & ~mine
            if np.count_nonzero(alive) <= few:
                break
        chosen = np.flatnonzero(alive & ~mine)
        scores = self.rows[chosen] @ query
        best = np.lexsort((self.ids[chosen], -scores))[:k]
        best = best[scores[best] >= least]
        return self.ids[chosen][best], scores[best]


def _blocked(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with a block number: blocks of about ``size`` rows of one vector length."""
    counts = rows.groupBy("width").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(counts, "width").withColumn(name, F.pmod(F.xxhash64("vec_id", "vector"), "blocks"))


def _searched(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            lists = Lists(matrix(right), right.column("vec_id").to_numpy())
            for query, own, mark, least in zip(matrix(left), left.column("vec_id").to_pylist(), left.column("mark").to_pylist(), left.column("least").to_pylist()):
                ids, scores = lists.search(query, own, k, -np.inf if least is None else least)
                out += [(own, mark, int(i), int(s)) for i, s in zip(ids, scores)]
        names = ["query_id", "mark", "vec_id", "score"]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=names)

    keys = ["width", "q", "c"]
    # Both sides come from one grid; named anew, their columns are told apart.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(work, "query_id long, mark long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of ``vectors`` with the highest integer inner product.

    Both inputs hold vec_id and vector (array of long, see ``quantized``); queries meet vectors of their own length only.  Ties go to the smaller
    vec_id; rows with the query's own vec_id take no part.  Rows without id or vector, or with an empty vector, take no part; rows that repeat id and vector
    count once; queries that share an id but not the vector are answered one by one.  Fewer rows than k: all of them.  Other columns are ignored.
    """
    held = []
    for rows in (queries, vectors):
        rows = rows.select("vec_id", "vector").where("vec_id is not null and vector is not null and size(vector) > 0")
        held.append(rows.dropDuplicates(["vec_id", "vector"]).withColumn("width", F.size("vector")))
    asked = _blocked(held[0], BLOCK_QUERIES, "q").drop("blocks").withColumn("mark", F.xxhash64("vector"))
    asked = stash(asked, "queries")
    rows = stash(_blocked(held[1], BLOCK_ROWS, "c"), "vectors")
    grid = asked.select("width", "q").distinct().join(rows.select("width", "c").distinct(), "width")
    # Every query first meets one block; its k-th score there is a bar for all other blocks.
    first = grid.groupBy("width", "q").agg(F.min("c").alias("c"))
    start = _searched(
        asked.join(first, ["width", "q"]).withColumn("least", F.lit(None).cast("long")), rows.join(first, ["width", "c"]), k
    )
    start = stash(start, "first")
    bars = start.groupBy("query_id", "mark").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")
    barred = asked.join(bars.withColumnRenamed("query_id", "vec_id"), ["vec_id", "mark"], "left")
    rest = grid.join(first, ["width", "q", "c"], "left_anti")
    more = _searched(barred.join(rest, ["width", "q"]), rows.join(rest, ["width", "c"]), k)
    return _best(start.union(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
