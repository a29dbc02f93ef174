"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes).  Two documents link when
``100 * shared >= percent * union``.  Every shingle has a place in one global order, rare ones first.  For a set of n
shingles that needs t shared ones, its l-prefix is its first n - t + l shingles; two linked sets share at
least l tokens of their l-prefixes, for every l up to t.  Each document lengthens its prefix to the l with the least estimated
candidate cost, and a pair has to share the smaller l of the two before it is verified.  A document with fewer than l
shared tokens in its l-prefix has no link and goes no further.

Equal sets are one class before anything is joined.  Classes that share a prefix token first meet the
token's pivot only (a star, not all pairs); what those links already connect needs no more links.  Then only pairs of
different components are counted, and of these only such as the distances to a common pivot allow: Jaccard distance
is a metric.  No pair of different components that could link is left out.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import components, free_name, stash

SKETCH_BITS = 18
#: Numbers of shared tokens that a document may ask for.
MATCHES = (1, 2, 4, 8, 16)
#: Cost of a verification, in units of one posting read.
VERIFY_COST = 8.0
#: Pivots that each class meets first.
FIRST_PIVOTS = 3
#: A common token's postings are dealt to parts of about so many rows.
SALT_ROWS = 50_000


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = tb.column_bytes(batch.column("text"))
    rows, hashes = tb.distinct_by_row(*tb.word_shingles(tb.LOWER[data], offsets, tb.NOT_SPACE, k))
    return rows, hashes, tb.runs(rows, batch.num_rows)


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _class_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    return tb.mixed(_row_sums(tb.mixed(hashes), at) ^ tb.mixed(_row_sums(hashes * tb.STEP, at) + np.diff(at).astype(np.uint64)))


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, n_shingles, class): equal sets share a class; class is null for an empty set; ``mark``: a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for batch in tb.slices(batches, "text"):
            _, hashes, at = _sets(batch, k)
            n = np.diff(at)
            names = pa.array(_class_of(hashes, at).view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n), names], ["doc_id", "mark", "n_shingles", "class"])

    held = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return held.mapInArrow(measure, f"doc_id {kind}, mark long, n_shingles long, class long")


def shingle_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Occurrences of the shingles of all documents in 2^bits buckets; its size does not depend on the input."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(1 << bits, np.int64)
        for batch in tb.slices(batches, "text"):
            _, hashes, _ = _sets(batch, k)
            total += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def prefix_tokens(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, most: int = MATCHES[-1]) -> DataFrame:
    """(token, salt, class, n, place): the tokens of a set's longest prefix and their places in its order;
    ``salt``: 0, or a part from 1 on if the token is common."""
    bits = int(len(sketch)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def emit(batches):
        counts = shared.value
        # What a bucket holds beyond the usual load stands for the postings of a common token in it.
        usual = float(np.median(counts))
        usual += 4 * math.sqrt(usual + 1)
        for batch in tb.slices(batches, "text"):
            rows, hashes, at = _sets(batch, k)
            n = np.diff(at)
            names = _class_of(hashes, at)
            load = counts[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((hashes, load, rows))
            hashes, load = hashes[order], load[order]
            place = np.arange(len(rows)) - at[rows]
            free = n - (n * percent + 99) // 100
            keep = place < (free + most)[rows]
            rows, place = rows[keep], place[keep]
            parts = (np.maximum(load[keep] - usual, 0) // SALT_ROWS).astype(np.uint64)
            salt = np.where(parts > 0, names[rows] % (parts + np.uint64(1)) + np.uint64(1), np.uint64(0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[keep].view(np.int64)), pa.array(salt), pa.array(names[rows].view(np.int64)), pa.array(n[rows].astype(np.int32)), pa.array(place.astype(np.int32))],
                ["token", "salt", "class", "n", "place"],
            )

    return docs.select("text").mapInArrow(emit, "token long, salt int, class long, n int, place int")


def meeting_postings(rows: DataFrame) -> DataFrame:
    """(token, class, n, place): the prefix tokens that several classes have.

    Tokens of one class only, most of them, end here: the rows pass once, sorted, and of a token only its first row is
    held.  All rows of a common token's parts go on.
    """
    names = ["token", "salt", "class", "n", "place"]

    def meet(batches: Iterator[pa.RecordBatch]):
        held, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                columns = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, columns)]
            token, salt, own = columns[:3]
            edge = np.ones(len(token), bool)
            edge[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(edge) - 1
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(token)) - 1
            shared = (own[first] != own[last]) | (salt[first] > 0)
            new = edge.copy()
            new[1:] |= own[1:] != own[:-1]
            keep = shared[group] & new
            if told:
                keep[0] = False
            told = bool(shared[-1]) or (told and len(first) == 1)
            held = [c[first[-1]] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(columns[i][keep]) for i in (0, 2, 3, 4)], ["token", "class", "n", "place"])

    ordered = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "class")
    return ordered.mapInArrow(meet, "token long, class long, n int, place int").distinct()


def adaptive_postings(postings: DataFrame, percent: int) -> DataFrame:
    """``postings`` of the classes that can have links, with ``own``, ``level``, ``ahead`` and ``met_by``.

    ``own``: how many shared tokens the class asks for.  A prefix for l reads the postings of its tokens, and at most their number over l
    candidates share l of them and are verified.  ``level``: the smallest l whose prefix holds the token.  ``ahead``: tokens before the class's first
    shared one; the first token that two linked sets have in common is in both prefixes, so none of these is common.  ``met_by``: postings of
    its tokens beside its own.
    """
    sizes = postings.groupBy("token").agg((F.count("*") - 1).alias("others")).where("others > 0")
    needed = F.ceil(F.col("n") * percent / 100)
    reads = postings.join(sizes, "token").withColumn("level", F.greatest(F.col("place") - (F.col("n") - needed) + 1, F.lit(1)))
    inside = {m: F.col("level") <= m for m in MATCHES}
    sums = [c for m in MATCHES for c in (F.sum(F.when(inside[m], F.col("others")).otherwise(0)).alias(f"read_{m}"), F.count_if(inside[m]).alias(f"met_{m}"))]
    each = reads.groupBy("class").agg(F.max("n").alias("n"), F.min("place").alias("ahead"), *sums)
    able = F.lit(True)
    for m in MATCHES:
        able = able & ((needed < m) | (F.col(f"met_{m}") >= m))
    costs = [F.when(needed >= m, F.struct((F.col(f"read_{m}") * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m"))) for m in MATCHES]
    own = each.where(able).select("class", F.least(*costs)["m"].alias("own"), "ahead", F.col(f"read_{MATCHES[-1]}").alias("met_by"))
    return reads.drop("others").join(own, "class").where(F.col("level") <= F.col("own"))


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can link if they share ``shared`` at most."""
    return shared * 100 >= (n + m - shared) * percent


def _set_table(docs: DataFrame, base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, tokens): the sorted hashes, as bytes, of every wanted class, from one document of it.

    ``base``: (doc_id, mark, class) of every document.  The chosen ids meet the texts, so that no other text is read again.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = base.join(wanted, "class", "left_semi").groupBy("class").agg(F.min(place).alias("first"))
    first = stash(first.select(F.col("first.doc_id").alias("of"), F.col("first.mark").alias("of_mark")), "representatives")

    def pack(batches):
        for batch in tb.slices(batches, "text"):
            _, hashes, at = _sets(batch, k)
            own = _class_of(hashes, at).view(np.int64)
            packed = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), packed], ["class", "tokens"])

    held = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))
    # Rows that repeat an id and its text, or have no id, come more than once.
    return held.join(first, same, "left_semi").select("text").mapInArrow(pack, "class long, tokens binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, both, linked) of pairs (a, b): exact sizes of the intersection and of the union."""

    def compare(batches):
        for batch in batches:
            shared, both = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(x, y)
                place[place == len(x)] = 0
                hit = int(np.count_nonzero(x[place] == y))
                shared.append(hit)
                both.append(len(x) + len(y) - hit)
            shared, both = np.array(shared, np.int64), np.array(both, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared), pa.array(both), pa.array(100 * shared >= percent * both)],
                ["a", "b", "shared", "both", "linked"],
            )

    held = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a")
    held = held.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, shared long, both long, linked boolean")


def _with_component(rows: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """``rows`` with the component of column ``name``; what is in no link is a component of its own."""
    held = rows.join(known.select(F.col("id").alias(name), "component"), name, "left")
    return held.withColumn(f"{name}_component", F.coalesce("component", name)).drop("component")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class, component_id.

    Words are runs of anything but space and 0x09-0x0D, A-Z in lower case.  Fewer than ``k`` words: one shingle over all of
    them.  A null or wordless text has no shingle, class null, links with nothing and is its own component.  Rows with
    equal doc_id are rows of their own; component_id is the smallest doc_id reachable.  A null doc_id is kept but names no component
    unless all ids of the component are null.  Other columns are ignored.  No rows: no rows.
    """
    base, named = _grouped(docs, k, percent)
    return base.join(named.drop("component"), "class", "left").select(
        "doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, class) of every row, and (class, component, component_id) of every class; ``component``: the least class in it."""
    docs = docs.select("doc_id", "text")
    base = stash(shingle_classes(docs, k), "classes")
    classes = base.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").cast("int").alias("n"))
    rows = prefix_tokens(docs, k, percent, shingle_sketch(docs, k, SKETCH_BITS))
    postings = stash(meeting_postings(rows), "meeting")
    postings = stash(adaptive_postings(postings, percent), "postings")
    sets = stash(_set_table(docs, base, postings.select("class").distinct(), k), "sets")

    # A token's pivot is the class that is met by most others, the most central of a group.  Each class first meets the
    # pivots that it has most tokens in common with.  These links only spare later ones, so pivots met in few tokens can wait.
    about = postings.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("ahead").alias("behind")).distinct()
    postings = postings.join(postings.groupBy("token").agg(F.max(F.struct("met_by", "class")).alias("pivot")), "token").withColumn("pivot", F.col("pivot.class"))
    pairs = postings.where("class <> pivot").groupBy(F.col("class").alias("a"), F.col("pivot").alias("b"), "n", "own", "ahead").agg(F.count("*").alias("met"))
    most = F.least(F.col("n") - F.col("ahead"), F.col("m") - F.col("behind"))
    pairs = pairs.where("2 * met >= own").join(about, "b").where(_enough(most, F.col("n"), F.col("m"), percent))
    order = Window.partitionBy("a").orderBy(F.desc("met"), "b")
    pairs = pairs.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= FIRST_PIVOTS).select("a", "b")
    first = stash(_verified(pairs, sets, percent), "first")
    known = components(first.where("linked").select("a", "b"))

    at = F.col("shared") / F.col("both")
    held = _with_component(postings, "class", known).withColumnRenamed("class_component", "component")
    open_tokens = held.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    gap = first.select(F.col("a").alias("class"), F.col("b").alias("pivot"), (1 - at).alias("d"))
    gap = gap.union(gap.select(F.col("pivot").alias("class"), F.col("class").alias("pivot"), "d")).distinct()
    held = held.join(open_tokens, "token", "left_semi").join(gap, ["class", "pivot"], "left")
    held = held.withColumn("d", F.when(F.col("class") == F.col("pivot"), 0.0).otherwise(F.col("d")))
    held = stash(held.select("token", "class", "n", "place", "level", "own", "ahead", "pivot", "component", "d"), "open")
    # First components meet, each once for a token: what they share between them has to be enough for their least demanding pair.
    # A token at some place leaves room for what is common before it, from the first shared token on, and for the rest of the smaller side.
    n, place, ahead = F.col("n"), F.col("place"), F.col("ahead")
    heads = held.groupBy("token", "component").agg(
        F.min("own").alias("own"), F.max(place - ahead).alias("before"), F.max(n - place).alias("rest"), F.min("n").alias("n"), F.max(n - ahead).alias("able"),
        F.min("level").alias("level"), F.max("own").alias("own_most"),
    )
    heads = stash(heads, "heads")
    side = lambda name: heads.select("token", *[F.col(c).alias(f"{name}_{c}") for c in ("component", "own", "own_most", "level", "before", "rest", "n", "able")])
    room = F.least(F.least("a_before", "b_before") + F.least("a_rest", "b_rest"), F.least("a_able", "b_able"))
    counted = F.greatest("a_level", "b_level") <= F.least("a_own_most", "b_own_most")
    pairs = side("a").join(side("b"), "token").where((F.col("a_component") < F.col("b_component")) & counted & _enough(room, F.col("a_n"), F.col("b_n"), percent))
    wide = pairs.groupBy("a_component", "b_component").agg(
        F.count("*").alias("met"), F.min(F.least("a_own", "b_own")).alias("need"), F.max(F.least("a_rest", "b_rest")).alias("most"), F.min("a_n").alias("n"), F.min("b_n").alias("m")
    )
    wide = wide.where("met >= need").where(_enough(F.col("most"), F.col("n"), F.col("m"), percent))
    wide = stash(wide.select("a_component", "b_component"), "wide")
    # Two linked sets have nothing in common before their first common token, so that token alone leaves them room enough: it finds the pair.
    alone = _enough(F.least("a_rest", "b_rest"), F.col("a_n"), F.col("b_n"), percent)
    pairs = pairs.where(alone).select("token", "a_component", "b_component").join(wide, ["a_component", "b_component"])
    columns = ("class", "n", "place", "level", "own", "ahead", "pivot", "component", "d")
    x = held.select("token", *[F.col(c).alias(f"a_{c}") for c in columns])
    y = held.select("token", *[F.col(c).alias(f"b_{c}") for c in columns])
    too_far = (F.col("a_pivot") == F.col("b_pivot")) & (F.abs(F.col("a_d") - F.col("b_d")) > 1 - percent / 100 + 1e-9)
    found = x.join(pairs, ["token", "a_component"]).join(y, ["token", "b_component"]).where(
        _enough(F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")), F.col("a_n"), F.col("b_n"), percent) & ~F.coalesce(too_far, F.lit(False))
    )
    more = found.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    tried = first.select("a", "b").union(first.select("b", "a"))
    more = stash(more.join(tried, ["a", "b"], "left_anti"), "more")
    asked = stash(more.select(F.col("a").alias("class")).union(more.select("b")).distinct(), "asked")
    second = _verified(more, sets.join(asked, "class", "left_semi"), percent)
    linked = first.where("linked").select("a", "b").union(second.where("linked").select("a", "b"))
    final = components(linked)
    named = classes.join(final.select(F.col("id").alias("class"), "component"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return base, named.join(least, "component").select("class", "component", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Exactly one row of each group of near copies stays, whatever the ids: smallest doc_id, null last, then least hash of the text.

    Rows are judged by their own text: others with their doc_id do not keep them.  Rows without words always stay.
    """
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own, mark, of, of_mark, of_class, copies = (free_name(names, x) for x in ("__class", "__mark", "__of", "__of_mark", "__of_class", "__copies"))

    def tag(batches):
        for batch in tb.slices(batches, "text"):
            _, hashes, at = _sets(batch, k)
            found = pa.array(_class_of(hashes, at).view(np.int64), mask=np.diff(at) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, own])

    tagged = docs.mapInArrow(tag, f"{fields}, `{own}` long").withColumn(mark, F.xxhash64("text"))
    base, named = _grouped(docs, k, percent)
    each = base.where("class is not null").groupBy("class", "doc_id", "mark").agg(F.count("*").alias("n")).join(named.select("class", "component"), "class")
    first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "class", "n")).alias("first"))
    first = stash(first.select(F.col("first.doc_id").alias(of), F.col("first.mark").alias(of_mark), F.col("first.class").alias(of_class), F.col("first.n").alias(copies)), "first")
    same = (F.col(own) == F.col(of_class)) & (F.col(mark) == F.col(of_mark)) & F.col("doc_id").eqNullSafe(F.col(of))
    left = tagged.join(first.where(F.col(copies) == 1), same, "left_semi").unionByName(tagged.where(F.col(own).isNull()))
    once = tagged.join(first.where(F.col(copies) > 1), same, "left_semi").dropDuplicates([own, "doc_id", mark])
    return left.unionByName(once).select(names)
