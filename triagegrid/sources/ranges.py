"""Records of large JSON arrays and CSV files, read in ranges of bytes by many tasks.

Where a record ends depends on what stands before: inside quotes, and inside brackets, a comma or a line end is text.  So a file is cut by its
reader into ranges wherever a separator stands, and each range first reports what it does to that state, for both cases, outside and inside
quotes.  The reports, one short row a range, are added up in order of the file; then every range knows its state at the start and cuts its own
records.  What begins in one range and ends in another is put together from its pieces, of which a range has two at most.
"""
from __future__ import annotations

import csv
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REPORT = "file string, range long, quotes boolean, in_quotes boolean, out_deep long, in_deep long"
CUT = "file string, range long, kind string, value binary, flaws long, opened long, closed long, n_bytes long"
NAMES = [c.split()[0] for c in CUT.split(", ")]


@dataclass
class Marks:
    """What a stretch of bytes holds, read from a state: where it is cut, and the state behind it."""

    cuts: np.ndarray
    quoted: bool
    deep: int
    flaws: int = 0
    opened: int = 0
    closed: int = 0


def json_marks(data: bytes, quoted: bool, deep: int) -> Marks:
    """Cuts at the brackets of the outer array and the commas right below it."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != 0x5C, at, -1))
    quote = np.flatnonzero(b == 0x22)
    # A quote behind an odd number of backslashes is text.
    before = np.where(quote > 0, quote - 1 - plain[np.maximum(quote - 1, 0)], 0)
    turn = np.zeros(len(b), np.int64)
    turn[quote[before % 2 == 0]] = 1
    outside = (np.cumsum(turn) + quoted) % 2 == 0
    step = np.where((b == 0x5B) | (b == 0x7B), 1, np.where((b == 0x5D) | (b == 0x7D), -1, 0)) * outside
    depth = deep + np.cumsum(step)
    opens = (b == 0x5B) & (step == 1) & (depth == 1)
    closes = (b == 0x5D) & (step == -1) & (depth == 0)
    other = ((b == 0x7B) & (step == 1) & (depth == 1)) | ((b == 0x7D) & (step == -1) & (depth == 0)) | (depth < 0)
    cuts = np.flatnonzero(opens | closes | (outside & (b == 0x2C) & (depth == 1)))
    return Marks(cuts, not outside[-1], int(depth[-1]), int(other.sum()), int(opens.sum()), int(closes.sum()))


def csv_marks(data: bytes, quoted: bool, deep: int) -> Marks:
    """Cuts at the line ends outside quotes.  A quote opens at the start of a field and is text elsewhere; inside, a doubled one is text."""
    b = np.frombuffer(data, np.uint8)
    turn, behind, at = np.zeros(len(b), np.int64), -1, data.find(b'"')
    now = quoted
    while at >= 0:
        behind = at
        if now and data[at + 1] == 0x22:
            behind = at + 1
        elif now or at == 0 or data[at - 1] in b",\n":
            turn[at] = 1
            now = not now
        at = data.find(b'"', behind + 1)
    outside = (np.cumsum(turn) + quoted) % 2 == 0
    return Marks(np.flatnonzero(outside & (b == 0x0A)), now, 0)


def _ranges(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[tuple[tuple, bytes]]:
    """((file, range, quoted, deep), bytes) of neighbouring pieces, a batch of them at a time."""
    state = ("quoted", "deep")
    for batch in batches:
        files, starts = batch.column("file"), batch.column("range").to_numpy(zero_copy_only=False)
        values = batch.column("value").to_pylist()
        has = [batch.column(c) if c in batch.schema.names else None for c in state]
        name = files.to_pylist()
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or starts[i] != starts[begin] or name[i] != name[begin]:
                key = (name[begin], int(starts[begin]), *[c[begin].as_py() if c is not None else None for c in has])
                yield key, sep.join(values[begin:i]) + sep
                begin = i


def _reporter(marks: Callable, sep: bytes):
    def work(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple, list] = {}

        def rows():
            cells = [[*k, *v] for k, v in held.items()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), kinds)], [c.split()[0] for c in REPORT.split(", ")])

        for (file, start, *_), data in _ranges(batches, sep):
            if (file, start) not in held:
                if held:
                    yield rows()
                held = {(file, start): [False, True, 0, 0]}
            state = held[file, start]
            # Case by case: begun outside quotes, and begun inside.  Each case is followed on its own: inside CSV quotes, a quote in the
            # middle of a field ends them, while outside it is text, so the two cases need not end opposite each other.
            out, inside = marks(data, state[0], 0), marks(data, state[1], 0)
            held[file, start] = [out.quoted, inside.quoted, state[2] + out.deep, state[3] + inside.deep]
        if held:
            yield rows()

    return work


def _cutter(marks: Callable, sep: bytes):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]):
        key, quoted, deep, lead, rest, total = None, False, 0, None, b"", [0, 0, 0, 0]

        def end():
            out = [(*key, "lead", rest if lead is None else lead, *total)]
            return out if lead is None else [*out, (*key, "tail", rest, 0, 0, 0, 0)]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NAMES)

        for (file, start, at_quoted, at_deep), data in _ranges(batches, sep):
            rows = []
            if (file, start) != key:
                if key is not None:
                    rows += end()
                key, quoted, deep, lead, rest, total = (file, start), at_quoted, at_deep, None, b"", [0, 0, 0, 0]
            found = marks(data, quoted, deep)
            quoted, deep, total = found.quoted, found.deep, [a + b for a, b in zip(total, (found.flaws, found.opened, found.closed, len(data)))]
            begin = 0
            for cut in found.cuts.tolist():
                piece, begin = rest + data[begin:cut], cut + 1
                rest = b""
                if lead is None:
                    lead = piece
                else:
                    rows.append((*key, "record", piece, 0, 0, 0, 0))
            rest += data[begin:]
            if rows:
                yield made(rows)
        if key is not None:
            yield made(end())

    return work


def cut_records(spark: SparkSession, path: str, marks: Callable, sep: str, options: dict[str, str] | None = None, files: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, figures): (file, edge, value) of every record, and (file, flaws, opened, closed, n_bytes) of every file.

    ``edge`` is "first" for what stands before a file's first cut, "last" for what stands behind the last, else null.  A task holds a batch of
    pieces and the record at hand.  The state of each range reaches all tasks: some 100 bytes for each split of the input.
    """
    lines = spark.read.options(**(options or {})).option("lineSep", sep).text(path)
    lines = lines.where(files) if files is not None else lines
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))
    reports = pieces.mapInArrow(_reporter(marks, sep.encode()), REPORT)
    order = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # The ranges before, in order, each taken from the state the one before it leaves.
    before = F.sort_array(F.collect_list(F.struct("range", "quotes", "in_quotes", "out_deep", "in_deep")).over(order))
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("bigint").alias("deep"))
    state = F.aggregate(
        before, start,
        lambda s, p: F.struct(
            F.when(s["quoted"], p["in_quotes"]).otherwise(p["quotes"]).alias("quoted"),
            (s["deep"] + F.when(s["quoted"], p["in_deep"]).otherwise(p["out_deep"])).alias("deep"),
        ),
    )
    states = reports.select("file", "range", state.alias("_s")).select("file", "range", "_s.quoted", "_s.deep")
    cut = pieces.join(F.broadcast(states), ["file", "range"]).mapInArrow(_cutter(marks, sep.encode()), CUT)
    ends = cut.where("kind <> 'record'")
    # A tail begins a record that the next lead ends, with whole ranges in between.
    turn = F.sum((F.col("kind") == "tail").cast("int")).over(W.partitionBy("file").orderBy("range", "kind"))
    figures = ["flaws", "opened", "closed", "n_bytes"]
    joined = ends.withColumn("_turn", turn).groupBy("file", "_turn").agg(
        F.sort_array(F.collect_list(F.struct("range", "kind", "value"))).alias("_p"), *[F.sum(c).alias(c) for c in figures]
    )
    last = F.max("_turn").over(W.partitionBy("file"))
    value = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["value"]))
    across = joined.select("file", F.when(F.col("_turn") == 0, "first").when(F.col("_turn") == last, "last").alias("edge"), value.alias("value"))
    records = cut.where("kind = 'record'").select("file", F.lit(None).cast("string").alias("edge"), "value").unionByName(across)
    return records, joined.groupBy("file").agg(*[F.sum(c).alias(c) for c in figures])


def listed(spark: SparkSession, path: str, options: dict[str, str] | None = None, files: Column | None = None) -> DataFrame:
    """(file, name, n) of every file and its length, empty ones too; nothing of them is read."""
    found = spark.read.format("binaryFile").options(**(options or {})).load(path)
    found = found.where(files) if files is not None else found
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("length").alias("n"))


#: Files whose length is not that of their text.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def json_items(spark: SparkSession, path: str, files: Column | None = None, nan: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, bad): (name, item) of every item of arrays in files, as valid UTF-8, and (name) of every file that is no array, whole.

    ``nan``: items may hold NaN, which is no JSON, so they are not looked into.
    """
    records, figures = cut_records(spark, path, json_marks, ",", files=files)
    blank = F.rlike(F.make_valid_utf8(F.col("value").cast("string")), F.lit(r"^[\x20\t\r\n]*,?$"))
    rows = records.withColumn("item", F.make_valid_utf8(F.col("value").cast("string")))
    inside = F.col("edge").isNull()
    per_file = rows.groupBy("file").agg(
        F.count_if(inside).alias("n_items"), F.count_if(F.lit(False) if nan else inside & F.try_parse_json("item").isNull()).alias("n_broken"),
        F.count_if(inside & blank).alias("n_blank"), F.count_if(~inside & ~blank).alias("n_around"),
    )
    whole = (
        (F.col("flaws") == 0) & (F.col("opened") == 1) & (F.col("closed") == 1) & (F.col("n_around") == 0) & ((F.col("n_bytes") == F.col("n") + 1) | F.rlike("name", F.lit(PACKED)))
        & ((F.col("n_broken") + F.when(F.col("n_blank") > 0, 1).otherwise(0) == 0) | ((F.col("n_items") == 1) & (F.col("n_blank") == 1)))
    )
    judged = listed(spark, path, files=files).join(figures, "file", "left").join(per_file, "file", "left").withColumn("_whole", F.coalesce(whole, F.lit(False)))
    good = judged.where("_whole").select("file", "name")
    items = rows.where(inside & ~blank).join(good, "file").select("name", "item")
    return items, judged.where("not _whole").select("name")


def csv_records(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """(file, edge, record): the lines of CSV files, each with the line breaks inside its quotes; the first of a file has the edge ``first``."""
    records, _ = cut_records(spark, path, csv_marks, "\n", options)
    text = F.regexp_replace(F.make_valid_utf8(F.col("value").cast("string")), r"\r?\n?\z", "")
    return records.select("file", "edge", text.alias("record")).where(F.col("record") != "")


def csv_cells(record: Column) -> Column:
    """The cells of a CSV record, quotes taken off and doubled ones halved; quotes inside an unquoted cell are text."""

    @F.pandas_udf("array<string>")
    def work(records: pd.Series) -> pd.Series:
        csv.field_size_limit(sys.maxsize)
        return pd.Series([next(csv.reader([r])) for r in records], dtype=object)

    return work(record)
