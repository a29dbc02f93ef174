"""Decisions in and out: JSON round trip, recorded sets, the Parquet ledger, routing events."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagegrid.functions.labels import discard_json, event_json
from triagegrid.functions.pricing import backfill_cost
from triagegrid.operators.ledger import KEY, decisions_in_queue, flatten_decision, list_recent
from triagegrid.schema import DECISION, LEDGER
from triagegrid.session import scratch_path


def decision_to_json(decision: Column) -> Column:
    return F.to_json(decision)


def decision_from_json(text: Column) -> Column:
    """A decision from its JSON text, as it was stored; ``hydrate`` adds costs that were not recorded then."""
    return F.from_json(text, DECISION)


def hydrate(ledger: DataFrame) -> DataFrame:
    """Whole decisions of ledger rows, with any missing cost derived from the recorded tokens."""
    rows = ledger.select(decision_from_json(F.col("decision_json")).alias("d")).select("d.*")
    usage = F.when(
        F.col("usage").isNotNull(), F.col("usage").withField("cost_usd", backfill_cost(F.col("usage"), F.col("model")))
    )
    return rows.withColumn("usage", usage)


def read_recorded_set(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a recorded set: {set, recorded_at, model, decisions: [...]}."""
    wrapper = T.StructType(
        [
            T.StructField("set", T.StringType()),
            T.StructField("recorded_at", T.StringType()),
            T.StructField("model", T.StringType()),
            T.StructField("decisions", T.ArrayType(DECISION)),
        ]
    )
    return spark.read.schema(wrapper).option("multiLine", True).json(path).select(F.inline("decisions"))


LEDGER_PARTITION = "created_date"
#: Lookups by id and by key skip the row groups whose filters rule the value out.
FILTERED = ["id", "external_id"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored ledger with their ``created_date``; none where everything was removed."""
    return spark.read.schema(LEDGER).parquet(path)


def recent_decisions(spark: SparkSession, path: str, limit: int = 100, queue: str | None = None) -> DataFrame:
    """The newest rows of a stored ledger, of one queue if named.

    Rows are counted per date first, which opens at most the queue columns; then only the dates that can hold one of the newest are read.
    The counts, one for each date, reach the driver.
    """
    rows = read_ledger(spark, path)
    counted = (decisions_in_queue(rows, queue) if queue else rows).groupBy(LEDGER_PARTITION).agg(F.count(F.lit(1)).alias("n"))
    have, oldest = 0, None
    dated = sorted(counted.where(F.col(LEDGER_PARTITION).isNotNull()).collect(), key=lambda r: r[0], reverse=True)
    for date, n in dated:
        have, oldest = have + n, date
        if have >= limit:
            break
    newest = rows.where(F.col(LEDGER_PARTITION) >= F.lit(oldest)) if have >= limit > 0 else rows
    return list_recent(newest, limit, queue)


def store_rows(rows: DataFrame, path: str, mode: str) -> None:
    """Files ordered by key within a date, with bloom filters on ``FILTERED``, small where a file is."""
    writer = rows.sortWithinPartitions(LEDGER_PARTITION, "external_id", "id").write.mode(mode).partitionBy(LEDGER_PARTITION)
    for column in FILTERED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    writer.option("parquet.bloom.filter.adaptive.enabled", True).parquet(path)


def write_decisions(decisions: DataFrame, path: str, mode: str = "append", period: str = "day") -> None:
    """Append decisions as audit rows, one per key not yet in the ledger, partitioned by creation date.

    ``period`` (day, month or year) sets how much one partition spans: a partition should hold at
    least one good-sized file.

    One writer per ledger at a time.  Running the same input again adds nothing for rows with an
    external_id.  Decisions are made once, into a scratch table; which of them stay is found on its narrow columns, and only the whole
    rows that stay are read and dealt.  ``rebalance`` sizes the files: small dates share a task, and a date holding most of
    the rows (a replay restates all of them to now) is split over many.
    """
    spark = decisions.sparkSession
    resume_removals(spark, path)
    scratch = scratch_path(spark, "decided")
    staged_rows = staged(flatten_decision(decisions), scratch)
    held = read_ledger(spark, path) if mode == "append" and path_exists(spark, path) else None
    keyed = staged_rows.where(F.col("external_id").isNotNull())
    stay = first_rows(keyed, held).select("_file", "_row")
    rows = keyed.join(stay, ["_file", "_row"], "left_semi").unionByName(staged_rows.where(F.col("external_id").isNull())).drop("_file", "_row")
    dated = rows.withColumn(LEDGER_PARTITION, F.to_date(F.date_trunc(period, "created_at"))).hint("rebalance", LEDGER_PARTITION)
    store_rows(dated, path, mode)
    _files(spark, scratch).delete(_path(spark, scratch), True)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once and read back, each with its place (``_file``, ``_row``): equal rows are told apart the same way at every reading."""
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return back.select(*rows.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def first_rows(rows: DataFrame, held: DataFrame | None) -> DataFrame:
    """(source, external_id, _file, _row) of the earliest row of every key that ``held`` lacks; narrow, and combined before the shuffle."""
    order = F.struct("created_at", "id", "_file", "_row")
    first = rows.groupBy("source", "external_id").agg(F.min(order).alias("_first"))
    if held is not None:
        keys = held.where(F.col("external_id").isNotNull()).select(F.col("source").alias("_s"), F.col("external_id").alias("_e"))
        first = first.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.col("external_id") == F.col("_e")), "left_anti")
    return first.select("source", "external_id", "_first._file", "_first._row")


def path_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: Removals in progress, below the ledger; readers of the ledger pass over the name.
REMOVALS = "_removals"


def remove_decision(spark: SparkSession, path: str, decision: str) -> int:
    """Take one decision out of a stored ledger by its id; returns how many files were rewritten.  An unknown id touches none."""
    return _remove(spark, path, F.col("id") == decision)


def clear_ledger(spark: SparkSession, path: str, keep_source: str | None = None) -> int:
    """Empty a stored ledger but for one source; returns how many files were rewritten or went whole.  Files with that source alone stay as they are."""
    return _remove(spark, path, ~F.col("source").eqNullSafe(keep_source) if keep_source else F.lit(True))


def _remove(spark: SparkSession, path: str, goes: Column) -> int:
    """Copy on write: the files that hold a row to remove are found on narrow columns, and only they are written anew.

    The new files are complete, and the list of old ones is written, before anything changes; then new ones move in and old ones go.
    A removal that was interrupted is finished by the next one or the next write (``resume_removals``), whichever step it had reached.  One writer
    at a time; a reader between the two last steps can see a row twice.
    """
    resume_removals(spark, path)
    if not path_exists(spark, path):
        return 0
    rows = read_ledger(spark, path)
    touched = [r.file for r in rows.where(goes).select(F.col("_metadata.file_path").alias("file")).distinct().collect()]
    if not touched:
        return 0
    uri = spark._jvm.java.net.URI
    touched = [spark._jvm.org.apache.hadoop.fs.Path(uri(f)).toString() for f in touched]
    work = f"{path}/{REMOVALS}/{uuid.uuid4().hex}"
    kept = spark.read.schema(rows.schema).option("basePath", path).parquet(*touched).where(~F.coalesce(goes, F.lit(False)))
    store_rows(kept.hint("rebalance", LEDGER_PARTITION), f"{work}/new", "overwrite")
    spark.createDataFrame([(f,) for f in touched], "file string").coalesce(1).write.text(f"{work}/old")
    resume_removals(spark, path)
    return len(touched)


def resume_removals(spark: SparkSession, path: str) -> None:
    """Finish removals whose list of old files is whole; put aside those that had not got so far."""
    top = f"{path}/{REMOVALS}"
    if not path_exists(spark, top):
        return
    files = _files(spark, path)
    for status in files.listStatus(_path(spark, top)):
        work = status.getPath().toString()
        if path_exists(spark, f"{work}/old/_SUCCESS"):
            for part in files.globStatus(_path(spark, f"{work}/new/{LEDGER_PARTITION}=*")):
                home = f"{path}/{part.getPath().getName()}"
                files.mkdirs(_path(spark, home))
                for file in files.listStatus(part.getPath()):
                    if not file.getPath().getName().startswith((".", "_")):
                        files.rename(file.getPath(), _path(spark, f"{home}/{file.getPath().getName()}"))
            for row in spark.read.text(f"{work}/old").collect():
                files.delete(_path(spark, row.value), False)
        files.delete(_path(spark, work), True)
    files.delete(_path(spark, top), True)


def decision_events(decisions: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """One JSON event per decision that counts and per submission that was discarded, as a single text column.

    ``settled`` (see ``ledger.authoritative``) tells the two apart; without it every decision counts.
    """
    d = F.struct(*decisions.columns)
    if settled is None:
        return decisions.select(event_json(d).alias("value"))
    gone = settled.where("discarded")
    kept = decisions.join(gone.select(F.col("submitted_id").alias("id")).distinct(), "id", "left_anti").select(*decisions.columns)
    lost = gone.select(discard_json(F.col("submitted_id"), F.col("id"), F.col("source"), F.col("external_id")).alias("value"))
    return kept.select(event_json(d).alias("value")).unionByName(lost)


#: Fields of a decision's extraction that its event tells.
TOLD = ["category", "urgency", "escalate", "escalation_reasons"]


def decided_for_events(decisions: DataFrame, path: str) -> DataFrame:
    """Decisions made once, into a table at ``path``, and read back: all rows, and the fields that their events and their settling read.

    Whoever settles and writes the events of decisions that are not stored has every ticket read anew for each: three times in a write.
    """
    ticket, x = F.col("ticket"), F.col("extraction")
    narrow = {
        "ticket": F.struct(*[ticket[c].alias(c) for c in KEY]),
        "extraction": F.struct(*[x[c].alias(c) for c in TOLD]),
        "rule_hits": F.transform("rule_hits", lambda h: F.struct(h["rule"].alias("rule"))),
    }
    kept = [c for c in decisions.columns if c not in ("model", "llm_extraction", "error")]
    rows = decisions.select(*[narrow.get(c, F.col(c)).alias(c) for c in kept])
    rows.write.mode("overwrite").parquet(path)
    return decisions.sparkSession.read.schema(rows.schema).parquet(path)


EVENT_BATCH = "event_batch"


def write_decision_events(decisions: DataFrame, path: str, batch: str | int | None = None, settled: DataFrame | None = None, mode: str = "append") -> None:
    """Write ``decision_events``, those of discarded submissions included where ``settled`` tells them.

    ``batch`` names the submissions: their events go to a folder of that name, which a repeated write replaces, so that each event stands once
    however often a job is retried.  Without it the events are written by ``mode``.
    """
    events = decision_events(decisions, settled)
    if batch is None:
        events.write.mode(mode).text(path)
    else:
        events.write.mode("overwrite").text(f"{path}/{EVENT_BATCH}={batch}")


def read_decision_events(spark: SparkSession, path: str) -> DataFrame:
    """The event lines of all batches (``value``)."""
    return spark.read.text(path).select("value")
