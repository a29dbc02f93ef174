"""The decision ledger: idempotent appends, and the reads on top of it.

A ledger row is a flattened decision (``schema.AUDIT_COLUMNS``).  The logical key is
``(source, external_id)`` for rows that have an external_id; rows without one are never merged.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.functions.labels import decision_id
from triagegrid.functions.pricing import backfill_cost
from triagegrid.schema import AUDIT_COLUMNS

KEY = ["source", "external_id"]


def flatten_decision(decisions: DataFrame, *extra: str) -> DataFrame:
    """The audit columns of a decision, the last one holding the whole record as JSON."""
    x = F.col("extraction")
    flat = {
        "source": F.col("ticket.source"),
        "external_id": F.col("ticket.external_id"),
        "ticket_text": F.col("ticket.text"),
        "category": x["category"],
        "urgency": x["urgency"],
        "escalate": x["escalate"].cast("int"),
        "decision_json": F.to_json(F.struct(*[c for c in decisions.columns if c not in extra])),
    }
    return decisions.select(*[flat.get(name, F.col(name)).alias(name) for name in AUDIT_COLUMNS], *extra)


def _one_per_key(df: DataFrame, pick, but: DataFrame | None = None) -> DataFrame:
    """Keep one row per key, ``but`` for the keys of another ledger: the winners are found on narrow rows, then the whole rows meet them.

    Finding is an aggregate of key, time and id, combined on the map side: a key holding a third of all rows reaches the shuffle as one
    row per task.  Whole rows are dealt by id as well as key, once, so a hot key is spread, and equal rows fall together where they land.
    Rows without external_id pass by without a shuffle.
    """
    time, name = F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("id", F.lit(""))
    # A null source is a source of its own, which plain equality then knows.
    key = {"_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_e": F.col("external_id")}
    mark = {**key, "_t": time, "_i": name}
    keyed = df.where(F.col("external_id").isNotNull()).withColumns(mark)
    best = pick(F.struct("_t", "_i"), F.struct("created_at", "id"))
    winners = keyed.groupBy("_s", "_e").agg(best.alias("_first")).select("_s", "_e", "_first._t", "_first._i")
    if but is not None:
        held = _keys_of(but)
        winners = winners.join(held.select(*[v.alias(k) for k, v in key.items()]), list(key), "left_anti")
    return keyed.join(winners, list(mark), "left_semi").distinct().select(*df.columns)


def dedupe_earliest(df: DataFrame) -> DataFrame:
    """Earliest row per key; equal times are settled by id."""
    loose = df.where(F.col("external_id").isNull())
    return _one_per_key(df, F.min_by).unionByName(loose)


def latest_by_key(df: DataFrame) -> DataFrame:
    """Most recent row per key; equal times are settled by id."""
    return _one_per_key(df, F.max_by)


def find_by_external(df: DataFrame, source: str, external_id: str) -> DataFrame:
    hit = df.where((F.col("source") == source) & (F.col("external_id") == external_id))
    return hit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def _keys_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("external_id").isNotNull()).select(*KEY)


def new_tickets(tickets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tickets whose key the ledger does not hold: run this before the expensive read.

    Tickets without external_id are always new and pass by the join; the ledger's keys are distinct before they meet.
    """
    keyed = tickets.where(F.col("external_id").isNotNull()).join(_keys_of(ledger).distinct(), KEY, "left_anti").select(*tickets.columns)
    return keyed.unionByName(tickets.where(F.col("external_id").isNull()))


def insert_or_ignore(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ``new`` to append: one per unseen key, and every row without external_id.

    Winners and the ledger meet on keys alone, each key once.
    """
    return _one_per_key(new, F.min_by, but=ledger).unionByName(new.where(F.col("external_id").isNull()))


#: Parts that the submissions of a key are dealt to, at most, when they meet their winner.
SALTS = 16


def authoritative(new: DataFrame, ledger: DataFrame, salts: int = SALTS) -> DataFrame:
    """For each submitted decision, the decision that counts.

    Returns source, external_id, submitted_id, id (of the winner) and discarded.  Only ids and keys are moved.  A key has one
    winner however often it was sent: submissions are dealt to ``salts`` parts by their id and meet a copy of the winner in each that
    holds one of them, so no task holds a whole key and there are never more copies than submissions.
    """
    keyed = new.where(F.col("external_id").isNotNull())

    def part(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(salts)).cast("int")

    winners = (
        ledger.where(F.col("external_id").isNotNull())
        .select(*KEY, "created_at", "id", F.lit(0).alias("_turn"), F.lit(None).cast("int").alias("_part"))
        .unionByName(keyed.select(*KEY, "created_at", "id", F.lit(1).alias("_turn"), part("id").alias("_part")))
        .groupBy(*KEY)
        .agg(F.min(F.struct("_turn", "created_at", "id")).alias("_first"), F.collect_set("_part").alias("_parts"))
        # A key that the ledger alone holds has no part.
        .select(*KEY, F.col("_first.id").alias("_winner"), F.explode("_parts").alias("_salt"))
    )
    sent = new.select(*KEY, F.col("id").alias("submitted_id"))
    asked = sent.where(F.col("external_id").isNotNull()).withColumn("_salt", part("submitted_id"))
    # Not broadcast: there are as many keys as the batch has, and a stored batch looks smaller than it is.
    settled = asked.join(winners.hint("merge"), [*KEY, "_salt"]).drop("_salt")
    loose = sent.where(F.col("external_id").isNull()).select("*", F.col("submitted_id").alias("_winner"))
    return settled.unionByName(loose).select(
        *KEY, "submitted_id", F.col("_winner").alias("id"), (F.col("_winner") != F.col("submitted_id")).alias("discarded")
    )


def record(new: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert-or-ignore: (the ledger afterwards, the authoritative decision per submission)."""
    return ledger.unionByName(insert_or_ignore(new, ledger)), authoritative(new, ledger)


def replay_decisions(decisions: DataFrame, set_name: str, now: Column) -> DataFrame:
    """Decisions of an earlier run, restated as entering this store now.

    The reading is kept; source names the set, so a second replay meets its own keys and adds nothing.
    """
    t = F.col("ticket")
    source = F.lit(f"recorded:{set_name}")
    usage = F.when(
        F.col("usage").isNotNull(), F.col("usage").withField("cost_usd", backfill_cost(F.col("usage"), F.col("model")))
    )
    changed = {
        "id": decision_id(F.lit("replay"), source, F.col("id"), now),
        "created_at": now.cast("timestamp"),
        "ticket": F.struct(t["text"].alias("text"), source.alias("source"), t["external_id"].alias("external_id")),
        "usage": usage,
    }
    return decisions.select(*[changed.get(c, F.col(c)).alias(c) for c in decisions.columns])


def decisions_in_queue(df: DataFrame, queue: str) -> DataFrame:
    return df.where((F.col("queue") == queue) | (F.col("escalation_queue") == queue))


def decision_by_id(df: DataFrame, decision: str) -> DataFrame:
    return df.where(F.col("id") == decision)


def without_decision(df: DataFrame, decision: str) -> DataFrame:
    return df.where(F.col("id") != decision)


def keep_source(df: DataFrame, source: str | None = None) -> DataFrame:
    """What is left after clearing everything except one source; no source clears all."""
    return df.where(F.col("source").eqNullSafe(source)) if source else df.where(F.lit(False))


def list_recent(df: DataFrame, limit: int = 100, queue: str | None = None) -> DataFrame:
    rows = decisions_in_queue(df, queue) if queue else df
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def reconcile(before: DataFrame, after: DataFrame, accepted: DataFrame) -> DataFrame:
    """Exactly-once check of a load: rows added against accepted requests, and accepted ids not stored."""
    lost = accepted.select("id").join(after.select("id"), "id", "left_anti")
    counts = [(before, "rows_before"), (after, "rows_after"), (accepted, "accepted"), (lost, "not_stored")]
    tagged = None
    for df, name in counts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        tagged = one if tagged is None else tagged.unionByName(one)
    got = tagged.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for _, name in counts])
    added = F.col("rows_after") - F.col("rows_before")
    return got.select(
        "*", added.alias("added"), ((added == F.col("accepted")) & (F.col("not_stored") == 0)).alias("exact")
    )
