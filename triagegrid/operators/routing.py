"""Queue lookup.  The table is small and known when the plan is built, so it is an expression."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.session import inline_rows


@dataclass(frozen=True)
class RoutingTable:
    routes: Sequence[tuple[str, str | None, str]] = field(default_factory=lambda: tuple(L.ROUTES))
    escalation_queue: str = L.ESCALATION_QUEUE
    low_confidence_queue: str | None = L.LOW_CONFIDENCE_QUEUE
    threshold: float = L.LOW_CONFIDENCE_THRESHOLD

    def queue_names(self) -> list[str]:
        names = {queue for _, _, queue in self.routes} | {self.escalation_queue}
        return sorted(names | ({self.low_confidence_queue} if self.low_confidence_queue else set()))


STANDARD = RoutingTable()


def queue_for(category: Column, urgency: Column, escalate: Column, confidence: Column, table: RoutingTable = STANDARD) -> Column:
    """An unsure, unescalated ticket goes to a person; an unknown category goes where 'other' goes."""
    default = {cat: queue for cat, level, queue in table.routes if level is None}
    by_level = [(cat, level, queue) for cat, level, queue in table.routes if level is not None]
    chosen = None
    if table.low_confidence_queue:
        chosen = F.when(~escalate & (confidence < table.threshold), F.lit(table.low_confidence_queue))
    steps = [((category == cat) & (urgency == level), queue) for cat, level, queue in by_level]
    steps += [(category == cat, queue) for cat, queue in default.items()]
    for cond, queue in steps:
        chosen = F.when(cond, F.lit(queue)) if chosen is None else chosen.when(cond, F.lit(queue))
    other = F.lit(default["other"])
    for cat, level, queue in by_level:
        if cat == "other":
            other = F.when(urgency == level, F.lit(queue)).otherwise(other)
    return chosen.otherwise(other)


def escalation_queue_for(escalate: Column, table: RoutingTable = STANDARD) -> Column:
    return F.when(escalate, F.lit(table.escalation_queue))


def route(df: DataFrame, table: RoutingTable = STANDARD) -> DataFrame:
    """Add ``queue`` and ``escalation_queue`` to rows of category, urgency, escalate, category_confidence."""
    return df.select(
        "*",
        queue_for(F.col("category"), F.col("urgency"), F.col("escalate"), F.col("category_confidence"), table).alias("queue"),
        escalation_queue_for(F.col("escalate"), table).alias("escalation_queue"),
    )


def routing_table(spark: SparkSession, table: RoutingTable = STANDARD) -> DataFrame:
    """Long form: category, urgency (``default`` for the category's default), queue."""
    rows = [(cat, level or "default", queue) for cat, level, queue in table.routes]
    rows += [("*", "escalated", table.escalation_queue)]
    if table.low_confidence_queue:
        rows += [("*", "low_confidence", table.low_confidence_queue)]
    return inline_rows(spark, ["category", "urgency", "queue"], rows)


def all_queues(spark: SparkSession, table: RoutingTable = STANDARD) -> DataFrame:
    return inline_rows(spark, ["name"], [(name,) for name in table.queue_names()])


def queue_counts(decisions: DataFrame) -> DataFrame:
    """Tickets per queue; an escalated ticket counts in its queue and in the escalation queue.

    Counted once per (queue, escalation queue) pair before the pair is taken apart, so the explode
    runs over a few dozen rows rather than over the tickets.
    """
    pairs = decisions.groupBy("queue", "escalation_queue").agg(F.count(F.lit(1)).alias("n"))
    return (
        pairs.select(F.explode(F.array("queue", "escalation_queue")).alias("name"), "n")
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.sum("n").alias("count"))
    )


def queue_depths(decisions: DataFrame, table: RoutingTable = STANDARD) -> DataFrame:
    """Every configured queue with its depth, zero when empty.

    The counted side has at most one row per queue name, and so has the table.
    """
    names = all_queues(decisions.sparkSession, table)
    return names.join(queue_counts(decisions), "name", "left").select(
        "name", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )
