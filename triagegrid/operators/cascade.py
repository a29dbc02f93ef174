"""Two readers: which one does a ticket need, what did the choice cost, did it pay?"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.labels import two_places
from triagegrid.functions.ordinal import RANK, urgency_rank
from triagegrid.functions.pricing import cost_usd, merge_usage, usd6
from triagegrid.functions.text import fill
from triagegrid.operators.decide import decide
from triagegrid.operators.routing import STANDARD
from triagegrid.operators.scoring import scorecard
from triagegrid.schema import CASCADE_NOTE

STAKES = RANK["high"]


def needs_second_read(escalate: Column, urgency: Column, confidence: Column, threshold: float = STANDARD.threshold) -> Column:
    """struct<reread, why> of a draft: high stakes, or doubt about the category."""

    def said(reread: bool, why: Column) -> Column:
        return F.struct(F.lit(reread).alias("reread"), why.alias("why"))

    return (
        F.when(escalate, said(True, F.lit(L.WHY_DRAFT_ESCALATED)))
        .when(urgency_rank(urgency) >= STAKES, said(True, fill(L.WHY_DRAFT_URGENT, value=urgency)))
        .when(confidence < threshold, said(True, fill(L.WHY_DRAFT_UNSURE, value=two_places(confidence))))
        .otherwise(said(False, F.lit(L.WHY_DRAFT_STANDS)))
    )


def triage(rule_hits: Column, urgency: Column) -> Column:
    """struct<expensive, why> of a keyword decision, before any model is paid."""
    topics = F.array_join(
        F.array_sort(F.array_distinct(F.transform(rule_hits["rule"], lambda r: F.substring_index(r, ".", 1)))), ", "
    )

    def said(expensive: bool, why: Column) -> Column:
        return F.struct(F.lit(expensive).alias("expensive"), why.alias("why"))

    return (
        F.when(F.size(rule_hits) > 0, said(True, fill(L.WHY_RULE_MATCHED, value=topics)))
        .when(urgency_rank(urgency) >= STAKES, said(True, fill(L.WHY_KEYWORD_URGENCY, value=urgency)))
        .otherwise(said(False, F.lit(L.WHY_CHEAP)))
    )


def triage_by_rules(tickets: DataFrame, **kw) -> DataFrame:
    """Decide by keywords and add ``expensive`` and ``why``: run this before any model is paid."""
    d = decide(tickets, **kw)
    verdict = triage(F.col("rule_hits"), F.col("extraction.urgency"))
    return d.select("*", verdict.alias("_verdict")).select(*d.columns, "_verdict.*")


def cascade_by_rules(triaged: DataFrame, cheap: DataFrame, expensive: DataFrame) -> DataFrame:
    """The answers a rules cascade ships: one read per ticket, by the reader triage chose.

    ``triaged`` has ticket_key, expensive and why; the other two are ANSWER tables, of which only the
    chosen reader's row is used.
    """
    keyed = triaged.select("ticket_key", F.col("expensive").alias("_exp"), F.col("why").alias("_why"))
    # Both readers' answers in one side of one join, so that tickets are triaged once.
    given = cheap.withColumn("_exp", F.lit(False)).unionByName(expensive.withColumn("_exp", F.lit(True)))
    chosen = given.join(keyed, ["ticket_key", "_exp"]).select(*cheap.columns, "_exp", "_why")
    note = _note(triage=F.lit("rules"), expensive=F.col("_exp"), why=F.col("_why"), reader=F.col("model"))
    usage = _priced(F.col("usage"), F.col("model"), cost_usd(F.col("usage"), F.col("model"))).withField("cascade", note)
    return chosen.select(*[usage.alias(c) if c == "usage" else F.col(c) for c in cheap.columns])


def cascade_by_draft(drafts: DataFrame, finals: DataFrame, threshold: float = STANDARD.threshold) -> DataFrame:
    """The answers a draft cascade ships: the draft where it stands, else the second read.

    Both reads were paid for, so token counts add up.  ``cost_usd`` prices the merged tokens at the
    shipped model's rate; ``cost_usd_by_reader`` prices each read at its own.
    """
    d, f = F.col("_d.extraction"), F.col("_f.extraction")
    verdict = needs_second_read(d["escalate"], d["urgency"], d["category_confidence"], threshold)
    judged = drafts.alias("_d").select("*", verdict.alias("_verdict"))
    joined = judged.alias("_d").join(finals.alias("_f"), (F.col("_d.ticket_key") == F.col("_f.ticket_key")) & F.col("_d._verdict.reread"), "left")
    reread = F.col("_d._verdict.reread")
    draft_cost = cost_usd(F.col("_d.usage"), F.col("_d.model"))
    changed = ~(
        d["category"].eqNullSafe(f["category"]) & d["urgency"].eqNullSafe(f["urgency"]) & d["escalate"].eqNullSafe(f["escalate"])
    )
    note = _note(
        triage=F.lit("draft"),
        draft_model=F.col("_d.model"),
        reread=reread,
        why=F.col("_d._verdict.why"),
        draft_cost_usd=F.when(draft_cost != 0, usd6(draft_cost)),
        draft_said=F.when(
            reread, F.struct(d["category"].alias("category"), d["urgency"].alias("urgency"), d["escalate"].alias("escalate"))
        ),
        changed=F.when(reread, changed),
    )
    usage = F.when(reread, merge_usage(F.col("_d.usage"), F.col("_f.usage"))).otherwise(F.col("_d.usage"))
    model = F.when(reread, F.col("_f.model")).otherwise(F.col("_d.model"))
    own = draft_cost + F.when(reread, F.coalesce(cost_usd(F.col("_f.usage"), F.col("_f.model")), F.lit(0.0))).otherwise(F.lit(0.0))
    shipped = joined.select(
        F.col("_d.ticket_key").alias("ticket_key"),
        model.alias("model"),
        F.when(reread, f).otherwise(d).alias("extraction"),
        usage.alias("_usage"),
        own.alias("_own"),
        note.alias("_cascade"),
        (F.col("_d.latency_ms") + F.when(reread, F.col("_f.latency_ms")).otherwise(F.lit(0))).alias("latency_ms"),
        F.when(reread, F.col("_f.error")).otherwise(F.col("_d.error")).alias("error"),
    )
    usage = _priced(F.col("_usage"), F.col("model"), F.col("_own")).withField("cascade", F.col("_cascade"))
    return shipped.select("ticket_key", "model", "extraction", usage.alias("usage"), "latency_ms", "error")


def _priced(usage: Column, model: Column, by_reader: Column) -> Column:
    return usage.withField("cost_usd", usd6(cost_usd(usage, model))).withField("cost_usd_by_reader", usd6(by_reader))


def _note(**given: Column) -> Column:
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CASCADE_NOTE])


QUALITY = ["missed_escalations", "false_escalations", "urgency_under", "urgency_never_under_critical", "category_accuracy"]


def cascade_quality(scores: DataFrame, cascade: str = "cascade", base: str = "base") -> DataFrame:
    """What the saving costs: one row with the failures of the cascade and, as ``base_...``, of the dear reader on every ticket.

    ``scores`` holds both runs, see ``decide_runs`` and ``scoring.score(..., also=["run"])``; one pass over them.
    """
    cards = scorecard(scores, ["run"])
    both = [(cascade, ""), (base, "base_")]
    # One row a run is left: the first of either is its only one.
    return cards.agg(*[F.first(F.when(F.col("run") == run, F.col(m)), ignorenulls=True).alias(prefix + m) for run, prefix in both for m in QUALITY])


def cascade_report(shipped: DataFrame, base: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Did the cascade pay?  One row over cascade answers and over the base run's answers; with ``scores`` also at what cost in quality.

    Spend is reported by both pricing rules, because pricing a cheap draft's tokens at the dear
    model's rate overstates the cost of a draft cascade.
    """
    note = F.col("usage.cascade")
    dear = F.when(note["triage"] == "rules", note["expensive"]).otherwise(note["reread"])
    cost = F.coalesce(F.col("usage.cost_usd"), F.lit(0.0))
    own = F.coalesce(F.col("usage.cost_usd_by_reader"), F.lit(0.0))
    left = shipped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(dear).alias("reread"),
        F.count_if(note["changed"]).alias("changed"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum(own), F.lit(0.0)).alias("spend_by_reader"),
        F.avg(cost).alias("mean_cost"),
        F.avg(F.when(dear, cost)).alias("mean_cost_reread"),
    )
    right = base.agg(F.coalesce(F.sum(cost_usd(F.col("usage"), F.col("model"))), F.lit(0.0)))
    both = left.withColumn("base_spend", right.scalar())
    quality = []
    if scores is not None:
        found = cascade_quality(scores)
        both = both.withColumn("_quality", found.select(F.struct(*found.columns)).scalar())
        quality = [F.col("_quality")[c].alias(c) for c in found.columns]
    return both.select(
        "n",
        "reread",
        F.try_divide("reread", "n").alias("reread_share"),
        "changed",
        "spend",
        "spend_by_reader",
        "base_spend",
        (1 - F.try_divide("spend", "base_spend")).alias("saving"),
        (1 - F.try_divide("spend_by_reader", "base_spend")).alias("saving_by_reader"),
        "mean_cost",
        "mean_cost_reread",
        *quality,
    )
