"""The tickets behind the numbers, as rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.functions.ordinal import urgency_rank
from triagegrid.operators.scoring import join_gold


def escalation_evidence(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every ticket that must escalate: was it caught, did the model alone catch it, did a rule match?

    One row per ticket with its group; a list per group would hold a third of all tickets.
    """
    d = F.col("decision")
    pairs = join_gold(gold.where(F.col("expected.escalate")), decisions)
    return pairs.select(
        "group",
        "id",
        "text",
        d["extraction"]["escalate"].alias("caught"),
        F.coalesce(d["llm_extraction"]["escalate"], F.lit(False)).alias("model_alone"),
        # Only rules that carry a reason count; the spam exception does not.
        (F.array_size(F.array_compact(d["rule_hits"]["reason"])) > 0).alias("keywords"),
    )


def escalation_evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("group").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if("caught").alias("caught"),
        F.count_if(F.col("caught") & ~F.col("keywords")).alias("caught_without_keyword"),
    )


def model_mistakes(gold: DataFrame, runs: DataFrame, by: Sequence[str] = ("model", "effort")) -> DataFrame:
    """Per run: tickets wrongly escalated (false), read as calmer (low), or missed, one row each.

    ``runs`` has the ``by`` columns, ``id`` and a ``decision`` struct.
    """
    e, x = F.col("expected"), F.col("decision.extraction")
    amb = F.coalesce(F.col("ambiguous"), F.array().cast("array<string>"))
    lower = urgency_rank(x["urgency"]) < urgency_rank(e["urgency"])
    none = F.array().cast("array<struct<kind:string,said:string,expected_urgency:string,borderline:boolean>>")

    def entry(kind: str, said: Column | None = None, wanted: Column | None = None, borderline: Column | None = None) -> Column:
        return F.array(
            F.struct(
                F.lit(kind).alias("kind"),
                (said if said is not None else F.lit(None).cast("string")).alias("said"),
                (wanted if wanted is not None else F.lit(None).cast("string")).alias("expected_urgency"),
                (borderline if borderline is not None else F.lit(None).cast("boolean")).alias("borderline"),
            )
        )

    kinds = F.concat(
        F.when(~e["escalate"] & x["escalate"] & ~F.array_contains(amb, "escalate"), entry("false")).otherwise(none),
        F.when(lower, entry("low", x["urgency"], e["urgency"], F.array_contains(amb, "urgency"))).otherwise(none),
        F.when(e["escalate"] & ~x["escalate"], entry("missed")).otherwise(none),
    )
    return gold.join(runs, "id").select(*by, "id", "text", F.inline(kinds))


def model_mistake_counts(mistakes: DataFrame, by: Sequence[str] = ("model", "effort")) -> DataFrame:
    kind = F.col("kind")
    return mistakes.groupBy(*by).agg(
        F.count_if(kind == "false").alias("false"), F.count_if(kind == "low").alias("low"), F.count_if(kind == "missed").alias("missed")
    )
