"""Shape of the pile, health of the model, and invariants every decision must keep."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.ordinal import urgency_rank


def dashboard_filter(df: DataFrame, urgency: str | None = None, category: str | None = None, needs_human: bool | None = None) -> DataFrame:
    """Any number on the dashboard is one of these filters on the list (flat audit rows)."""
    if urgency is not None:
        df = df.where(F.col("urgency") == urgency)
    if category is not None:
        df = df.where(F.col("category") == category)
    if needs_human is not None:
        flag = F.col("escalate").cast("boolean")
        df = df.where(flag if needs_human else ~flag)
    return df


def sort_decisions(df: DataFrame, by: str = "recent") -> DataFrame:
    """recent, most urgent, longest, quickest or category.

    Every order ends in created_at and id, so the range partitioner can split a value that fills a
    third of the rows.
    """
    lead = {
        "recent": [],
        "most urgent": [urgency_rank(F.col("urgency")).desc()],
        "longest": [F.col("latency_ms").desc()],
        "quickest": [F.col("latency_ms").asc()],
        "category": [F.col("category").asc()],
    }[by]
    return df.orderBy(*lead, F.col("created_at").desc(), F.col("id").desc())


def dashboard(df: DataFrame) -> DataFrame:
    """Long form (section, name, value) of the figures on the dashboard.

    ``df`` has urgency, category, escalate, mode, latency_ms, cost_usd.  One pass: rows are folded to
    one per (urgency, category), and the sections are cut from those few dozen rows.
    """
    cells = df.groupBy("urgency", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("escalate").cast("boolean")).alias("human"),
        F.count_if(F.col("mode") != L.MODE_MODEL).alias("failed"),
        F.sum("latency_ms").alias("ms"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd"),
    )

    def cell(section: str, name: Column | str, value: str) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(name) if isinstance(name, str) else name).alias("name"),
            F.col(value).cast("double").alias("value"),
        )

    long = cells.select(
        F.inline(
            F.array(
                cell("total", "tickets", "n"),
                cell("total", "needs human", "human"),
                cell("total", "failed extractions", "failed"),
                cell("total", "read time ms", "ms"),
                cell("total", "spend usd", "usd"),
                cell("urgency", F.col("urgency"), "n"),
                cell("category", F.col("category"), "n"),
            )
        )
    )
    return long.groupBy("section", "name").agg(F.sum("value").alias("value"))


def model_health(df: DataFrame) -> DataFrame:
    """Outcome of the latest read that tried a model: ok, failing, or unknown when none did."""
    tried = df.where(F.col("mode").isin(L.MODE_MODEL, L.MODE_FALLBACK))
    last = tried.agg(F.max_by(F.struct("mode", "created_at", "error"), F.struct("created_at", "id")).alias("last"))
    mode = F.col("last.mode")
    status = F.when(mode.isNull(), F.lit("unknown")).when(mode == L.MODE_MODEL, F.lit("ok")).otherwise(F.lit("failing"))
    return last.select(
        (status != "failing").alias("ok"),
        status.alias("last_model_call"),
        F.col("last.created_at").alias("last_model_call_at"),
        F.when(status == "failing", F.substring("last.error", 1, 300)).alias("last_model_error"),
    )


def invariants(decisions: DataFrame, expected_fallback_source: str = "recorded:failures") -> DataFrame:
    """Named checks over whole decisions: check, violations, passed."""
    x, who = F.col("extraction"), F.col("extraction.customer")

    def given(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    fallback = (F.col("mode") == L.MODE_FALLBACK) & ~F.col("ticket.source").eqNullSafe(expected_fallback_source)
    named = given(who["name"])
    checks = {
        "queue never empty": given(F.col("queue")),
        "every field carries a reason": given(x["customer_reason"]) & given(x["category_reason"]) & given(x["urgency_reason"]) & given(x["escalation_reason_text"]),
        "no unexpected fallback": ~fallback,
        "confidence within 0 and 1": who["confidence"].between(0.0, 1.0) & x["category_confidence"].between(0.0, 1.0),
        "a stated name is a confident one": ~named | (who["confidence"] >= 0.9),
        "a stated name occurs in the text": ~named | F.contains(F.lower("ticket.text"), F.lower(who["name"])),
        "a guess carries its basis": (F.size(who["basis"]) > 0) | (who["confidence"] == 0.0),
    }
    # A check that cannot be evaluated (a null field) counts as violated.
    bad = decisions.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("violations")) for name in checks])
    return bad.select(F.inline(rows)).select("check", "violations", (F.col("violations") == 0).alias("passed"))
