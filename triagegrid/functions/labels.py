"""Renderings of a decision: names, routes, explanations, events, ids."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.text import fill


def who_label(customer: Column) -> Column:
    return F.coalesce(
        customer["name"],
        fill(L.WHO_GUESSED, value=F.nullif(customer["best_guess"], F.lit(""))),
        F.lit(L.WHO_NOT_STATED),
    )


def route_label(queue: Column, escalation_queue: Column) -> Column:
    return F.concat_ws(" + ", queue, escalation_queue)


def answer_label(category: Column, urgency: Column, escalate: Column) -> Column:
    return F.concat_ws("/", category, urgency, F.when(escalate, F.lit("ESC")).otherwise(F.lit("-")))


def two_places(value: Column) -> Column:
    return F.format_string("%.2f", value)


def utc_iso_millis(ts: Column) -> Column:
    """ISO-8601 with milliseconds; the session time zone is UTC, rendered as +00:00."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def decision_id(*parts: Column, length: int = 32) -> Column:
    """A hex id that is the same on every rerun of the same input.

    Field lengths go into the hash, so values cannot run into each other.  Twelve digits are enough
    for a small store; 32 (the default) keep ids apart over billions of rows.
    """
    fields = []
    for part in parts:
        text = part.cast("string")
        fields += [F.coalesce(F.length(text).cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))]
    return F.substring(F.sha2(F.concat_ws(":", *fields), 256), 1, length)


def alternatives_share(confidence: Column, alternatives: Column) -> Column:
    """Primary confidence plus the alternatives' shares; expected to be about one."""
    return confidence + F.aggregate(alternatives, F.lit(0.0), lambda total, a: total + a["confidence"])


def shares_sum_to_one(confidence: Column, alternatives: Column, tolerance: float = 0.05) -> Column:
    total = F.round(alternatives_share(confidence, alternatives), 9)
    return total.between(1.0 - tolerance, 1.0 + tolerance)


def _quoted(value: Column) -> Column:
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    single, double = F.lit("'"), F.lit('"')
    return F.when(
        F.contains(value, single) & ~F.contains(value, double), F.concat(double, plain, double)
    ).otherwise(F.concat(single, F.replace(plain, single, F.lit("\\'")), single))


def _quoted_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, _quoted), ", "), F.lit("]"))


def _list_or_dash(values: Column) -> Column:
    return F.when(F.size(values) > 0, _quoted_list(values)).otherwise(F.lit("-"))


def explain_text(d: Column) -> Column:
    """One plain-text explanation per decision: the fields, why, the rules that fired, overrides.

    ``d`` is a struct of the DECISION schema.  Optional lines are null and drop out of the join.
    """
    x, who = d["extraction"], d["extraction"]["customer"]
    guess = fill(L.EXPLAIN_GUESS, guess=who["best_guess"], confidence=two_places(who["confidence"]))
    sender = F.coalesce(F.nullif(who["name"], F.lit("")), F.when(who["best_guess"] != "", guess), F.lit(L.EXPLAIN_NOBODY))
    basis = F.when(F.size(who["basis"]) > 0, fill(L.EXPLAIN_BASIS, value=_quoted_list(who["basis"]))).otherwise(F.lit(""))
    second = F.coalesce(fill(L.EXPLAIN_SECOND_ROUTE, value=d["escalation_queue"]), F.lit(""))
    fired = F.transform(d["rule_hits"], lambda h: fill(L.EXPLAIN_RULE, rule=h["rule"], matched=h["matched"], effect=h["effect"]))
    said = F.transform(d["overrides"], lambda o: fill(L.EXPLAIN_OVERRIDE, value=o))
    model = F.coalesce(F.nullif(d["model"], F.lit("")), F.lit("-"))

    def why(field: str) -> Column:
        return fill(L.EXPLAIN_WHY, value=x[field])

    lines = [
        fill(L.EXPLAIN_HEAD, id=d["id"], at=utc_iso_millis(d["created_at"]), mode=d["mode"], model=model),
        F.lit(""),
        fill(L.EXPLAIN_CUSTOMER, value=sender),
        F.concat(fill(L.EXPLAIN_IDS, value=_list_or_dash(who["identifiers"])), basis),
        why("customer_reason"),
        fill(L.EXPLAIN_CATEGORY, category=F.replace(x["category"], F.lit("_"), F.lit(" ")), confidence=two_places(x["category_confidence"])),
        why("category_reason"),
        fill(L.EXPLAIN_URGENCY, urgency=x["urgency"], signals=_list_or_dash(x["urgency_signals"])),
        why("urgency_reason"),
        fill(
            L.EXPLAIN_ESCALATE, escalate=F.when(x["escalate"], F.lit("True")).otherwise(F.lit("False")), reasons=_list_or_dash(x["escalation_reasons"])
        ),
        why("escalation_reason_text"),
        F.concat(fill(L.EXPLAIN_ROUTE, value=d["queue"]), second),
        F.lit(""),
        F.lit(L.EXPLAIN_RATIONALE),
        F.concat(F.lit("  "), x["rationale"]),
        F.lit(""),
        F.lit(L.EXPLAIN_RULES),
        F.when(F.size(fired) > 0, F.array_join(fired, "\n")).otherwise(F.lit(L.EXPLAIN_NO_RULE)),
        F.when(F.size(said) > 0, F.concat(F.lit(L.EXPLAIN_OVERRIDES), F.array_join(said, "\n"))),
        F.when(d["error"] != "", fill(L.EXPLAIN_ERROR, value=d["error"])),
    ]
    return F.concat_ws("\n", *lines)


def discard_json(discarded_id: Column, kept_id: Column, source: Column, external_id: Column) -> Column:
    """The one-line event of a submission whose key already had a decision."""
    event = F.struct(
        F.lit("routing_decision_deduplicated").alias("event"),
        discarded_id.alias("discarded_id"),
        kept_id.alias("kept_id"),
        source.alias("source"),
        external_id.alias("external_id"),
    )
    return F.to_json(event, {"ignoreNullFields": "false"})


def event_json(d: Column) -> Column:
    """The one-line routing event of a decision."""
    x = d["extraction"]
    return F.to_json(
        F.struct(
            F.lit("routing_decision").alias("event"),
            d["id"].alias("id"),
            d["mode"].alias("mode"),
            x["category"].alias("category"),
            x["urgency"].alias("urgency"),
            x["escalate"].alias("escalate"),
            x["escalation_reasons"].alias("reasons"),
            d["queue"].alias("queue"),
            d["escalation_queue"].alias("escalation_queue"),
            d["rule_hits"]["rule"].alias("rule_hits"),
            d["overrides"].alias("overrides"),
            d["latency_ms"].alias("latency_ms"),
            d["usage"].alias("usage"),
        ),
        {"ignoreNullFields": "false"},
    )
