"""Guardrails: rules on the raw text that may raise escalation and urgency, then spam suppression.

The rules read as a fold in firing order, carrying escalation, reasons and urgency.  Because every
step only raises, the state before rule *i* is a maximum over the rules before it, so the whole fold
is written as plain expressions of the six matches (no row loop, no lambda).

One exception to "only raises": a confident spam reading clears escalation and reasons and sets
urgency low.  ``urgency_reason`` and ``urgency_signals`` keep describing the lift that was undone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.ordinal import RANK
from triagegrid.functions.text import RIGHT_STRIP, empty_strings, first_match, sql_fill, sql_list, sql_listed, sql_text

MATCHES = [f"_g_{i}" for i in range(len(L.GUARDRAILS))]
ACTIVE = "_g_active"


def add_guardrail_matches(df: DataFrame, text: str = "text", low: str | None = None) -> DataFrame:
    """First match of each rule (``''`` for none), and the active-incident cue where it can matter.

    ``low`` names the folded text when the frame has it.
    """
    t = F.col(text)
    df = df.select("*", *[first_match(t, regex, low=low).alias(m) for m, (_, _, _, regex) in zip(MATCHES, L.GUARDRAILS)])
    active = first_match(t, L.ACTIVE_INCIDENT, low=low)
    return df.select("*", F.when(rule_fired(L.INCIDENT_REASONS), active).otherwise(F.lit("")).alias(ACTIVE))


def rule_fired(reasons: list[str]) -> Column:
    hit = F.lit(False)
    for m, (_, reason, _, _) in zip(MATCHES, L.GUARDRAILS):
        if reason in reasons:
            hit = hit | (F.col(m) != "")
    return hit


def suppressed(category: Column, confidence: Column) -> Column:
    return (category == "spam") & (confidence >= L.SPAM_SUPPRESS_CONFIDENCE)


def suppress_spam(category: Column, confidence: Column, escalate: Column, reasons: Column, urgency: Column) -> Column:
    """struct<escalate, reasons, urgency> after the spam exception."""
    off = suppressed(category, confidence)
    return F.struct(
        (escalate & ~off).alias("escalate"),
        F.when(off, empty_strings()).otherwise(reasons).alias("reasons"),
        F.when(off, F.lit("low")).otherwise(urgency).alias("urgency"),
    )


SETTLED = ["escalate", "escalation_reasons", "urgency", "urgency_reason", "urgency_signals", "rule_hits", "overrides"]
_HIT = "struct<rule:string,reason:string,matched:string,effect:string>"


def add_guardrails(df: DataFrame, base: str = "base_", prefix: str = "final_") -> DataFrame:
    """Apply the rules to a reading held in ``base``-prefixed columns named like EXTRACTION fields.

    ``df`` holds the columns of ``add_guardrail_matches``.  Adds one ``prefix``-ed column per name in
    ``SETTLED``; flat, so that those nobody reads are pruned.
    """
    keep = df.columns
    last = len(L.GUARDRAILS)

    # What each rule sees before it runs: two small columns per rule, read by every string below.
    levels = " ".join(f"WHEN {base}urgency = '{name}' THEN {rank}" for name, rank in RANK.items())
    any_fired = " OR ".join(f"{m} != ''" for m in MATCHES)
    state = [f"({any_fired}) AS _fired", f"{base}escalate AS _e_0", f"CASE {levels} END AS _u_0"]
    esc, rank = f"{base}escalate", f"CASE {levels} END"
    floors = []
    for m, (_, reason, floor, _) in zip(MATCHES, L.GUARDRAILS):
        level = str(RANK[floor])
        if reason in L.INCIDENT_REASONS:
            level = f"IF({ACTIVE} != '', {RANK['critical']}, {level})"
        floors.append(f"IF({m} != '', {level}, 0)")
    for i in range(1, last + 1):
        fired = " OR ".join(f"{m} != ''" for m in MATCHES[:i])
        state += [f"({esc} OR {fired}) AS _e_{i}", f"greatest({rank}, {', '.join(floors[:i])}) AS _u_{i}"]
    df = df.selectExpr(*keep, *state)

    names = sql_list(list(RANK))
    hits, overrides, cues, lifts, reasons_new = [], [], [], [], []
    for i, (m, (rule, reason, _, _)) in enumerate(zip(MATCHES, L.GUARDRAILS)):
        fired = f"{m} != ''"
        before, after = f"{names}[_u_{i}]", f"{names}[_u_{i + 1}]"
        forced = f"{fired} AND NOT _e_{i}"
        lifted = f"_u_{i + 1} > _u_{i}"
        earlier = [f"{m2} = ''" for m2, (_, r2, _, _) in list(zip(MATCHES, L.GUARDRAILS))[:i] if r2 == reason]
        new_reason = " AND ".join([fired, *earlier, f"NOT array_contains({base}escalation_reasons, '{reason}')"])
        parts = (
            f"concat_ws('; ', IF({forced}, {sql_text(L.EFFECT_ESCALATE)}, NULL), "
            f"IF({new_reason}, {sql_text(L.EFFECT_REASON.format(reason))}, NULL), "
            f"IF({lifted}, {sql_fill(L.EFFECT_URGENCY, before=before, after=after)}, NULL))"
        )
        effect = f"coalesce(nullif({parts}, ''), {sql_text(L.EFFECT_CONFIRMED)})"
        hits.append((fired, _hit(sql_text(rule), sql_text(reason), m, effect)))
        overrides += [
            (forced, sql_fill(L.OVERRIDE_ESCALATE, rule=sql_text(rule), matched=m)),
            (lifted, sql_fill(L.OVERRIDE_URGENCY, rule=sql_text(rule), before=before, after=after)),
        ]
        topic = sql_text(reason.replace("_", " "))
        tail = sql_fill(L.LIFT_FLOOR, topic=topic, after=after)
        cues.append((lifted, m))
        if reason in L.INCIDENT_REASONS:
            cues.append((f"{lifted} AND {ACTIVE} != ''", ACTIVE))
            tail = f"IF({ACTIVE} != '', {sql_fill(L.LIFT_ACTIVE, active=ACTIVE, after=after)}, {tail})"
        lifts.append(f"IF({lifted}, concat({sql_fill(L.LIFT_FIRED, topic=topic, matched=m)}, {tail}), NULL)")
        reasons_new.append((fired, sql_text(reason)))

    off = f"({base}category = 'spam' AND {base}category_confidence >= {L.SPAM_SUPPRESS_CONFIDENCE}D)"
    undo = f"{off} AND _e_{last}"
    hits.append((undo, _hit(sql_text(L.SUPPRESS_RULE), sql_text(None), sql_text(L.SUPPRESS_MATCHED), sql_text(L.SUPPRESS_EFFECT))))
    overrides.append((undo, sql_text(L.SUPPRESS_OVERRIDE)))
    reasons, signals = f"{base}escalation_reasons", f"{base}urgency_signals"
    told = f"IF({base}urgency_reason != '', regexp_extract({base}urgency_reason, {sql_text(RIGHT_STRIP)}, 1), NULL)"
    # Most tickets fire no rule and lift nothing: they skip the lists.  The lambdas say "or": they keep the lists out of whole-stage code, where all
    # of them would be one method of some 19 KB, and the JVM runs methods over 8 KB uncompiled, for every ticket.
    lifted_any, touched = f"exists(array(_u_{last} > _u_0), yes -> yes)", f"exists(array(_fired, {undo}), yes -> yes)"
    settled = [
        f"_e_{last} AND NOT {off}",
        f"CASE WHEN {off} THEN CAST(array() AS array<string>) WHEN _fired THEN "
        f"concat({reasons}, array_except({sql_listed(reasons_new)}, {reasons})) ELSE {reasons} END",
        f"IF({off}, 'low', {names}[_u_{last}])",
        f"IF({lifted_any}, concat_ws(' ', {told}, {', '.join(lifts)}), {base}urgency_reason)",
        f"IF({lifted_any}, concat({signals}, array_except({sql_listed(cues)}, {signals})), {signals})",
        f"IF({touched}, {sql_listed(hits, _HIT)}, CAST(array() AS array<{_HIT}>))",
        f"IF({touched}, {sql_listed(overrides)}, CAST(array() AS array<string>))",
    ]
    return df.selectExpr(*keep, *[f"{value} AS {prefix}{name}" for name, value in zip(SETTLED, settled)])


def _hit(rule: str, reason: str, matched: str, effect: str) -> str:
    return f"named_struct('rule', {rule}, 'reason', {reason}, 'matched', {matched}, 'effect', {effect})"
