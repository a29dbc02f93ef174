"""The keyword reading of a ticket, as column expressions.

Matches are added in a few stacked projections of flat columns.  A projection that is read more than
once is kept apart by the optimizer, so each pattern runs at most once per ticket, and columns nobody
asks for are pruned together with their patterns.  A null text costs nothing, which is how tickets
that already hold a model answer skip this work.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.text import (
    all_matches,
    count_matches,
    empty_strings,
    fill,
    first_match,
    has_match,
    sql_fill,
    sql_listed,
    sql_text,
    strip_ws,
)


def any_rule(text: Column, reasons: Sequence[str], low: str | None = None) -> Column:
    """Does a guardrail rule with one of these reasons match?"""
    hit = F.lit(False)
    for _, reason, _, regex in L.GUARDRAILS:
        if reason in reasons:
            hit = hit | has_match(text, regex, low=low)
    return hit


def category_of(
    security: Column, legal: Column, spam_n: Column, bug_n: Column, billing_n: Column, text: Column, low: str | None = None
) -> Column:
    """Category and confidence from match counts; the first line that holds wins."""

    def said(category: str, confidence: Column | float) -> Column:
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(category).alias("category"), conf.alias("confidence"))

    clear = F.when(F.abs(bug_n - billing_n) > 1, F.lit(L.CONF_CLEAR_COUNT)).otherwise(F.lit(L.CONF_CLOSE_COUNT))
    return (
        F.when((spam_n >= 2) & ~security, said("spam", L.CONF_SPAM))
        .when(security, said("security", L.CONF_SECURITY))
        .when(legal, said("legal_contract", L.CONF_LEGAL))
        .when(billing_n > bug_n, said("billing", clear))
        .when(bug_n > 0, said("bug", clear))
        .when(has_match(text, L.ONBOARDING, low=low), said("onboarding", L.CONF_ONBOARDING))
        .when(has_match(text, L.FEATURE, low=low), said("feature_request", L.CONF_FEATURE))
        .otherwise(said("other", L.CONF_OTHER))
    )


def keyword_category(text: Column, low: str | None = None) -> Column:
    """struct<category, confidence>, in one expression."""
    return category_of(
        any_rule(text, L.INCIDENT_REASONS, low),
        any_rule(text, L.LEGAL_REASONS, low),
        count_matches(text, L.SPAM, low=low),
        count_matches(text, L.BUG, low=low),
        count_matches(text, L.BILLING, low=low),
        text,
        low,
    )


def keyword_urgency(text: Column, category: Column, low: str | None = None) -> Column:
    """struct<urgency, signals>; the first line that holds wins."""

    def said(urgency: str, signals: Column) -> Column:
        return F.struct(F.lit(urgency).alias("urgency"), signals.alias("signals"))

    def cue(regex: str) -> Column:
        return F.array(first_match(text, regex))

    return (
        F.when(category == "spam", said("low", empty_strings()))
        .when(has_match(text, L.WIDESPREAD_MONEY, low=low), said("critical", F.array(F.lit(L.SIGNAL_WIDESPREAD))))
        .when((category == "bug") & has_match(text, L.OUTAGE, low=low), said("critical", cue(L.OUTAGE)))
        .when(has_match(text, L.LOW_PRIORITY, low=low), said("low", cue(L.LOW_PRIORITY)))
        .when(has_match(text, L.DEADLINE, low=low), said("high", cue(L.DEADLINE)))
        .when(has_match(text, L.MONEY, low=low), said("medium", cue(L.MONEY)))
        .otherwise(said("medium", empty_strings()))
    )


def identifiers(text: Column, low: str | None = None) -> Column:
    """Invoice and account numbers, ticket references, addresses and handles, in order of appearance."""
    return all_matches(text, L.IDENTIFIER, low=low)


def email_domain(text: Column, low: str | None = None) -> Column:
    """Domain of the first address as written, or ``''``."""
    return first_match(text, L.EMAIL_DOMAIN, group=1, low=low)


def is_free_mail(domain: Column) -> Column:
    return F.lower(domain).isin(L.FREE_MAIL)


def summary_line(text: Column) -> Column:
    """First line of the stripped text, cut to the summary length (in code points)."""
    return F.substring(F.substring_index(strip_ws(text), "\n", 1), 1, L.SUMMARY_CHARS)


def _not_listed(name: Column, own_names: Sequence[str]) -> Column:
    first_word = F.regexp_extract(name, r"(?U)^\s*(\S+)", 1)
    return (name != "") & ~first_word.isin([*L.NOT_A_COMPANY, *own_names])


CUSTOMER_FIELDS = ["name", "contact_name", "identifiers", "best_guess", "confidence", "basis"]


def add_sender(
    df: DataFrame, text: str = "text", prefix: str = "sender_", own_names: Sequence[str] = (), low: str | None = None
) -> DataFrame:
    """Add one column per CUSTOMER field: what the text states, else a scored guess with its basis.

    Only the first company mention counts; a listed non-company there is not followed by a second
    try, but a sign-off line still is.
    """
    t = F.col(text)
    keep = [F.col(c) for c in df.columns]

    def c(name: str) -> Column:
        return F.col(f"_w_{name}")

    df = df.select(*keep, first_match(t, L.COMPANY, any_case=False, group=1).alias("_w_company"))
    df = df.select(*keep, F.when(_not_listed(c("company"), own_names), c("company")).alias("_w_stated"), identifiers(t, low).alias("_w_ids"))
    # The sign-off line is looked for only when no company is stated, the weaker cues only when
    # neither was found.
    dashed = F.expr(f"contains({text}, ',') AND (contains({text}, '-') OR contains({text}, '—') OR contains({text}, '–'))")
    sign = F.when(c("stated").isNull() & dashed, first_match(strip_ws(t), L.SIGNATURE, any_case=False))
    df = df.select(*keep, c("stated"), c("ids"), F.coalesce(sign, F.lit("")).alias("_w_sign"))
    df = df.select(
        *keep,
        c("stated"),
        c("ids"),
        c("sign"),
        F.when(c("sign") != "", first_match(c("sign"), L.SIGNATURE, any_case=False, group=2)).alias("_w_signed"),
    )
    signed = _not_listed(c("signed"), own_names)
    df = df.select(
        *keep,
        F.coalesce(c("stated"), F.when(signed, c("signed"))).alias("_w_name"),
        F.when(signed, first_match(c("sign"), L.SIGNATURE, any_case=False, group=1)).alias("_w_contact"),
        c("ids"),
    )
    unnamed = F.when(c("name").isNull(), t)
    df = df.select(
        *keep,
        c("name"),
        c("contact"),
        c("ids"),
        F.coalesce(email_domain(unnamed, low), F.lit("")).alias("_w_domain"),
        F.coalesce(first_match(unnamed, L.ENTERPRISE, low=low), F.lit("")).alias("_w_enterprise"),
        F.coalesce(first_match(unnamed, L.SCALE, low=low), F.lit("")).alias("_w_scale"),
        F.coalesce(first_match(unnamed, L.PLAN, low=low), F.lit("")).alias("_w_plan"),
    )

    named = "_w_name IS NOT NULL"
    is_free = f"lower(_w_domain) IN ({', '.join(sql_text(d) for d in L.FREE_MAIL)})"
    free, work = f"_w_domain != '' AND {is_free}", f"_w_domain != '' AND NOT {is_free}"
    enterprise, scale, plan = "_w_enterprise != ''", "_w_scale != ''", "_w_plan != ''"
    by_id = "_w_domain = '' AND _w_enterprise = '' AND _w_scale = '' AND _w_plan = '' AND size(_w_ids) > 0"
    guess = f"""CASE WHEN {named} THEN _w_name
        WHEN {work} THEN {sql_fill(L.GUESS_WORK_MAIL, value='_w_domain')}
        WHEN {free} THEN {sql_text(L.GUESS_FREE_MAIL)}
        WHEN {enterprise} THEN {sql_text(L.GUESS_ENTERPRISE)}
        WHEN {scale} THEN {sql_text(L.GUESS_SCALE)}
        WHEN {plan} THEN {sql_fill(L.GUESS_PLAN, value='_w_plan')}
        WHEN {by_id} THEN {sql_text(L.GUESS_IDENTIFIER)} END"""
    confidence = f"""CASE WHEN {named} THEN {L.WHO_STATED}D WHEN {work} THEN {L.WHO_WORK_MAIL}D WHEN {scale} THEN {L.WHO_SCALE}D
        WHEN {enterprise} OR {plan} THEN {L.WHO_CUE}D WHEN {free} OR {by_id} THEN {L.WHO_WEAK}D ELSE 0.0D END"""
    cues = sql_listed(
        [
            (work, sql_fill(L.BASIS_WORK_MAIL, value="_w_domain")),
            (free, sql_text(L.BASIS_FREE_MAIL)),
            (enterprise, sql_fill(L.BASIS_ENTERPRISE, value="_w_enterprise")),
            (scale, sql_fill(L.BASIS_SCALE, value="_w_scale")),
            (plan, sql_fill(L.BASIS_PLAN, value="_w_plan")),
            (by_id, sql_fill(L.BASIS_IDENTIFIER, value="_w_ids[0]")),
        ]
    )
    stated = f"array(IF(_w_contact IS NOT NULL, {sql_text(L.BASIS_SIGNED)}, {sql_text(L.BASIS_NAMED)}))"
    fields = ["_w_name", "_w_contact", "_w_ids", guess, confidence, f"IF({named}, {stated}, {cues})"]
    return df.select(*keep, *[F.expr(value).alias(prefix + name) for name, value in zip(CUSTOMER_FIELDS, fields)])


def customer_reason(who: str) -> Column:
    """Why this sender, from the ``who``-prefixed columns of ``add_sender``."""
    found = sql_fill(
        L.WHO_REASON_FOUND, basis=f"array_join({who}basis, '; ')", guess=f"{who}best_guess", confidence=f"CAST({who}confidence AS STRING)"
    )
    return F.expr(
        f"""CASE WHEN {who}name IS NOT NULL THEN {sql_fill(L.WHO_REASON_STATED, value=who + 'name')}
        WHEN size({who}basis) > 0 THEN concat({sql_text(L.WHO_REASON_CHECKED)}, {found})
        ELSE {sql_text(L.WHO_REASON_CHECKED + L.WHO_REASON_NOTHING)} END"""
    )


def category_reason(category: Column) -> Column:
    return fill(L.CATEGORY_REASON, value=category)


def urgency_reason(urgency: Column, signals: Column) -> Column:
    return F.when(
        F.size(signals) > 0, fill(L.URGENCY_REASON_CUES, urgency=urgency, signals=F.array_join(signals, ", "))
    ).otherwise(fill(L.URGENCY_REASON_NONE, urgency=urgency))


def rationale(category: Column, urgency: Column) -> Column:
    return fill(L.RATIONALE, category=category, urgency=urgency)
