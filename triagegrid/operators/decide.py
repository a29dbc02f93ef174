"""Tickets in, decisions out.

One lazy plan: read (keywords, or a model answer where a usable one exists), guardrails on the raw
text, routing.  Nothing here shuffles except the join with an answers table.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions import keywords as K
from triagegrid.functions.guardrails import ACTIVE, MATCHES, SETTLED, add_guardrail_matches, add_guardrails, rule_fired
from triagegrid.functions.labels import decision_id
from triagegrid.functions.pricing import Card, cost_usd, usd6
from triagegrid.functions.text import add_folded, count_matches, empty_strings
from triagegrid.operators.routing import STANDARD, RoutingTable, escalation_queue_for, queue_for
from triagegrid.schema import EXTRACTION, USAGE


def hold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Compute ``columns`` here and nowhere above.

    A filter placed above a projection is pushed below it with the column's definition copied in, and
    through several projections the copies multiply: filtering decisions by queue would run every
    pattern again, many times per row.  A filter on a generated column is not pushed, while filters
    on the ticket's own columns still pass through to the scan.
    """
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


CORE = ["category", "category_confidence", "urgency", "urgency_signals"]


def add_keyword_core(df: DataFrame, text: str = "text", prefix: str = "_k_", low: str | None = None) -> DataFrame:
    """Add the keyword category and urgency, with the guardrail matches they rest on, held.

    Rows whose ``text`` is null get their guardrail matches only.
    """
    t = F.col(text)
    keep = df.columns
    security, legal = rule_fired(L.INCIDENT_REASONS), rule_fired(L.LEGAL_REASONS)
    # Counts are taken only where the earlier, cheaper answers leave the category open.
    df = df.select(*keep, F.when(~security, count_matches(t, L.SPAM, low=low)).alias("_n_spam"))
    undecided = ~security & ~legal & (F.col("_n_spam") < 2)
    df = df.select(
        *keep,
        "_n_spam",
        F.when(undecided, count_matches(t, L.BUG, low=low)).alias("_n_bug"),
        F.when(undecided, count_matches(t, L.BILLING, low=low)).alias("_n_billing"),
    )
    found = K.category_of(security, legal, F.col("_n_spam"), F.col("_n_bug"), F.col("_n_billing"), t, low)
    df = df.select(*keep, found.alias("_cat"))
    df = df.select(*keep, "_cat", K.keyword_urgency(t, F.col("_cat")["category"], low).alias("_urg"))
    core = ["_cat.category", "_cat.confidence", "_urg.urgency", "_urg.signals"]
    df = df.select(*keep, *[F.col(path).alias(prefix + name) for path, name in zip(core, CORE)])
    return hold(df, [*MATCHES, ACTIVE, *[prefix + name for name in CORE]])


def add_keyword_reading(
    df: DataFrame, text: str = "text", prefix: str = "base_", own_names: Sequence[str] = (), low: str | None = None
) -> DataFrame:
    """Add the keyword reading, one ``prefix``-ed column per EXTRACTION field.

    ``df`` holds the columns of ``add_guardrail_matches``.  Rows whose text is null are skipped.
    """
    keep = [F.col(c) for c in df.columns]
    df = K.add_sender(add_keyword_core(df, text, "_k_", low), text, "_k_", own_names, low)
    category, urgency, signals = F.col("_k_category"), F.col("_k_urgency"), F.col("_k_urgency_signals")
    reading = {
        "customer": F.struct(*[F.col("_k_" + name).alias(name) for name in K.CUSTOMER_FIELDS]),
        "customer_reason": K.customer_reason("_k_"),
        "category": category,
        "category_confidence": F.col("_k_category_confidence"),
        "category_reason": K.category_reason(category),
        "category_alternatives": _no_alternatives(),
        "urgency": urgency,
        "urgency_signals": signals,
        "urgency_reason": K.urgency_reason(urgency, signals),
        "escalate": F.lit(False),
        "escalation_reasons": empty_strings(),
        "escalation_reason_text": F.lit(L.ESCALATION_REASON_TEXT),
        "summary": K.summary_line(F.col(text)),
        "rationale": K.rationale(category, urgency),
    }
    return df.select(*keep, *[reading[f.name].alias(prefix + f.name) for f in EXTRACTION])


def _no_alternatives() -> Column:
    return F.array().cast(EXTRACTION["category_alternatives"].dataType)


REQUIRED = [
    "customer", "customer_reason", "category", "category_confidence", "category_reason", "urgency", "urgency_signals",
    "urgency_reason", "escalate", "escalation_reasons", "escalation_reason_text", "summary", "rationale",
]


def answer_problem(x: Column) -> Column:
    """Why a model answer does not fit the schema, or null when it does.

    Reading JSON into a struct checks types only, so listed values are checked here.
    """
    problem = F.when(x.isNull(), F.lit("no parsed output"))
    for name in REQUIRED:
        problem = problem.when(x[name].isNull(), F.lit(f"{name}: field required"))
    return (
        problem.when(~x["category"].isin(L.CATEGORIES), F.lit("category: not a listed value"))
        .when(~x["urgency"].isin(L.URGENCIES), F.lit("urgency: not a listed value"))
        .when(_unlisted(x["escalation_reasons"], L.REASONS), F.lit("escalation_reasons: not a listed value"))
        .when(_unlisted(x["category_alternatives"]["category"], L.CATEGORIES), F.lit("category_alternatives: not a listed value"))
    )


def _unlisted(values: Column, listed: Sequence[str]) -> Column:
    return F.coalesce(F.size(F.array_except(values, F.array(*[F.lit(v) for v in listed]))) > 0, F.lit(False))


def validate_answers(answers: DataFrame) -> DataFrame:
    """Add ``problem`` (null when usable) to rows with an ``extraction`` and an ``error`` column."""
    return answers.select(
        "*",
        F.coalesce(
            F.nullif(F.col("error"), F.lit("")),
            F.concat(F.lit("ValidationError: "), answer_problem(F.col("extraction"))),
        ).alias("problem"),
    )


def resolve_answers(tickets: DataFrame, answers: DataFrame, on: str = "ticket_key") -> DataFrame:
    """Pair each ticket with its model answer.

    Adds ``mode``, ``error`` and ``answer``; the answer is null where it is missing, failed or
    invalid, and the ticket then falls back to keywords.  The key is unique on both sides.
    """
    checked = validate_answers(answers)
    usable = F.col("_a.problem").isNull() & F.col(f"_a.{on}").isNotNull()
    joined = tickets.alias("_t").join(checked.alias("_a"), F.col(f"_t.{on}") == F.col(f"_a.{on}"), "left")
    return joined.select(
        "_t.*",
        F.when(usable, F.lit(L.MODE_MODEL)).otherwise(F.lit(L.MODE_FALLBACK)).alias("mode"),
        F.when(~usable, F.coalesce("_a.problem", F.lit("ValueError: no answer for this ticket"))).alias("error"),
        F.when(usable, F.col("_a.model")).alias("model"),
        F.when(usable, F.col("_a.extraction")).alias("answer"),
        # A failed read may still have been paid for, so its token counts are kept.
        F.col("_a.usage").alias("usage"),
        F.col("_a.latency_ms").alias("latency_ms"),
    )


def ticket_id(columns: Sequence[str], given: str | None = None) -> Column:
    """The id of a ticket's decision: the one it has, or one of the ticket's ``columns`` alone, never of the clock."""
    more = [F.col(c) for c in ("ordinal", "ticket_key", "received_at") if c in columns]
    derived = decision_id(F.col("source"), F.col("external_id"), F.col("text"), *more)
    return F.coalesce(F.col(given).cast("string"), derived) if given else derived


def decide(
    tickets: DataFrame,
    answers: DataFrame | None = None,
    *,
    now: Column | None = None,
    own_names: Sequence[str] = (),
    table: RoutingTable = STANDARD,
    card: Card | None = None,
) -> DataFrame:
    """Decide every ticket.  Returns rows of the DECISION schema.

    ``tickets`` has text, source and external_id, and may have: ``decision_id`` or ``id`` (else derived from the ticket
    alone, never from the clock), ``received_at`` (else ``now``), ``ordinal`` (tells apart equal tickets without external_id) and
    ``ticket_key`` (joins ``answers``).  Without answers every ticket is read by keywords.
    """
    df = tickets
    has = set(df.columns)
    # Cast, because a bare null or current_timestamp() would not survive a written table alike.
    moment = (now if now is not None else F.current_timestamp()).cast("timestamp")
    if answers is None:
        df = df.drop("mode", "error", "model", "usage", "latency_ms").select(
            "*",
            F.lit(L.MODE_KEYWORDS).alias("mode"),
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("string").alias("model"),
            F.lit(None).cast(EXTRACTION).alias("answer"),
            F.lit(None).cast(USAGE).alias("usage"),
            F.lit(0).cast("bigint").alias("latency_ms"),
        )
        unread = F.col("text")
    else:
        df = resolve_answers(df, answers)
        unread = F.when(F.col("mode") != L.MODE_MODEL, F.col("text"))
    df = add_guardrail_matches(add_folded(df.withColumn("_unread", unread)), low="_low")
    if answers is None:
        df = add_keyword_reading(df, "_unread", "_b_", own_names, "_low")
    else:
        plain = df.columns
        df = _chosen(add_keyword_reading(df, "_unread", "_q_", own_names, "_low"), plain)
    return _decided(df, tickets.columns, moment, table, card, answers is not None)


#: What a run has to say about a ticket, see ``resolve_answers``.
SAID = ["mode", "error", "model", "answer", "usage", "latency_ms"]


def decide_runs(
    tickets: DataFrame,
    runs: Mapping[str, DataFrame | None],
    *,
    now: Column | None = None,
    own_names: Sequence[str] = (),
    table: RoutingTable = STANDARD,
    card: Card | None = None,
) -> DataFrame:
    """Decide every ticket once for each of several runs, from one reading of the tickets.

    ``runs`` names tables of answers; None stands for keywords alone.  Returns the rows that ``decide`` gives for each, with the run's name in
    ``run``.  Patterns run once per ticket: matches and the keyword reading are made before a ticket is unfolded into its runs.
    """
    moment = (now if now is not None else F.current_timestamp()).cast("timestamp")
    df = tickets.drop(*SAID)
    kinds = {"answer": EXTRACTION, "usage": USAGE}
    for i, (name, answers) in enumerate(runs.items()):
        if answers is None:
            said = {"mode": F.lit(L.MODE_KEYWORDS), "answer": F.lit(None), "usage": F.lit(None), "latency_ms": F.lit(0)}
            seen, rest = df, df.columns
        else:
            seen, rest = resolve_answers(df, answers), df.columns
            said = {c: F.col(c) for c in SAID}
        fields = [said.get(c, F.lit(None)).cast(kinds.get(c, "bigint" if c == "latency_ms" else "string")).alias(c) for c in SAID]
        df = seen.select(*rest, F.struct(F.lit(name).alias("run"), *fields).alias(f"_run_{i}"))
    names = [f"_run_{i}" for i in range(len(runs))]
    unread = F.lit(False)
    for run in names:
        unread = unread | (F.col(run)["mode"] != L.MODE_MODEL)
    df = add_guardrail_matches(add_folded(df.withColumn("_unread", F.when(unread, F.col("text")))), low="_low")
    plain = [c for c in df.columns if c not in names]
    df = add_keyword_reading(df, "_unread", "_q_", own_names, "_low")
    df = df.select(*[c for c in df.columns if c not in names], F.inline(F.array(*names)))
    return _decided(_chosen(df, [*plain, "run", *SAID]), tickets.columns, moment, table, card, True, "run")


def _chosen(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The answer where the run has one, else the keyword reading in ``_q_`` columns; both become ``_b_`` columns."""
    chosen = F.col("mode") == L.MODE_MODEL

    def said(name: str) -> Column:
        return F.coalesce(F.col("answer")[name], _no_alternatives()) if name == "category_alternatives" else F.col("answer")[name]

    return df.select(*keep, *[F.when(chosen, said(f.name)).otherwise(F.col("_q_" + f.name)).alias("_b_" + f.name) for f in EXTRACTION])


def _decided(df: DataFrame, given_columns: Sequence[str], moment: Column, table: RoutingTable, card: Card | None, answered: bool, *more: str) -> DataFrame:
    """Guardrails, routing and price over a base reading in ``_b_`` columns: rows of the DECISION schema."""
    has, chosen = set(given_columns), F.col("mode") == L.MODE_MODEL
    df = add_guardrails(df, "_b_", "_f_")
    base = {f.name: F.col("_b_" + f.name) for f in EXTRACTION}
    final = {name: F.col("_f_" + name) for name in SETTLED}
    usage = F.col("usage")
    if answered:
        priced = usd6(cost_usd(usage, F.col("model"), *([card] if card else [])))
        usage = F.when(usage.isNotNull(), usage.withField("cost_usd", F.when(chosen, priced)))
    created = F.coalesce(F.col("received_at"), moment) if "received_at" in has else moment
    given = next((c for c in ("decision_id", "id") if c in has), None)
    return df.select(
        ticket_id(given_columns, given).alias("id"),
        created.alias("created_at"),
        F.struct("text", "source", "external_id").alias("ticket"),
        "mode",
        "model",
        F.struct(*[final.get(f.name, base[f.name]).alias(f.name) for f in EXTRACTION]).alias("extraction"),
        F.col("answer").alias("llm_extraction"),
        final["rule_hits"].alias("rule_hits"),
        final["overrides"].alias("overrides"),
        queue_for(base["category"], final["urgency"], final["escalate"], base["category_confidence"], table).alias("queue"),
        escalation_queue_for(final["escalate"], table).alias("escalation_queue"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).cast("bigint").alias("latency_ms"),
        usage.alias("usage"),
        "error",
        *more,
    )
