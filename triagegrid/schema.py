"""Explicit schemas.  Every reader uses one; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _l, _b = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TICKET = _struct(text=_s, source=_s, external_id=_s)

CUSTOMER = _struct(
    name=_s, contact_name=_s, identifiers=T.ArrayType(_s), best_guess=_s, confidence=_d, basis=T.ArrayType(_s)
)
ALTERNATIVE = _struct(category=_s, confidence=_d, why_not=_s)
EXTRACTION = _struct(
    customer=CUSTOMER,
    customer_reason=_s,
    category=_s,
    category_confidence=_d,
    category_reason=_s,
    category_alternatives=T.ArrayType(ALTERNATIVE),
    urgency=_s,
    urgency_signals=T.ArrayType(_s),
    urgency_reason=_s,
    escalate=_b,
    escalation_reasons=T.ArrayType(_s),
    escalation_reason_text=_s,
    summary=_s,
    rationale=_s,
)
RULE_HIT = _struct(rule=_s, reason=_s, matched=_s, effect=_s)

SHORT_ANSWER = _struct(category=_s, urgency=_s, escalate=_b)
CASCADE_NOTE = _struct(
    triage=_s,
    expensive=_b,
    why=_s,
    reader=_s,
    draft_model=_s,
    reread=_b,
    draft_cost_usd=_d,
    draft_said=SHORT_ANSWER,
    changed=_b,
)
USAGE = _struct(
    input_tokens=_l,
    output_tokens=_l,
    cache_read_input_tokens=_l,
    stop_reason=_s,
    llm_ms=_l,
    cost_usd=_d,
    cost_usd_by_reader=_d,
    cascade=CASCADE_NOTE,
)
DECISION = _struct(
    id=_s,
    created_at=T.TimestampType(),
    ticket=TICKET,
    mode=_s,
    model=_s,
    extraction=EXTRACTION,
    llm_extraction=EXTRACTION,
    rule_hits=T.ArrayType(RULE_HIT),
    overrides=T.ArrayType(_s),
    queue=_s,
    escalation_queue=_s,
    latency_ms=_l,
    usage=USAGE,
    error=_s,
)
# One model answer per ticket; ``extraction`` is null when the call failed.
ANSWER = _struct(ticket_key=_s, model=_s, extraction=EXTRACTION, usage=USAGE, latency_ms=_l, error=_s)

EXPECTED = _struct(
    category=_s,
    urgency=_s,
    escalate=_b,
    customer_name=_s,
    reasons=T.ArrayType(_s),
    identifier_contains=_s,
    customer_confidence=T.ArrayType(_d),
)
LABELLED = _struct(
    id=_s, group=_s, text=_s, note=_s, attack=_s, tests=_s, expected=EXPECTED, ambiguous=T.ArrayType(_s)
)
PROBE = _struct(id=_s, expect_escalate=_b, reason=_s, why=_s, text=_s)

RUN_SUMMARY = _struct(
    n=_l,
    escalation_recall=_d,
    missed_escalations=T.ArrayType(_s),
    false_escalations=T.ArrayType(_s),
    reasons_accuracy=_d,
    category_accuracy=_d,
    category_strict=_d,
    urgency_exact=_d,
    urgency_accuracy=_d,
    customer_accuracy=_d,
    identifier_accuracy=_d,
    overconfidence=T.ArrayType(_s),
    confidence_calibration=_d,
    confidence_misses=T.ArrayType(_s),
    basis_always_given=_b,
    urgency_under=T.ArrayType(_s),
    urgency_over=T.ArrayType(_s),
    urgency_under_rate=_d,
    urgency_over_rate=_d,
    urgency_hard_under=T.ArrayType(_s),
    urgency_never_under_critical=_b,
)
RUN_RESULT = _struct(
    model=_s,
    effort=_s,
    summary=RUN_SUMMARY,
    fails=_l,
    must_n=_l,
    p50=_l,
    p95=_l,
    wall=_d,
    tin=_d,
    tcached=_d,
    tout=_d,
    cost_per_ticket=_d,
    n=_l,
)

# The flat audit columns, in order, followed by the whole record as JSON text.
AUDIT_COLUMNS = [
    "id",
    "created_at",
    "source",
    "external_id",
    "ticket_text",
    "mode",
    "model",
    "category",
    "urgency",
    "escalate",
    "queue",
    "escalation_queue",
    "latency_ms",
    "decision_json",
]
LEDGER = T.StructType(
    [T.StructField(name, {"created_at": T.TimestampType(), "escalate": T.IntegerType(), "latency_ms": _l}.get(name, _s)) for name in AUDIT_COLUMNS]
    + [T.StructField("created_date", T.DateType())]
)
