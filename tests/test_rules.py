"""Guardrails and the keyword reading, on tickets of our own."""
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.guardrails import ACTIVE, MATCHES, add_guardrails
from triagegrid.functions.pieces import PIECES, pieces_of
from triagegrid.operators.decide import decide

# A museum with a workshop, its visitors and its suppliers.
TEXTS = {
    "kiln": "The kiln cooled at Sunday noon - Mara Voss, Kiln House",
    "barcode": "The barcode reader is broken since the move.",
    "map_label": "Minor: a label on the floor map is broken.",
    "kiosk": "The kiosk crashes and the exhibition opens soon, we need it by friday.",
    "booking": "The booking page is down.",
    "twice": "users see every order twice at checkout",
    "refund": "The refund for invoice #8841 went to the wrong card.",
    "workshop": "El pago del taller sale mal. — Inés Ferrer, Casa Lumbre",
    "loom": "It stops after a minute. - Otto Brandt, Linden Weavers",
    "lamp": "The lamp blinks — it does so each time.",
    "plan": "On the starter plan the map is grey.",
    "more_plan": "How much are twelve more people under the current plan?",
    "badge": "The badge of last year's gardener was never revoked.",
    "night_desk": "Somebody has the credentials of the night desk and reads the visitor book right now.",
    "allergies": "Guest allergies were leaked to the newsletter.",
    "till": "The tablet at the till lists another company's invoices.",
    "lawsuit": "The landlord announced a lawsuit over the hall.",
    "careers": "Career counseling fills up in May.",
    "founder": "The founder visits in spring, no rush with the banner.",
    "casino": "Bitcoin casino for museums, GDPR approved, click here.",
    "hours": "Where is the list of opening hours kept?",
    "parcel": "A parcel from Ourproduct never came",
    "work_mail": "Write to desk@linden.example please, the poster is blank.",
    "free_mail": "Write to desk@GMAIL.com please, the poster is blank.",
    "lockers": "Some 75 employees stand before locked doors.",
    "waiting": "Ticket #70311 waits since spring.",
    "inside": "ïxss stands in the guest book",
    "two_lines": "  hello  \nsecond line",
}


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(k, v, "t", k) for k, v in TEXTS.items()], "id string, text string, source string, external_id string")
    return {r["id"]: r for r in decide(rows, own_names=["Ourproduct"]).collect()}


@pytest.mark.parametrize(
    ("name", "category", "urgency", "escalate"),
    [
        ("barcode", "bug", "medium", False),
        ("map_label", "bug", "low", False),
        ("kiosk", "bug", "high", False),
        ("booking", "bug", "critical", False),
        ("twice", "bug", "critical", False),
        ("refund", "billing", "medium", False),
        ("workshop", "billing", "medium", False),
        ("more_plan", "billing", "medium", False),
        ("badge", "security", "high", True),
        ("night_desk", "security", "critical", True),
        ("allergies", "security", "critical", True),
        ("till", "security", "critical", True),
        ("lawsuit", "legal_contract", "high", True),
        ("careers", "legal_contract", "high", True),
        ("founder", "other", "low", True),
        ("casino", "spam", "low", False),
        ("hours", "other", "medium", False),
        ("inside", "other", "medium", False),
        ("two_lines", "other", "medium", False),
    ],
)
def test_decision(got, name, category, urgency, escalate):
    x = got[name]["extraction"]
    assert (x["category"], x["urgency"], x["escalate"]) == (category, urgency, escalate)


@pytest.mark.parametrize(
    ("name", "customer", "contact", "guess", "confidence"),
    [
        ("workshop", "Casa Lumbre", "Inés Ferrer", "Casa Lumbre", 1.0),
        ("loom", "Linden Weavers", "Otto Brandt", "Linden Weavers", 1.0),
        ("lamp", None, None, None, 0.0),
        ("kiln", "Kiln House", "Mara Voss", "Kiln House", 1.0),
        ("parcel", None, None, None, 0.0),
        ("work_mail", None, None, "someone at linden.example", 0.8),
        ("free_mail", None, None, "an individual user", 0.3),
        ("lockers", None, None, "a customer with a sizeable team", 0.5),
        ("plan", None, None, "a customer on the starter plan", 0.45),
        ("waiting", None, None, "an existing customer (account reference present)", 0.3),
    ],
)
def test_sender(got, name, customer, contact, guess, confidence):
    c = got[name]["extraction"]["customer"]
    assert (c["name"], c["contact_name"], c["best_guess"], c["confidence"]) == (customer, contact, guess, confidence)
    assert c["basis"] or c["confidence"] == 0.0


def test_spam_suppression_keeps_the_trail(got):
    d = got["casino"]
    assert d["extraction"]["category_confidence"] == 0.85
    assert [h["rule"] for h in d["rule_hits"]] == ["legal.compliance_request", "spam.suppress"]
    assert "spam.suppress" in d["overrides"][-1] and d["extraction"]["escalation_reasons"] == []
    # The undone lift is still described.
    assert "compliance request rule" in d["extraction"]["urgency_reason"]


def test_whole_decision_strings(got):
    x = got["night_desk"]["extraction"]
    assert x["urgency_signals"] == ["credentials", "right now"]
    assert x["urgency_reason"] == (
        "No deadline, outage or 'no rush' words, so 'medium' to start. Then the security incident rule fired on "
        "'credentials', and 'right now' says it is happening now. An incident in progress is critical."
    )
    assert got["night_desk"]["rule_hits"][0]["effect"] == "escalate: false -> true; reason +security_incident; urgency medium -> critical"
    assert got["night_desk"]["queue"] == "security-incident-response"
    # The whole text is stripped, then cut: blanks at the end of a first line stay.
    assert got["two_lines"]["extraction"]["summary"] == "hello  " and got["two_lines"]["queue"] == "human-review"


def lifted(before, after):
    return L.EFFECT_URGENCY.format(before=before, after=after)


ACCESS, REPORT, EXPOSURE, THREAT, COMPLIANCE, EXECUTIVE = [name for name, *_ in L.GUARDRAILS]
PLAIN = dict(escalate=False, reasons=[], urgency="low", why="Said so.  ", signals=[], category="other", confidence=0.5)
# (firing rules, active cue, changes to PLAIN) -> (escalate, reasons, urgency, signals, effects by rule)
STEPS = {
    "nothing fires": ([], "", {}, (False, [], "low", [], {})),
    "first rule opens, second adds its reason": (
        [THREAT, COMPLIANCE], "", {},
        (True, ["legal_threat", "compliance_request"], "high", ["m3"], {THREAT: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("legal_threat"), lifted("low", "high")], COMPLIANCE: [L.EFFECT_REASON.format("compliance_request")]}),
    ),
    "an incident in progress is critical at once": (
        [ACCESS, EXPOSURE], "now", {},
        (True, ["security_incident", "data_exposure"], "critical", ["m0", "now"], {ACCESS: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("security_incident"), lifted("low", "critical")], EXPOSURE: [L.EFFECT_REASON.format("data_exposure")]}),
    ),
    "urgency climbs twice": (
        [REPORT, EXPOSURE], "", {},
        (True, ["security_incident", "data_exposure"], "critical", ["m1", "m2"], {REPORT: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("security_incident"), lifted("low", "high")], EXPOSURE: [L.EFFECT_REASON.format("data_exposure"), lifted("high", "critical")]}),
    ),
    "all said already": (
        [THREAT], "", dict(escalate=True, reasons=["legal_threat"], urgency="critical"),
        (True, ["legal_threat"], "critical", [], {THREAT: [L.EFFECT_CONFIRMED]}),
    ),
    "an executive never lifts": ([EXECUTIVE], "", {}, (True, ["executive_mention"], "low", [], {EXECUTIVE: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("executive_mention")]})),
    "a cue is listed once": ([EXPOSURE], "", dict(signals=["m2"]), (True, ["data_exposure"], "critical", ["m2"], {EXPOSURE: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("data_exposure"), lifted("low", "critical")]})),
    "confident spam clears it all": (
        [THREAT], "", dict(category="spam", confidence=0.8),
        (False, [], "low", ["m3"], {THREAT: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("legal_threat"), lifted("low", "high")], L.SUPPRESS_RULE: [L.SUPPRESS_EFFECT]}),
    ),
    "doubtful spam does not": (
        [THREAT], "", dict(category="spam", confidence=0.79),
        (True, ["legal_threat"], "high", ["m3"], {THREAT: [L.EFFECT_ESCALATE, L.EFFECT_REASON.format("legal_threat"), lifted("low", "high")]}),
    ),
}


def test_guardrail_steps(spark):
    rules = [name for name, *_ in L.GUARDRAILS]
    rows = []
    for name, (fired, active, changes, _) in STEPS.items():
        b = {**PLAIN, **changes}
        matches = [f"m{i}" if rule in fired else "" for i, rule in enumerate(rules)]
        rows.append((name, *matches, active, b["category"], b["confidence"], b["escalate"], b["reasons"], b["urgency"], b["why"], b["signals"]))
    names = ["name", *MATCHES, ACTIVE, *[f"base_{n}" for n in ("category", "category_confidence", "escalate", "escalation_reasons", "urgency", "urgency_reason", "urgency_signals")]]
    types = ["string", *["string"] * 7, "string", "double", "boolean", "array<string>", "string", "string", "array<string>"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    for r in add_guardrails(df).collect():
        want = STEPS[r["name"]][3]
        effects = {h["rule"]: h["effect"].split("; ") for h in r["final_rule_hits"]}
        assert (r["final_escalate"], r["final_escalation_reasons"], r["final_urgency"], r["final_urgency_signals"], effects) == want, r["name"]


@pytest.mark.parametrize("regex", L.GATED, ids=lambda p: p[:30])
def test_every_match_holds_a_piece(regex):
    """The cheap look for pieces never hides a match."""
    pieces = PIECES[regex]

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(regex, re.I | re.A)))
    def check(text):
        if re.search(regex, text, re.I | re.A):
            assert any(p in text.lower() for p in pieces), text

    check()


def test_a_pattern_without_a_sure_piece_fails():
    assert pieces_of("(red|blue) (ca[rt]s?)") == ["blue car", "blue cat", "red car", "red cat"]
    for pattern in (r"\d+", "(a|b*)", "x?"):
        with pytest.raises(ValueError):
            pieces_of(pattern)


def test_gated_and_ungated_reading_agree(spark):
    from triagegrid.functions import keywords as K
    from triagegrid.functions.text import add_folded

    odd = [*TEXTS.values(), "THE ſCHEDULE ıS DUE TODAY, OUR CRYPTO MİNİNG BACKLİNKS", "Kelvin: bacKlinks and discord"]
    df = add_folded(spark.createDataFrame([(t,) for t in odd], "text string"))
    t = F.col("text")
    a, b = K.keyword_category(t), K.keyword_category(t, "_low")
    rows = df.select(
        a.alias("a"), b.alias("b"), K.keyword_urgency(t, a["category"]).alias("c"), K.keyword_urgency(t, b["category"], "_low").alias("d"),
        K.identifiers(t).alias("e"), K.identifiers(t, "_low").alias("f"),
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"] for r in rows)
    assert rows[-1]["a"]["category"] == "spam" and rows[-2]["a"]["category"] == "spam"
