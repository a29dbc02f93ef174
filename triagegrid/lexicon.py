"""The words, patterns, tables and sentence forms every result depends on.

Nothing in this module is logic.  Each value below is part of the output contract: changing one
changes decisions.  Patterns are written without flags; the flags are added where they are used
(``triagegrid.functions.text``), and none of them needs look-around or back-references.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Enumerations, in rank or listing order.
# ---------------------------------------------------------------------------------------------
CATEGORIES = ["billing", "bug", "security", "legal_contract", "onboarding", "feature_request", "spam", "other"]
URGENCIES = ["low", "medium", "high", "critical"]
REASONS = ["security_incident", "data_exposure", "legal_threat", "compliance_request", "executive_mention"]

MODE_MODEL = "llm"
MODE_KEYWORDS = "rules"
MODE_FALLBACK = "llm_fallback_rules"

MAX_TICKET_CHARS = 20000
SUMMARY_CHARS = 140
SPAM_SUPPRESS_CONFIDENCE = 0.8

# ---------------------------------------------------------------------------------------------
# Guardrail rules as (name, reason, urgency floor, pattern), in firing order.
# Matched without regard to case.  The legal pattern deliberately has no closing boundary and the
# exposure pattern has no outer boundaries.  The executive floor is "low", so it never lifts.
# ---------------------------------------------------------------------------------------------
GUARDRAILS = [
    (
        "security.unauthorized_access",
        "security_incident",
        "high",
        r"\b(unauthori[sz]ed|credentials?|revoked?|former employee|terminated employee|ex-employee|offboard(ed|ing)?"
        r"|compromised|hacked|phish(ing|ed)?|malware|ransomware|brute.?force|session hijack|mfa|2fa|audit log)\b",
    ),
    (
        "security.vulnerability_report",
        "security_incident",
        "high",
        r"\b(vulnerabilit(y|ies)|IDOR|CVE-\d+|sql injection|xss|cross.site|exploit"
        r"|security (issue|flaw|hole|bug|contact)|responsible disclosure)\b",
    ),
    (
        "security.data_exposure",
        "data_exposure",
        "critical",
        r"(another (company|customer|tenant|org(anization)?)'?s?|other (companies|customers|tenants|orgs)'?"
        r"|someone else'?s|not our) (customer )?(records|data|accounts?|information|invoices?|users?)"
        r"|expos(ed|ing|ure)\s+(?:\w+\s+){0,4}(data|records|information|documents|pii|files)"
        r"|(data|records|information)\s+(?:\w+\s+){0,3}(was|were|got|is|are)\s+expos(ed|ing)"
        r"|data (leak|breach|exposure)|leaked"
        r"|permissions? (issue|change|problem|error|misconfigur\w+|bug)"
        r"|(visible|available|accessible|open) to (everyone|all staff|all users|the whole|anyone|contractors)",
    ),
    (
        "legal.threat",
        "legal_threat",
        "high",
        r"\b(legal team|legal action|lawyer|attorney|counsel|lawsuit|litigation|sue\b|suing|in breach|breach of|MSA\b"
        r"|master services? agreement|arbitration|subpoena|cease and desist|small claims)",
    ),
    (
        "legal.compliance_request",
        "compliance_request",
        "high",
        r"\b(GDPR|CCPA|HIPAA|DSAR|data subject|right to (be forgotten|erasure|deletion)|article 17|regulator|regulatory"
        r"|data protection (authority|officer))\b",
    ),
    (
        "executive.mention",
        "executive_mention",
        "low",
        r"\b(CEO|CFO|CTO|COO|CIO|CISO|CRO|CMO|founder|co-founder|VP\b|vice president|president|chief [a-z]+ officer"
        r"|executive team|leadership team|board of directors|the board|general counsel)\b",
    ),
]
ACTIVE_INCIDENT = (
    r"\b(logged in|logged into|this morning|right now|currently|still (has|have) access|we can see activity"
    r"|was able to (see|access|view)|able to see|exported)\b"
)
INCIDENT_REASONS = ["security_incident", "data_exposure"]
LEGAL_REASONS = ["legal_threat", "compliance_request"]

# ---------------------------------------------------------------------------------------------
# Keyword patterns, matched without regard to case.
# ---------------------------------------------------------------------------------------------
SPAM = (
    r"\b(free credits?|discord|telegram|whatsapp|crypto|bitcoin|mining|lol|lmao|my (uncle|cousin)|"
    r"seo|backlinks?|5-star|guaranteed|click here|unsubscribe|casino|giveaway|hmu|dm me|"
    r"lead lists?|b2b leads?|contact lists?|cold (email|outreach)|wanna partner|"
    r"first \d+ free|reply [A-Z]{3,} to)\b"
)
BILLING = (
    r"\b(invoice|charged?|billed?|billing|refund|payment|plan|pricing|subscription|renewal|renew|seats?|credit card"
    r"|card on file|overcharg\w*|double.?bill\w*|cobr\w+|factura|suscripci[oó]n|reembols\w*|pago)\b"
)
BUG = (
    r"\b(error|500|bug|broken|throwing|crash\w*|not working|doesn'?t work|resets?|fails?|failing|down\b|outage|button"
    r"|toggle|export\b|dashboard|checkout|latency|429|timeout|slow)\b"
)
ONBOARDING = r"\b(onboard\w*|implementation|kickoff|set ?up|go.?live|migration)\b"
FEATURE = (
    r"\b(feature request|would be great|can you add|raise (the|our) limit|increase (the|our) limit|support for"
    r"|roadmap|integrat\w+)\b"
)
DEADLINE = (
    r"\b(due (today|tomorrow|friday|monday|tuesday|wednesday|thursday|this week)"
    r"|by (end of|eod|eow|friday|monday|tomorrow|today)|end of (day|week)|today|asap|urgent\w*|immediately|right away"
    r"|deadline)\b"
)
LOW_PRIORITY = r"\b(whenever you get a chance|no rush|low priority|not urgent|when you can|minor)\b"
OUTAGE = (
    r"\b(entire|whole|completely down|is down|been down|are down|outage|all (of )?our (users|team|customers|staff)"
    r"|can'?t (work|log ?in|access))\b"
)
WIDESPREAD_MONEY = (
    r"\b(customers?|users?|clients?)\b.*\b(twice|double|duplicate)\b"
    r"|\b(twice|double|duplicate)\b.*\b(customers?|users?|clients?)\b"
)
MONEY = r"\$\s?\d[\d,]*"
IDENTIFIER = (
    r"(invoice\s*#?\s*\d+|#\d{3,}|account\s*#?\s*[A-Z]?-?\d+|[\w.+-]+@[\w-]+\.[\w.]+|@[A-Za-z0-9_]{4,})"
)
EMAIL_DOMAIN = r"[\w.+-]+@([\w-]+\.[\w.]+)"
ENTERPRISE = (
    r"\b(enterprise|our (team|analysts|staff|engineers|org)|[0-9]{2,} (users|seats|analysts|people)|workspace"
    r"|unity catalog|databricks|sql warehouse|basecamp|SOW|MSA)\b"
)
SCALE = r"\b(all )?(\d{2,}) (of our )?(users|analysts|staff|employees|people|seats)\b"
PLAN = r"\b(team|pro|business|enterprise|starter) plan\b"

# Patterns that do regard case (a company is a capitalised name).
COMPANY = (
    r"(?:\bfrom|\bat|on behalf of)\s+([A-Z][A-Za-z0-9&]+(?:\s+(?:Corp|Inc|LLC|Ltd|Co|Labs|Group|Technologies|Systems"
    r"|Logistics|Health|Healthcare|Partners|Solutions|Media|Capital|Industries|Analytics|Digital))?)"
)
# The two dashes are U+2014 and U+2013; the letter range U+00C0..U+017E is Latin with accents.
SIGNATURE = (
    r"[\x{2014}\x{2013}-]{1,2}\s*([A-Z\x{00c0}-\x{017e}][\w.'\x{00c0}-\x{017e}]+"
    r"(?:\s+[A-Z\x{00c0}-\x{017e}][\w.'\x{00c0}-\x{017e}]+){0,2})"
    r"\s*,\s*([A-Z\x{00c0}-\x{017e}][\w&.'\x{00c0}-\x{017e}]+"
    r"(?:\s+[A-Z\x{00c0}-\x{017e}][\w&.'\x{00c0}-\x{017e}]+){0,3})\s*$"
)

# Word lists.  The operator's own product names belong on the second list too; they
# differ per installation and are passed as ``own_names``.
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "proton.me"]
NOT_A_COMPANY = [
    "Chrome", "Firefox", "Safari", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December", "The", "Our", "Your", "My", "Q1", "Q2", "Q3", "Q4",
]

# ---------------------------------------------------------------------------------------------
# Confidences of the keyword reading.
# ---------------------------------------------------------------------------------------------
CONF_SPAM, CONF_SECURITY, CONF_LEGAL = 0.85, 0.8, 0.7
CONF_CLEAR_COUNT, CONF_CLOSE_COUNT = 0.6, 0.5
CONF_ONBOARDING, CONF_FEATURE, CONF_OTHER = 0.6, 0.5, 0.3
WHO_STATED, WHO_WORK_MAIL, WHO_SCALE, WHO_CUE, WHO_WEAK = 1.0, 0.8, 0.5, 0.45, 0.3

# ---------------------------------------------------------------------------------------------
# Sentences that appear verbatim in decisions.
# ---------------------------------------------------------------------------------------------
SIGNAL_WIDESPREAD = "multiple customers + duplicate charges"
BASIS_SIGNED = "signed off with a name and company"
BASIS_NAMED = "company named in the text"
BASIS_WORK_MAIL = "work email domain {}"
BASIS_FREE_MAIL = "personal email domain"
BASIS_ENTERPRISE = "enterprise product language: “{}”"
BASIS_SCALE = "stated scale: “{}”"
BASIS_PLAN = "plan referenced: “{}”"
BASIS_IDENTIFIER = "identifier in the text: {}"
GUESS_WORK_MAIL = "someone at {}"
GUESS_FREE_MAIL = "an individual user"
GUESS_ENTERPRISE = "an enterprise customer"
GUESS_SCALE = "a customer with a sizeable team"
GUESS_PLAN = "a customer on the {}"
GUESS_IDENTIFIER = "an existing customer (account reference present)"
WHO_REASON_STATED = "The text names “{}” directly."
WHO_REASON_CHECKED = "No company after 'from', 'at' or 'on behalf of', no sign-off line, no email address."
WHO_REASON_FOUND = " Found: {basis}. So: {guess}, at {confidence}."
WHO_REASON_NOTHING = " No plan, team size, product or account reference either, so not stated."
CATEGORY_REASON = (
    "Keyword match put this in '{}'. This is the fallback classifier, which counts cue words rather than reading the "
    "request, so it cannot weigh a near alternative and reports none."
)
URGENCY_REASON_CUES = "Urgency words set '{urgency}': {signals}."
URGENCY_REASON_NONE = "No deadline, outage or 'no rush' words, so '{urgency}' to start."
ESCALATION_REASON_TEXT = (
    "Escalation is decided by the guardrail regexes that run after this step, not by the keyword classifier."
)
RATIONALE = (
    "Keyword-rules mode (no model available): category '{category}' by cue words, urgency '{urgency}'. Escalation is "
    "decided by the guardrail layer."
)
EFFECT_ESCALATE = "escalate: false -> true"
EFFECT_REASON = "reason +{}"
EFFECT_URGENCY = "urgency {before} -> {after}"
EFFECT_CONFIRMED = "confirmed model decision"
OVERRIDE_ESCALATE = "{rule} forced escalate=true (matched '{matched}')"
OVERRIDE_URGENCY = "{rule} lifted urgency {before} -> {after}"
LIFT_FIRED = "Then the {topic} rule fired on '{matched}'"
LIFT_ACTIVE = ", and '{active}' says it is happening now. An incident in progress is {after}."
LIFT_FLOOR = ". A {topic} is at least {after}."
SUPPRESS_RULE = "spam.suppress"
SUPPRESS_MATCHED = "category=spam"
SUPPRESS_EFFECT = "escalate: true -> false"
SUPPRESS_OVERRIDE = "spam.suppress cleared escalation on high-confidence spam"

# Why the expensive reader is, or is not, worth its price.
WHY_RULE_MATCHED = "a keyword rule matched ({}), so this is worth the expensive reader"
WHY_KEYWORD_URGENCY = "keyword urgency read as {} before any model ran"
WHY_CHEAP = "no escalation keyword and no urgency signal, so the cheap reader is enough"
WHY_DRAFT_ESCALATED = "the draft escalated it, and a wrong escalation call is expensive either way"
WHY_DRAFT_URGENT = "the draft called it {}, which is high-stakes enough to confirm"
WHY_DRAFT_UNSURE = "the draft was unsure about the category ({})"
WHY_DRAFT_STANDS = "low stakes and confident, so the draft stands"

# ---------------------------------------------------------------------------------------------
# Routing.  (category, urgency or None for the category's default) -> queue.
# ---------------------------------------------------------------------------------------------
ROUTES = [
    ("billing", None, "billing-support"),
    ("billing", "critical", "billing-oncall"),
    ("bug", None, "engineering-triage"),
    ("bug", "critical", "engineering-oncall"),
    ("security", None, "security-incident-response"),
    ("legal_contract", None, "legal-and-account-management"),
    ("onboarding", None, "customer-success"),
    ("feature_request", None, "product-feedback"),
    ("spam", None, "spam-review"),
    ("other", None, "general-support"),
]
ESCALATION_QUEUE = "human-escalation-desk"
LOW_CONFIDENCE_QUEUE = "human-review"
LOW_CONFIDENCE_THRESHOLD = 0.5

# USD per million tokens as (model prefix, input, cached input, output).
RATE_CARD = [
    ("gpt-5", 1.25, 0.125, 10.00),
    ("gpt-5-mini", 0.25, 0.025, 2.00),
    ("gpt-5-nano", 0.05, 0.005, 0.40),
]
DEFAULT_MODEL = "gpt-5"

# Planning figures for a spend forecast, per call.
FORECAST_INPUT_TOKENS = 2500
FORECAST_CACHED_SHARE = 0.9
FORECAST_OUTPUT_TOKENS = {"minimal": 450, "low": 900, "medium": 1600, "high": 2600}
FORECAST_BUDGET_USD = 0.25

# ---------------------------------------------------------------------------------------------
# The fields of a recheck as (name, label, whether it changes where the ticket goes).
# ---------------------------------------------------------------------------------------------
RECHECK_LABELS = [
    ("category", "What kind of request", True),
    ("urgency", "How urgent", True),
    ("escalate", "Escalate?", True),
    ("escalation_reasons", "Escalated for", True),
    ("queue", "Where it goes", True),
    ("customer", "Who sent it", False),
    ("category_confidence", "Category confidence", False),
    ("customer_confidence", "Customer confidence", False),
    ("category_reason", "The wording of the reason", False),
]
NO_REASONS = "—"
WHO_GUESSED = "(not stated) {}"
WHO_NOT_STATED = "(not stated)"
KEYWORD_READER = "keyword rules"

# ---------------------------------------------------------------------------------------------
# The lines of a decision's explanation.
# ---------------------------------------------------------------------------------------------
EXPLAIN_HEAD = "Ticket {id}  ({at}, mode={mode}, model={model})"
EXPLAIN_CUSTOMER = "  Customer:   {}"
EXPLAIN_GUESS = "{guess} (inferred, confidence {confidence})"
EXPLAIN_NOBODY = "unknown"
EXPLAIN_IDS = "              ids={}"
EXPLAIN_BASIS = "  basis={}"
EXPLAIN_WHY = "              why: {}"
EXPLAIN_CATEGORY = "  Category:   {category} (confidence {confidence})"
EXPLAIN_URGENCY = "  Urgency:    {urgency}  signals={signals}"
EXPLAIN_ESCALATE = "  Escalate:   {escalate}  reasons={reasons}"
EXPLAIN_ROUTE = "  Routed to:  {}"
EXPLAIN_SECOND_ROUTE = "  + {}"
EXPLAIN_RATIONALE = "Overall rationale:"
EXPLAIN_RULES = "Guardrail rules that fired:"
EXPLAIN_RULE = "  - {rule}: matched '{matched}' -> {effect}"
EXPLAIN_NO_RULE = "  (none)"
EXPLAIN_OVERRIDES = "\nOverrides applied to the model's answer:\n"
EXPLAIN_OVERRIDE = "  - {}"
EXPLAIN_ERROR = "\nError during classification: {}"

#: Patterns that run only where one of their pieces occurs (``functions.pieces``).
GATED = [
    *[g[3] for g in GUARDRAILS], SPAM, BILLING, BUG, ONBOARDING, FEATURE, DEADLINE, LOW_PRIORITY, OUTAGE, WIDESPREAD_MONEY, MONEY, IDENTIFIER,
    EMAIL_DOMAIN, ENTERPRISE, SCALE, PLAN, ACTIVE_INCIDENT,
]
