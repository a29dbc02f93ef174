"""SQL written independently of the operators, for checking them on the same tables.

The guardrails are a sequential fold here (one CTE per rule, carrying the state), where the operators
use a closed form.  Only the fixed values are shared.
"""
from __future__ import annotations

from triagegrid import lexicon as L
from triagegrid.plans import derived as D


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def rx(text: str, pattern: str, group: int = 0, any_case: bool = True) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group}{', ' + q('i') if any_case else ''})"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)}, 'i')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}, 0, 'i'))"


def strip(text: str) -> str:
    return f"regexp_extract({text}, '^\\s*(.*\\S)', 1, 's')"


def _text(key: str, amount: str, seg: str, body: str | None = None) -> str:
    opener = f"({lst(D.OPENERS)})[({key}) % {len(D.OPENERS)} + 1]"
    closer = f"({lst(D.CLOSERS)})[(({key}) // {len(D.OPENERS)}) % {len(D.CLOSERS)} + 1]"
    middle = f" || ' ' || {body}" if body else ""
    text = f"{opener}{middle} || ' ' || {closer}"
    return f"replace(replace(replace({text}, '{{n}}', CAST({key} AS VARCHAR)), '{{amt}}', '$' || {amount}), '{{seg}}', {seg})"


def _cap(column: str) -> str:
    return f"upper({column}[1]) || lower({column}[2:])"


_WHOLE_PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
ORD = f"""ord AS (SELECT *, {_cap('c_mktsegment')} AS seg FROM orders JOIN customer ON o_custkey = c_custkey)"""
ORDER_TICKETS = f"""{ORD},
tickets AS (SELECT 'O-' || o_orderkey AS id, {_text('o_orderkey', _WHOLE_PRICE, 'seg')} AS text,
  'shop-' || o_orderstatus AS source,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN 'C-' || o_custkey END AS external_id,
  CAST(o_orderdate AS TIMESTAMP) AS created_at FROM ord)"""
DOCUMENT_TICKETS = f"""tickets AS (SELECT 'D-' || doc_id AS id,
  {_text('doc_id', 'CAST(n_chars AS VARCHAR)', _cap('lang'), 'text')} AS text, source, 'D-' || doc_id AS external_id,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM documents)"""
EVENTS = f"""ev AS (SELECT 'E-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(ts AS TIMESTAMP) AS created_at,
  event_type AS source, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS external_id,
  CASE WHEN event_id % 7 = 0 THEN 'llm_fallback_rules' WHEN event_id % 2 = 0 THEN 'llm' ELSE 'rules' END AS mode,
  CASE WHEN event_id % 7 = 0 THEN 'error ' || event_id END AS error,
  ({lst(L.CATEGORIES)})[event_id % 8 + 1] AS category, ({lst(L.URGENCIES)})[(event_id // 8) % 4 + 1] AS urgency,
  CAST(event_id % 5 = 0 AS INTEGER) AS escalate, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence,
  CAST(floor(value * 100) AS BIGINT) AS latency_ms FROM events)"""


def route_sql(category: str, urgency: str, escalate: str, confidence: str) -> str:
    table: dict[str, list[tuple[str, str]]] = {}
    default = {}
    for cat, level, queue in L.ROUTES:
        if level is None:
            default[cat] = queue
        else:
            table.setdefault(cat, []).append((level, queue))
    arms = ""
    for cat, queue in default.items():
        inner = "".join(f" WHEN {urgency} = {q(lv)} THEN {q(qu)}" for lv, qu in table.get(cat, []))
        value = f"CASE{inner} ELSE {q(queue)} END" if inner else q(queue)
        arms += f" WHEN {q(cat)} THEN {value}"
    return (
        f"CASE WHEN NOT ({escalate}) AND {confidence} < {L.LOW_CONFIDENCE_THRESHOLD} THEN {q(L.LOW_CONFIDENCE_QUEUE)} "
        f"ELSE CASE {category}{arms} ELSE {q(default['other'])} END END"
    )


def esc_queue_sql(escalate: str) -> str:
    return f"CASE WHEN {escalate} THEN {q(L.ESCALATION_QUEUE)} END"


LEDGER = f"""{EVENTS},
ledger AS (SELECT id, created_at, source, external_id, mode, error, category, urgency, escalate,
  {route_sql('category', 'urgency', 'escalate = 1', 'confidence')} AS queue, {esc_queue_sql('escalate = 1')} AS escalation_queue,
  latency_ms FROM ev)"""


def keyword_ctes(src: str = "tickets") -> str:
    """m: matches; k: category; u: urgency; s: sender; kw: the whole keyword reading."""
    g = ", ".join(f"{rx('text', p)} AS g{i}" for i, (_, _, _, p) in enumerate(L.GUARDRAILS))
    free = ", ".join(q(d) for d in L.FREE_MAIL)
    no = ", ".join(q(d) for d in L.NOT_A_COMPANY)

    def slot(template: str, **values: str) -> str:
        text = q(template.replace("{}", "{value}"))
        for name, value in values.items():
            text = f"replace({text}, '{{{name}}}', {value})"
        return text

    def first_word(x: str) -> str:
        return f"regexp_extract({x}, '^\\s*(\\S+)', 1)"

    return f"""
m AS (SELECT *, {g}, {rx('text', L.ACTIVE_INCIDENT)} AS act, {count('text', L.SPAM)} AS spam_n,
  {count('text', L.BUG)} AS bug_n, {count('text', L.BILLING)} AS bill_n FROM {src}),
k AS (SELECT *, CASE WHEN spam_n >= 2 AND NOT sec THEN 'spam' WHEN sec THEN 'security' WHEN leg THEN 'legal_contract'
    WHEN bug_n + bill_n > 0 THEN CASE WHEN bill_n > bug_n THEN 'billing' ELSE 'bug' END
    WHEN {has('text', L.ONBOARDING)} THEN 'onboarding' WHEN {has('text', L.FEATURE)} THEN 'feature_request' ELSE 'other' END AS k_cat,
  CASE WHEN spam_n >= 2 AND NOT sec THEN 0.85 WHEN sec THEN 0.8 WHEN leg THEN 0.7
    WHEN bug_n + bill_n > 0 THEN CASE WHEN abs(bug_n - bill_n) > 1 THEN 0.6 ELSE 0.5 END
    WHEN {has('text', L.ONBOARDING)} THEN 0.6 WHEN {has('text', L.FEATURE)} THEN 0.5 ELSE 0.3 END::DOUBLE AS k_conf
  FROM (SELECT *, g0 <> '' OR g1 <> '' OR g2 <> '' AS sec, g3 <> '' OR g4 <> '' AS leg FROM m)),
u0 AS (SELECT *, CASE WHEN k_cat = 'spam' THEN 'low' WHEN {has('text', L.WIDESPREAD_MONEY)} THEN 'critical'
    WHEN k_cat = 'bug' AND {has('text', L.OUTAGE)} THEN 'outage' WHEN {has('text', L.LOW_PRIORITY)} THEN 'minor'
    WHEN {has('text', L.DEADLINE)} THEN 'high' ELSE 'medium' END AS step FROM k),
u AS (SELECT *, CASE step WHEN 'outage' THEN 'critical' WHEN 'minor' THEN 'low' ELSE step END AS k_urg,
  CASE WHEN step = 'low' THEN [] WHEN step = 'critical' THEN [{q(L.SIGNAL_WIDESPREAD)}] WHEN step = 'outage' THEN [{rx('text', L.OUTAGE)}]
    WHEN step = 'minor' THEN [{rx('text', L.LOW_PRIORITY)}] WHEN step = 'high' THEN [{rx('text', L.DEADLINE)}]
    WHEN {has('text', L.MONEY)} THEN [{rx('text', L.MONEY)}] ELSE [] END::VARCHAR[] AS k_sig FROM u0),
s0 AS (SELECT *, {rx('text', L.COMPANY, 1, False)} AS co, {rx(strip('text'), L.SIGNATURE, 1, False)} AS sg_who,
  {rx(strip('text'), L.SIGNATURE, 2, False)} AS sg_co, regexp_extract_all(text, {q(L.IDENTIFIER)}, 1, 'i') AS ids FROM u),
s1 AS (SELECT *, co <> '' AND {first_word('co')} NOT IN ({no}) AS has_co,
  sg_co <> '' AND {first_word('sg_co')} NOT IN ({no}) AS has_sg FROM s0),
s2 AS (SELECT *, CASE WHEN has_co THEN co WHEN has_sg THEN sg_co END AS who,
  CASE WHEN NOT has_co AND has_sg THEN sg_who END AS contact, {rx('text', L.EMAIL_DOMAIN, 1)} AS dom,
  {rx('text', L.ENTERPRISE)} AS ent, {rx('text', L.SCALE)} AS sc, {rx('text', L.PLAN)} AS pl FROM s1),
s3 AS (SELECT *, CASE WHEN dom = '' THEN NULL WHEN lower(dom) IN ({free}) THEN {q(L.GUESS_FREE_MAIL)} ELSE {slot(L.GUESS_WORK_MAIL, value='dom')} END AS w1,
  CASE WHEN dom = '' THEN 0.0 WHEN lower(dom) IN ({free}) THEN 0.3 ELSE 0.8 END::DOUBLE AS c1,
  CASE WHEN dom = '' THEN [] WHEN lower(dom) IN ({free}) THEN [{q(L.BASIS_FREE_MAIL)}] ELSE [{slot(L.BASIS_WORK_MAIL, value='dom')}] END::VARCHAR[] AS b1 FROM s2),
s4 AS (SELECT *, CASE WHEN ent <> '' AND c1 < 0.5 THEN coalesce(w1, {q(L.GUESS_ENTERPRISE)}) ELSE w1 END AS w2,
  CASE WHEN ent <> '' AND c1 < 0.5 THEN greatest(c1, 0.45) ELSE c1 END::DOUBLE AS c2,
  CASE WHEN ent <> '' THEN list_append(b1, {slot(L.BASIS_ENTERPRISE, value='ent')}) ELSE b1 END AS b2 FROM s3),
s5 AS (SELECT *, CASE WHEN sc <> '' THEN coalesce(w2, {q(L.GUESS_SCALE)}) ELSE w2 END AS w3,
  CASE WHEN sc <> '' THEN greatest(c2, 0.5) ELSE c2 END::DOUBLE AS c3,
  CASE WHEN sc <> '' THEN list_append(b2, {slot(L.BASIS_SCALE, value='sc')}) ELSE b2 END AS b3 FROM s4),
s6 AS (SELECT *, CASE WHEN pl <> '' THEN coalesce(w3, {slot(L.GUESS_PLAN, value='pl')}) ELSE w3 END AS w4,
  CASE WHEN pl <> '' THEN greatest(c3, 0.45) ELSE c3 END::DOUBLE AS c4,
  CASE WHEN pl <> '' THEN list_append(b3, {slot(L.BASIS_PLAN, value='pl')}) ELSE b3 END AS b4 FROM s5),
s7 AS (SELECT *, CASE WHEN w4 IS NULL AND len(ids) > 0 THEN {q(L.GUESS_IDENTIFIER)} ELSE w4 END AS w5,
  CASE WHEN w4 IS NULL AND len(ids) > 0 THEN 0.3 ELSE c4 END::DOUBLE AS c5,
  CASE WHEN w4 IS NULL AND len(ids) > 0 THEN list_append(b4, {slot(L.BASIS_IDENTIFIER, value='ids[1]')}) ELSE b4 END AS b5 FROM s6),
kw AS (SELECT *, CASE WHEN who IS NOT NULL THEN who ELSE w5 END AS guess, CASE WHEN who IS NOT NULL THEN 1.0 ELSE c5 END::DOUBLE AS who_conf,
  CASE WHEN who IS NULL THEN b5 WHEN contact IS NOT NULL THEN [{q(L.BASIS_SIGNED)}] ELSE [{q(L.BASIS_NAMED)}] END AS basis,
  CASE WHEN who IS NOT NULL THEN {slot(L.WHO_REASON_STATED, value='who')}
    WHEN len(b5) > 0 THEN {q(L.WHO_REASON_CHECKED)} || {slot(L.WHO_REASON_FOUND, basis="array_to_string(b5, '; ')", guess='w5', confidence='CAST(c5 AS VARCHAR)')}
    ELSE {q(L.WHO_REASON_CHECKED + L.WHO_REASON_NOTHING)} END AS who_why,
  {slot(L.CATEGORY_REASON, value='k_cat')} AS cat_why,
  CASE WHEN len(k_sig) > 0 THEN {slot(L.URGENCY_REASON_CUES, urgency='k_urg', signals="array_to_string(k_sig, ', ')")}
    ELSE {slot(L.URGENCY_REASON_NONE, urgency='k_urg')} END AS urg_why,
  substring(string_split({strip('text')}, chr(10))[1], 1, 140) AS summary,
  {slot(L.RATIONALE, category='k_cat', urgency='k_urg')} AS rationale FROM s7)"""


def fold_ctes(src: str, category: str, confidence: str, urgency: str, escalate: str, reasons: str, why: str, signals: str) -> str:
    """f6/d: the guardrails as a sequential fold over ``src`` (which has the columns of m)."""
    rank = f"list_position({lst(L.URGENCIES)}, {urgency}) - 1"
    name = lst(L.URGENCIES)
    sql = f"""
f0 AS (SELECT *, {category} AS cat, {confidence} AS conf, CAST({rank} AS INTEGER) AS ur, {escalate} AS esc, {reasons} AS rs,
  {why} AS uwhy, {signals} AS usig, []::VARCHAR[] AS hits, []::VARCHAR[] AS ovr FROM {src})"""
    for i, (rule, reason, floor, _) in enumerate(L.GUARDRAILS):
        incident = reason in L.INCIDENT_REASONS
        level = L.URGENCIES.index(floor)
        lvl = f"CASE WHEN act <> '' THEN 3 ELSE {level} END" if incident else str(level)
        topic = reason.replace("_", " ")
        lifted = "(fired AND lvl > ur)"
        after, before = f"{name}[greatest(ur, lvl) + 1]", f"{name}[ur + 1]"
        parts = (
            f"concat_ws('; ', CASE WHEN NOT esc THEN {q(L.EFFECT_ESCALATE)} END, "
            f"CASE WHEN NOT list_contains(rs, {q(reason)}) THEN {q(L.EFFECT_REASON.format(reason))} END, "
            f"CASE WHEN lvl > ur THEN 'urgency ' || {before} || ' -> ' || {after} END)"
        )
        active_tail = f"', and ''' || act || ''' says it is happening now. An incident in progress is ' || {after} || '.'"
        floor_tail = f"'. A {topic} is at least ' || {after} || '.'"
        tail = f"CASE WHEN act <> '' THEN {active_tail} ELSE {floor_tail} END" if incident else floor_tail
        told = f"'Then the {topic} rule fired on ''' || g{i} || '''' || {tail}"
        one = f"CASE WHEN list_contains(usig, g{i}) THEN usig ELSE list_append(usig, g{i}) END"
        cues = f"CASE WHEN act = '' OR list_contains({one}, act) THEN {one} ELSE list_append({one}, act) END" if incident else one
        sql += f""",
f{i + 1} AS (SELECT * EXCLUDE (fired, lvl) REPLACE (esc OR fired AS esc, CASE WHEN fired THEN greatest(ur, lvl) ELSE ur END AS ur,
    CASE WHEN fired AND NOT list_contains(rs, {q(reason)}) THEN list_append(rs, {q(reason)}) ELSE rs END AS rs,
    CASE WHEN {lifted} THEN CASE WHEN uwhy = '' THEN '' ELSE rtrim(uwhy) || ' ' END || {told} ELSE uwhy END AS uwhy,
    CASE WHEN {lifted} THEN {cues} ELSE usig END AS usig,
    CASE WHEN fired THEN list_append(hits, concat_ws('~', {q(rule)}, {q(reason)}, g{i},
      CASE WHEN {parts} = '' THEN {q(L.EFFECT_CONFIRMED)} ELSE {parts} END)) ELSE hits END AS hits,
    list_concat(ovr, CASE WHEN fired AND NOT esc THEN ['{rule} forced escalate=true (matched ''' || g{i} || ''')'] ELSE [] END,
      CASE WHEN {lifted} THEN ['{rule} lifted urgency ' || {before} || ' -> ' || {after}] ELSE [] END) AS ovr)
  FROM (SELECT *, g{i} <> '' AS fired, {lvl} AS lvl FROM f{i}))"""
    n = len(L.GUARDRAILS)
    off = "cat = 'spam' AND conf >= 0.8"
    sql += f""",
fs AS (SELECT * REPLACE (CASE WHEN {off} THEN false ELSE esc END AS esc, CASE WHEN {off} THEN []::VARCHAR[] ELSE rs END AS rs,
    CASE WHEN {off} THEN 0 ELSE ur END AS ur,
    CASE WHEN {off} AND esc THEN list_append(hits, 'spam.suppress~category=spam~escalate: true -> false') ELSE hits END AS hits,
    CASE WHEN {off} AND esc THEN list_append(ovr, {q(L.SUPPRESS_OVERRIDE)}) ELSE ovr END AS ovr) FROM f{n}),
d AS (SELECT *, {name}[ur + 1] AS urg, {route_sql('cat', f'{name}[ur + 1]', 'esc', 'conf')} AS queue, {esc_queue_sql('esc')} AS escalation_queue FROM fs)"""
    return sql


def rules_ctes(tickets: str) -> str:
    """All CTEs down to ``d``: keyword decisions of the given ticket CTEs."""
    return f"{tickets},{keyword_ctes()},{fold_ctes('kw', 'k_cat', 'k_conf', 'k_urg', 'false', '[]::VARCHAR[]', 'urg_why', 'k_sig')}"


RULES_ORDERS = "WITH " + rules_ctes(ORDER_TICKETS)
RULES_DOCUMENTS = "WITH " + rules_ctes(DOCUMENT_TICKETS)
# The lighter chain for queries that never read the sender.

_REASON = f"({lst(D.OPENER_REASON)})[o_orderkey % {len(D.OPENERS)} + 1]"
GOLD = f"""gold AS (SELECT 'O-' || o_orderkey AS gid, o_orderpriority AS grp, o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN ({lst(L.CATEGORIES)})[o_orderkey % 8 + 1] ELSE ({lst(D.OPENER_CATEGORY)})[o_orderkey % {len(D.OPENERS)} + 1] END AS e_cat,
  ({lst(L.URGENCIES)})[(o_orderkey // 3) % 4 + 1] AS e_urg, ({_REASON} IS NOT NULL) <> (o_orderpriority = '5-LOW') AS e_esc,
  CASE WHEN o_orderkey % 5 = 0 THEN seg END AS e_name, {_REASON} AS e_reason,
  CASE WHEN o_orderkey % {len(D.OPENERS)} = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % {len(D.OPENERS)} = 14 THEN 'A-' || o_orderkey END AS e_id,
  CASE o_orderstatus WHEN 'O' THEN 0.2 WHEN 'P' THEN 0.0 END::DOUBLE AS lo, CASE o_orderstatus WHEN 'O' THEN 0.9 WHEN 'P' THEN 0.3 END::DOUBLE AS hi,
  CASE o_orderpriority WHEN '1-URGENT' THEN ['urgency'] WHEN '2-HIGH' THEN ['category', 'urgency'] WHEN '3-MEDIUM' THEN ['escalate'] ELSE [] END::VARCHAR[] AS amb
  FROM ord)"""

ANSWERS = f"""ans0 AS (SELECT 'O-' || o_orderkey AS akey, ({lst(D.MODELS)})[o_orderkey % 4 + 1] AS a_model,
  o_orderstatus = 'P' AND o_orderkey % 11 = 0 AS a_failed, ({lst([*L.CATEGORIES, 'ninth-category'])})[o_orderkey % 9 + 1] AS a_cat,
  CAST(4 + o_orderkey % 7 AS DOUBLE) / 10 AS a_conf, ({lst(L.URGENCIES)})[(o_orderkey // 2) % 4 + 1] AS a_urg, o_orderkey % 3 = 0 AS a_esc,
  CASE WHEN o_orderkey % 3 = 0 THEN [({lst(L.REASONS)})[o_orderkey % 5 + 1]] ELSE [] END::VARCHAR[] AS a_rs,
  CASE WHEN o_orderkey % 4 = 0 THEN seg || ' Corp' END AS a_name, CASE WHEN o_orderkey % 4 <> 0 THEN 'a shop customer' END AS a_guess,
  CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.4 END::DOUBLE AS a_who_conf, ['#' || o_orderkey] AS a_ids,
  1000 + o_orderkey % 2000 AS tin, o_orderkey % 1500 AS tcached, 200 + o_orderkey % 700 AS tout, 1000 + (o_orderkey * 37) % 9000 AS a_ms
  FROM ord),
ans AS (SELECT *, CASE WHEN a_failed THEN 'APITimeoutError: Request timed out.'
  WHEN a_cat = 'ninth-category' THEN 'ValidationError: category: not a listed value' END AS a_problem FROM ans0)"""

ANSWERS_WITH_GAP = ANSWERS.replace("FROM ord)", "FROM ord WHERE o_orderpriority <> '4-NOT SPECIFIED')")


def cost_sql(model: str, tin: str, cached: str, out: str) -> str:
    def price(i: int) -> str:
        arms = "".join(
            f" WHEN starts_with({model}, {q(row[0])}) THEN {row[i]!r}" for row in sorted(L.RATE_CARD, key=lambda r: -len(r[0]))
        )
        default = next(row for row in L.RATE_CARD if row[0] == L.DEFAULT_MODEL)
        return f"CAST(CASE{arms} ELSE {default[i]!r} END AS DOUBLE)"

    return f"((greatest({tin} - {cached}, 0) * {price(1)} + {cached} * {price(2)} + {out} * {price(3)}) / 1000000.0::DOUBLE)"


def micro_sql(model: str, tin: str, cached: str, out: str) -> str:
    """Cost in millionths of a dollar, exact."""

    def price(i: int) -> str:
        arms = "".join(
            f" WHEN starts_with({model}, {q(row[0])}) THEN {row[i]!r}" for row in sorted(L.RATE_CARD, key=lambda r: -len(r[0]))
        )
        default = next(row for row in L.RATE_CARD if row[0] == L.DEFAULT_MODEL)
        return f"CAST(CASE{arms} ELSE {default[i]!r} END AS DECIMAL(9, 4))"

    return (
        f"(CAST(greatest({tin} - {cached}, 0) AS DECIMAL(12, 0)) * {price(1)} + CAST({cached} AS DECIMAL(12, 0)) * {price(2)} "
        f"+ CAST({out} AS DECIMAL(12, 0)) * {price(3)})"
    )


def usd6_sql(micro: str) -> str:
    return f"(CAST(round({micro}) AS DOUBLE) / 1000000)"


MODEL_BASE = f"""{ORDER_TICKETS}, {ANSWERS_WITH_GAP},{keyword_ctes()},
mb AS (SELECT kw.*, ans.*, akey IS NOT NULL AND a_problem IS NULL AS used FROM kw LEFT JOIN ans ON kw.id = ans.akey)"""
MODEL = (
    f"WITH {MODEL_BASE},"
    + fold_ctes(
        "mb",
        "CASE WHEN used THEN a_cat ELSE k_cat END",
        "CASE WHEN used THEN a_conf ELSE k_conf END",
        "CASE WHEN used THEN a_urg ELSE k_urg END",
        "coalesce(used AND a_esc, false)",
        "CASE WHEN used THEN a_rs ELSE []::VARCHAR[] END",
        "CASE WHEN used THEN 'By its tone.' ELSE urg_why END",
        "CASE WHEN used THEN ['tone'] ELSE k_sig END",
    )
    + f""",
dm AS (SELECT *, CASE WHEN used THEN 'llm' ELSE 'llm_fallback_rules' END AS mode, CASE WHEN used THEN a_model END AS model,
  CASE WHEN used THEN NULL WHEN akey IS NULL THEN 'ValueError: no answer for this ticket' ELSE a_problem END AS error,
  CASE WHEN used THEN {usd6_sql(micro_sql('a_model', 'tin', 'tcached', 'tout'))} END AS cost_usd,
  CASE WHEN used THEN a_name ELSE who END AS c_name, CASE WHEN used THEN a_guess ELSE guess END AS c_guess,
  CASE WHEN used THEN a_who_conf ELSE who_conf END AS c_conf, CASE WHEN used THEN ['order reference'] ELSE basis END AS c_basis,
  CASE WHEN used THEN a_ids ELSE ids END AS c_ids, CASE WHEN akey IS NULL THEN 0 ELSE a_ms END AS latency_ms FROM d)"""
)

RULES_AS_RUN = "dm AS (SELECT *, 'rules' AS mode, who AS c_name, guess AS c_guess, who_conf AS c_conf, basis AS c_basis, ids AS c_ids FROM d)"


def scores_cte(decided: str = "dm", out: str = "sc") -> str:
    """Scored rows of ``decided`` against gold."""
    got_rank, exp_rank = "ur", f"(list_position({lst(L.URGENCIES)}, e_urg) - 1)"
    return f"""{out} AS (SELECT gid, grp, e_esc, esc, cat, urg, e_cat, e_urg, rs, queue, e_id, c_name, c_conf, amb, lo, hi, mode, e_name, c_guess, ids, text, hits,
  (esc = e_esc OR list_contains(amb, 'escalate')) AS escalation_ok, (e_esc AND NOT esc) AS missed, (NOT e_esc AND esc AND NOT list_contains(amb, 'escalate')) AS false_esc,
  (e_reason IS NULL OR list_contains(rs, e_reason)) AS reasons_ok, (cat = e_cat OR list_contains(amb, 'category')) AS category_ok,
  urg = e_urg AS urgency_exact, (urg = e_urg OR (list_contains(amb, 'urgency') AND abs({got_rank} - {exp_rank}) <= 1)) AS urgency_ok,
  CASE WHEN e_name IS NULL AND c_name IS NULL THEN true WHEN e_name IS NULL OR c_name IS NULL THEN false ELSE contains(lower(c_name), lower(e_name)) END AS customer_ok,
  hi IS NOT NULL AS banded, (hi IS NULL OR c_conf <= hi) AS ceiling_ok, (lo IS NULL OR mode <> 'llm' OR c_conf >= lo) AS floor_ok,
  (len(c_basis) > 0 OR c_conf = 0) AS basis_given, (e_id IS NULL OR len(list_filter(c_ids, lambda x: contains(x, e_id))) > 0) AS identifier_ok,
  {got_rank} - {exp_rank} AS gap FROM gold JOIN {decided} ON gold.gid = {decided}.id)"""


_H = "((o_orderkey * 31 + run * 17) % 10)"
RUNS = f"""{ORD}, rr AS (SELECT *, unnest(range({D.RUNS})) AS run FROM ord),
rd0 AS (SELECT 'O-' || o_orderkey AS tk, run, seg, {_H} AS h, ({lst(L.CATEGORIES)})[(o_orderkey + CAST({_H} < 2 AS INTEGER)) % 8 + 1] AS cat,
  ({lst(L.URGENCIES)})[(o_orderkey + CAST({_H} BETWEEN 3 AND 4 AS INTEGER)) % 4 + 1] AS urg, (o_orderkey + CAST({_H} = 5 AS INTEGER)) % 3 = 0 AS esc,
  CAST(50 + (o_orderkey * 7 + run * 13) % 45 AS DOUBLE) / 100 AS conf, CASE WHEN {_H} <> 7 THEN seg END AS name,
  ({lst(L.REASONS)})[o_orderkey % 5 + 1] AS reason, CASE WHEN {_H} <> 9 THEN ({lst(D.MODELS)})[(o_orderkey + run) % 4 + 1] END AS model,
  1000 + (o_orderkey * 13 + run * 7) % 5000 AS latency_ms FROM rr),
rd AS (SELECT *, {route_sql('cat', 'urg', 'esc', 'conf')} AS queue, {esc_queue_sql('esc')} AS eq, CASE WHEN h = 9 THEN 'llm_fallback_rules' ELSE 'llm' END AS mode FROM rd0)"""
RUNS_OF_SIX = RUNS.replace(f"range({D.RUNS})", "range(6)")
