"""Every query, each with the SQL that must give the same rows where SQL can."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions import keywords as K
from triagegrid.functions import labels, ordinal, pricing, text
from triagegrid.functions.guardrails import MATCHES, ACTIVE, add_guardrail_matches, suppress_spam
from triagegrid.operators import cascade, costs, dashboard, evidence, ledger, routing, scoring, stability
from triagegrid.operators.classify import classify_with
from triagegrid.operators.decide import decide, decide_runs, resolve_answers, validate_answers
from triagegrid.plans import derived as D
from triagegrid.plans import oracle as O
from triagegrid.session import scratch_path
from triagegrid.sources import decisions as S
from triagegrid.sources import labelled, tickets
from triagegrid.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


def join(values: Column, sep: str = "|") -> Column:
    return F.array_join(values, sep)


def hits_text(hits: Column) -> Column:
    return join(F.transform(hits, lambda h: F.concat_ws("~", h["rule"], h["reason"], h["matched"], h["effect"])))


def rules(spark: SparkSession, sf: str) -> DataFrame:
    return decide(D.order_tickets(spark, sf))


def read_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return decide(D.eval_tickets(spark, sf), D.answers(spark, sf, gap=True))


def read_by_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return decide(D.eval_tickets(spark, sf).drop("ticket_key"))


def scores(spark: SparkSession, sf: str, model: bool = True) -> DataFrame:
    return scoring.score(D.gold(spark, sf), (read_by_model if model else read_by_keywords)(spark, sf))


def folded_documents(spark: SparkSession, sf: str) -> DataFrame:
    return text.add_folded(D.document_tickets(spark, sf))


# --- scans, sources, sinks -------------------------------------------------------------------

_TURN = "conv_id || '-' || turn"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")


@query(f"""SELECT CAST(NULL AS VARCHAR) AS external_id, 'chat' AS source, {O.strip('text')} AS text FROM conversations
UNION ALL SELECT {_TURN}, 'chat', text FROM conversations""")
def read_tickets_json(spark, sf):
    quoted = F.to_json(F.array("text"))
    item = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    array = F.concat(F.lit("["), item, F.lit(","), F.to_json(F.struct("text", "id")), F.lit(',7,{"note":"x"}]'))
    rows = tickets.tickets_from_json_array(_turns(spark, sf).select(array.alias("body")), "body", F.lit("chat"))
    return rows.select("external_id", "source", "text")


@query(f"SELECT {_TURN} AS external_id, text, true AS from_upload FROM conversations")
def read_tickets_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    _turns(spark, sf).write.json(path)
    rows = tickets.read_tickets_jsonl(spark, path)
    return rows.select("external_id", "text", F.startswith("source", F.lit("upload:")).alias("from_upload"))


@query(f"SELECT {_TURN} AS external_id, text FROM conversations")
def read_tickets_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writer = _turns(spark, sf).write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tickets.read_tickets_csv(spark, path).select("external_id", "text")


_BLOCKS = f"""SELECT {O.strip('b')} AS text FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS b FROM conversations)
WHERE {O.strip('b')} <> ''"""


@query(f"SELECT {_TURN} AS external_id, text, role AS source FROM conversations WHERE role = 'user' UNION ALL SELECT NULL, text, 'upload' FROM conversations WHERE role <> 'user'")
def read_tickets_csv_headers(spark, sf):
    """Files with different headers and orders of columns in one folder."""
    path = scratch_path(spark, "csv-headers")
    rows = D.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.col("role").alias("source"))

    def write(part: DataFrame, mode: str) -> None:
        writer = part.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

    user = F.col("source") == "user"
    write(rows.where(user).select("source", "id", "text"), "overwrite")
    write(rows.where(~user).select("text"), "append")
    got = tickets.read_tickets_csv(spark, path)
    return got.select("external_id", "text", F.when(F.startswith("source", F.lit("upload:")), F.lit("upload")).otherwise(F.col("source")).alias("source"))


def _array_files(rows: DataFrame, by: Column, path: str) -> None:
    """One JSON array of the rows of each group in a file of its own."""
    arrays = rows.groupBy(by).agg(F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",").alias("items"))
    arrays.select(F.concat(F.lit("["), F.col("items"), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@query(f"SELECT {_TURN} AS external_id, text, true AS from_upload FROM conversations")
def read_tickets_json_files(spark, sf):
    path = scratch_path(spark, "json-files")
    _array_files(_turns(spark, sf), F.substring_index("id", "-", 1), path)
    rows = tickets.read_tickets_json(spark, path)
    return rows.select("external_id", "text", F.startswith("source", F.lit("upload:")).alias("from_upload"))


@query(f"SELECT {_TURN} AS external_id, text, 'shop' AS source FROM conversations")
def read_fixture_tickets(spark, sf):
    path = scratch_path(spark, "fixture")
    _array_files(_turns(spark, sf), F.substring_index("id", "-", 1), path)
    return labelled.read_fixture_tickets(spark, path, "shop").select("external_id", "text", "source")


@query("""SELECT 'model-' || s_name AS model, CASE WHEN s_suppkey % 3 <> 0 THEN (['minimal', 'low', 'medium'])[s_suppkey % 3 + 1] END AS effort, s_suppkey % 3 AS missed, s_suppkey % 5 AS false_calls,
30 + s_suppkey % 40 AS n FROM supplier""")
def bakeoff_results(spark, sf):
    path = scratch_path(spark, "bakeoff")
    _array_files(D.run_results(spark, sf), F.substring("model", -2, 2), path)
    rows = labelled.bakeoff_results(spark, path)
    x = F.col("summary")
    return rows.select("model", "effort", F.size(x["missed_escalations"]).cast("bigint").alias("missed"), F.size(x["false_escalations"]).cast("bigint").alias("false_calls"), F.col("n").cast("bigint").alias("n"))


@query(_BLOCKS)
def read_tickets_text(spark, sf):
    path = scratch_path(spark, "text")
    _turns(spark, sf).select("text").write.option("lineSep", "\n\n").text(path)
    return tickets.read_tickets_text(spark, path).select("text")


@query(f"SELECT 'csv' AS kind, {_TURN} AS external_id, text FROM conversations UNION ALL SELECT 'text', NULL, text FROM ({_BLOCKS})")
def read_tickets(spark, sf):
    path = scratch_path(spark, "mixed")
    rows = _turns(spark, sf)
    rows.select("text").write.option("lineSep", "\n\n").text(path)
    writer = rows.write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = tickets.read_tickets(spark, path)
    kind = F.when(F.endswith("source", F.lit(".csv")), F.lit("csv")).otherwise(F.lit("text"))
    return got.select(kind.alias("kind"), "external_id", "text")


_NORMAL = """SELECT CASE WHEN lang = 'en' THEN 'api' ELSE source END AS source, CAST(doc_id AS VARCHAR) AS external_id,
length(text) AS chars, md5(text) AS body{} FROM documents WHERE {}"""


def _raw_documents(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return d.select("text", F.when(F.col("lang") != "en", F.col("source")).alias("source"), F.lit("").alias("external_id"), F.col("doc_id").alias("id"))


@query(_NORMAL.format("", "length(text) BETWEEN 1 AND 20000"))
def normalise_tickets(spark, sf):
    ok, _ = tickets.normalise_tickets(_raw_documents(spark, sf))
    return ok.select("source", "external_id", F.char_length("text").alias("chars"), F.md5("text").alias("body"))


@query(_NORMAL.format(", 'text is longer than 20000 characters' AS problem", "length(text) > 20000"))
def quarantine_tickets(spark, sf):
    _, bad = tickets.normalise_tickets(_raw_documents(spark, sf))
    return bad.select("source", "external_id", F.char_length("text").alias("chars"), F.md5("text").alias("body"), "problem")


@query(f"""WITH {O.ORD}, {O.GOLD} SELECT gid AS id, grp AS "group", e_cat AS category, e_urg AS urgency, e_esc AS escalate, e_name AS customer_name,
e_reason AS reasons, e_id AS identifier_contains, hi AS ceiling, array_to_string(amb, '|') AS ambiguous FROM gold""")
def read_labelled(spark, sf):
    path = scratch_path(spark, "labelled")
    D.gold(spark, sf).write.json(path)
    e = F.col("expected")
    return labelled.read_labelled(spark, path).select(
        "id", "group", e["category"].alias("category"), e["urgency"].alias("urgency"), e["escalate"].alias("escalate"),
        e["customer_name"].alias("customer_name"), join(e["reasons"]).alias("reasons"), e["identifier_contains"].alias("identifier_contains"),
        F.get(e["customer_confidence"], F.lit(1)).alias("ceiling"), join(F.col("ambiguous")).alias("ambiguous"),
    )


@query(O.RULES_ORDERS + " SELECT id, cat AS category, urg AS urgency, esc AS escalate, queue, len(hits) AS hits, uwhy AS urgency_reason, who AS customer FROM d")
def decision_json_round_trip(spark, sf):
    d = rules(spark, sf)
    back = d.select(S.decision_from_json(S.decision_to_json(F.struct(*d.columns))).alias("d")).select("d.*")
    x = F.col("extraction")
    return back.select(
        "id", x["category"].alias("category"), x["urgency"].alias("urgency"), x["escalate"].alias("escalate"), "queue",
        F.size("rule_hits").cast("bigint").alias("hits"), x["urgency_reason"].alias("urgency_reason"), x["customer"]["name"].alias("customer"),
    )


@query(O.MODEL + """ SELECT 'recorded:shop' AS source, id AS external_id, '2026-02-03T04:05:06.000+00:00' AS created_at, cost_usd FROM dm""")
def replay_decisions(spark, sf):
    now = F.lit("2026-02-03 04:05:06").cast("timestamp")
    old = read_by_model(spark, sf)
    old = old.withColumn("usage", F.when(F.col("mode") == "llm", F.col("usage").withField("cost_usd", F.lit(None).cast("double"))))
    again = ledger.replay_decisions(old, "shop", now)
    rows = ledger.flatten_decision(again.withColumn("usd", F.col("usage.cost_usd")), "usd")
    after, _ = ledger.record(rows, rows)
    return after.select("source", "external_id", labels.utc_iso_millis(F.col("created_at")).alias("created_at"), F.col("usd").alias("cost_usd"))


_FIRST = """ SELECT {} FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id, CASE WHEN external_id IS NULL THEN id END
ORDER BY created_at, id) AS rn FROM {}) WHERE rn = 1"""


@query(O.RULES_ORDERS + _FIRST.format("id, source, external_id, strftime(created_at, '%Y-%m-01') AS created_date, cat AS category, urg AS urgency, CAST(esc AS INTEGER) AS escalate, queue, escalation_queue, md5(text) AS body", "d"))
def write_decisions(spark, sf):
    path = scratch_path(spark, "ledger")
    S.write_decisions(rules(spark, sf), path, period="month")
    return S.read_ledger(spark, path).select(
        "id", "source", "external_id", F.col("created_date").cast("string").alias("created_date"), "category", "urgency", "escalate", "queue",
        "escalation_queue", F.md5("ticket_text").alias("body"),
    )


@query(O.RULES_ORDERS + """ SELECT 'routing_decision' AS event, id, 'rules' AS mode, cat AS category, urg AS urgency, CAST(esc AS VARCHAR) AS escalate, to_json(rs)::VARCHAR AS reasons, queue, escalation_queue,
to_json([split_part(h, '~', 1) FOR h IN hits])::VARCHAR AS rule_hits, to_json(ovr)::VARCHAR AS overrides, '0' AS latency_ms, NULL::VARCHAR AS usage FROM d""")
def decision_events(spark, sf):
    e = S.decision_events(rules(spark, sf))
    names = ["event", "id", "mode", "category", "urgency", "escalate", "reasons", "queue", "escalation_queue", "rule_hits", "overrides", "latency_ms", "usage"]
    return e.select(F.json_tuple("value", *names).alias(*names))


_DISCARDS = O.RULES_ORDERS + """, w AS (SELECT *, first_value(id) OVER (PARTITION BY source, external_id, CASE WHEN external_id IS NULL THEN id END ORDER BY created_at, id) AS kept FROM d)
SELECT CASE WHEN kept = id THEN 'routing_decision' ELSE 'routing_decision_deduplicated' END AS event, CASE WHEN kept = id THEN id END AS id, CASE WHEN kept <> id THEN id END AS discarded_id,
CASE WHEN kept <> id THEN kept END AS kept_id, CASE WHEN kept <> id THEN source END AS source, CASE WHEN kept <> id THEN external_id END AS external_id FROM w"""


@query(_DISCARDS)
def discard_events(spark, sf):
    d = rules(spark, sf)
    sent = d.select("id", "created_at", "ticket.source", "ticket.external_id")
    e = S.decision_events(d, ledger.authoritative(sent, sent.limit(0)))
    names = ["event", "id", "discarded_id", "kept_id", "source", "external_id"]
    return e.select(F.json_tuple("value", *names).alias(*names))


@query(_DISCARDS)
def write_decision_events(spark, sf):
    """The same batch of events, discards included, written twice and read once."""
    d, path = S.decided_for_events(rules(spark, sf), scratch_path(spark, "decided")), scratch_path(spark, "events")
    sent = d.select("id", "created_at", "ticket.source", "ticket.external_id")
    for _ in range(2):
        S.write_decision_events(d, path, batch="1", settled=ledger.authoritative(sent, sent.limit(0)))
    names = ["event", "id", "discarded_id", "kept_id", "source", "external_id"]
    return S.read_decision_events(spark, path).select(F.json_tuple("value", *names).alias(*names))


@query(O.MODEL + """ SELECT id, mode, cat AS category, urg AS urgency, cost_usd FROM dm""")
def hydrate(spark, sf):
    """Decisions written without their cost and read back from ledger rows."""
    d = read_by_model(spark, sf)
    d = d.withColumn("usage", F.when(F.col("mode") == "llm", F.col("usage").withField("cost_usd", F.lit(None).cast("double"))))
    x = F.col("extraction")
    return S.hydrate(ledger.flatten_decision(d)).select("id", "mode", x["category"].alias("category"), x["urgency"].alias("urgency"), F.col("usage.cost_usd").alias("cost_usd"))


# --- projections, filters, predicates --------------------------------------------------------

_L = "WITH " + O.LEDGER


@query(_L + f" SELECT id, queue, escalation_queue FROM ledger WHERE queue = {O.q(L.ESCALATION_QUEUE)} OR escalation_queue = {O.q(L.ESCALATION_QUEUE)}")
def decisions_in_queue(spark, sf):
    return ledger.decisions_in_queue(D.event_ledger(spark, sf), L.ESCALATION_QUEUE).select("id", "queue", "escalation_queue")


@query(_L + " SELECT id, source, category FROM ledger WHERE id = 'E-000000000042'")
def decision_by_id(spark, sf):
    return ledger.decision_by_id(D.event_ledger(spark, sf), "E-000000000042").select("id", "source", "category")


@query(_L + " SELECT id, source FROM ledger WHERE id <> 'E-000000000042'")
def without_decision(spark, sf):
    return ledger.without_decision(D.event_ledger(spark, sf), "E-000000000042").select("id", "source")


@query(_L + " SELECT id, source FROM ledger WHERE source IS NOT DISTINCT FROM 'click'")
def keep_source(spark, sf):
    return ledger.keep_source(D.event_ledger(spark, sf), "click").select("id", "source")


def _stored_events(spark, sf) -> str:
    """The event ledger as a stored one."""
    rows, path = D.event_ledger(spark, sf), scratch_path(spark, "stored")
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.LEDGER if f.name != S.LEDGER_PARTITION]
    dated = rows.select(*columns, F.to_date(F.date_trunc("month", "created_at")).alias(S.LEDGER_PARTITION))
    S.store_rows(dated.hint("rebalance", S.LEDGER_PARTITION), path, "overwrite")
    return path


@query(_L + " SELECT id, source FROM ledger WHERE id <> 'E-000000000042'")
def remove_decision(spark, sf):
    path = _stored_events(spark, sf)
    S.remove_decision(spark, path, "E-000000000042")
    return S.read_ledger(spark, path).select("id", "source")


@query(_L + " SELECT id, source FROM ledger WHERE source IS NOT DISTINCT FROM 'click'")
def clear_ledger(spark, sf):
    path = _stored_events(spark, sf)
    S.clear_ledger(spark, path, "click")
    return S.read_ledger(spark, path).select("id", "source")


@query(_L + f" SELECT id, source, queue FROM ledger WHERE queue = {O.q(L.ESCALATION_QUEUE)} OR escalation_queue = {O.q(L.ESCALATION_QUEUE)} ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_decisions(spark, sf):
    """The newest rows of one queue in a stored ledger, from the dates that hold them."""
    return S.recent_decisions(spark, _stored_events(spark, sf), 100, L.ESCALATION_QUEUE).select("id", "source", "queue")


@query(O.RULES_ORDERS + """ SELECT id, strftime(created_at, '%Y-%m-%d') AS created_on, source, external_id, text AS ticket_text, 'rules' AS mode, cat AS category, urg AS urgency,
CAST(esc AS INTEGER) AS escalate, queue, escalation_queue, 0 AS latency_ms, summary AS json_summary FROM d""")
def flatten_decision(spark, sf):
    f = ledger.flatten_decision(rules(spark, sf))
    return f.select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "source", "external_id", "ticket_text", "mode", "category", "urgency",
        "escalate", "queue", "escalation_queue", "latency_ms", F.get_json_object("decision_json", "$.extraction.summary").alias("json_summary"),
    )


_A = f"WITH {O.ORD}, {O.ANSWERS}"


@query(_A + f""" SELECT akey AS id, CASE WHEN a_failed THEN false ELSE a_esc OR a_urg IN ('high', 'critical') OR a_conf < 0.5 END AS reread,
CASE WHEN a_failed THEN {O.q(L.WHY_DRAFT_STANDS)} WHEN a_esc THEN {O.q(L.WHY_DRAFT_ESCALATED)} WHEN a_urg IN ('high', 'critical') THEN replace({O.q(L.WHY_DRAFT_URGENT)}, '{{}}', a_urg)
WHEN a_conf < 0.5 THEN replace({O.q(L.WHY_DRAFT_UNSURE)}, '{{}}', format('{{:.2f}}', a_conf)) ELSE {O.q(L.WHY_DRAFT_STANDS)} END AS why FROM ans""")
def needs_second_read(spark, sf):
    x = F.col("extraction")
    v = cascade.needs_second_read(x["escalate"], x["urgency"], x["category_confidence"])
    return D.answers(spark, sf).select(F.col("ticket_key").alias("id"), v.alias("v")).select("id", "v.*")


_TRIAGE = f"""SELECT id, len(hits) > 0 OR urg IN ('high', 'critical') AS expensive, CASE WHEN len(hits) > 0 THEN replace({O.q(L.WHY_RULE_MATCHED)}, '{{}}',
array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: string_split(h, '.')[1]))), ', ')) WHEN urg IN ('high', 'critical')
THEN replace({O.q(L.WHY_KEYWORD_URGENCY)}, '{{}}', urg) ELSE {O.q(L.WHY_CHEAP)} END AS why FROM d"""


@query(O.RULES_DOCUMENTS + " " + _TRIAGE)
def triage_by_rules(spark, sf):
    return cascade.triage_by_rules(D.document_tickets(spark, sf)).select("id", "expensive", "why")


@query(_L + " SELECT id, urgency, category FROM ledger WHERE urgency = 'critical' AND category = 'spam' AND escalate = 1")
def dashboard_filter(spark, sf):
    return dashboard.dashboard_filter(D.event_ledger(spark, sf), "critical", "spam", True).select("id", "urgency", "category")


def _py_list(x: str) -> str:
    quoted = f"list_transform({x}, lambda v: CASE WHEN contains(v, '''') THEN '\"' || v || '\"' ELSE '''' || replace(v, chr(10), '\\n') || '''' END)"
    return f"CASE WHEN len({x}) > 0 THEN '[' || array_to_string({quoted}, ', ') || ']' ELSE '-' END"


@query(O.RULES_ORDERS + f""" SELECT id, concat_ws(chr(10), 'Ticket ' || id || '  (' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00, mode=rules, model=-)', '',
'  Customer:   ' || CASE WHEN who IS NOT NULL THEN who WHEN guess IS NOT NULL THEN guess || ' (inferred, confidence ' || format('{{:.2f}}', who_conf) || ')' ELSE 'unknown' END,
'              ids=' || {_py_list('ids')} || CASE WHEN len(basis) > 0 THEN '  basis=' || {_py_list('basis')} ELSE '' END,
'              why: ' || who_why, '  Category:   ' || replace(cat, '_', ' ') || ' (confidence ' || format('{{:.2f}}', conf) || ')', '              why: ' || cat_why,
'  Urgency:    ' || urg || '  signals=' || {_py_list('usig')}, '              why: ' || uwhy,
'  Escalate:   ' || CASE WHEN esc THEN 'True' ELSE 'False' END || '  reasons=' || {_py_list('rs')}, '              why: ' || {O.q(L.ESCALATION_REASON_TEXT)},
'  Routed to:  ' || queue || coalesce('  + ' || escalation_queue, ''), '', 'Overall rationale:', '  ' || rationale, '', 'Guardrail rules that fired:',
CASE WHEN len(hits) = 0 THEN '  (none)' ELSE array_to_string(list_transform(hits, lambda h: '  - ' || string_split(h, '~')[1] || ': matched ''' || string_split(h, '~')[-2] || ''' -> ' || string_split(h, '~')[-1]), chr(10)) END,
CASE WHEN len(ovr) > 0 THEN chr(10) || 'Overrides applied to the model''s answer:' || chr(10) || array_to_string(list_transform(ovr, lambda o: '  - ' || o), chr(10)) END) AS explanation FROM d""")
def explain_text(spark, sf):
    d = rules(spark, sf)
    return d.select("id", labels.explain_text(F.struct(*d.columns)).alias("explanation"))


@query(O.RULES_ORDERS + " SELECT id, coalesce(who, '(not stated) ' || guess, '(not stated)') AS who, concat_ws(' + ', queue, escalation_queue) AS route FROM d")
def who_and_route_labels(spark, sf):
    d = rules(spark, sf)
    return d.select(
        "id", labels.who_label(F.col("extraction.customer")).alias("who"), labels.route_label(F.col("queue"), F.col("escalation_queue")).alias("route")
    )


@query(_A + " SELECT akey AS id, a_problem IS NULL AS usable, a_problem AS problem FROM ans")
def check_answers(spark, sf):
    v = validate_answers(D.answers(spark, sf))
    return v.select(F.col("ticket_key").alias("id"), F.col("problem").isNull().alias("usable"), "problem")


# --- joins -----------------------------------------------------------------------------------


@query(_L + " SELECT id, category, urgency, queue, escalation_queue FROM ledger")
def route(spark, sf):
    n = F.col("event_id")
    e = D.table(spark, sf, "events").select(
        F.concat(F.lit("E-"), F.lpad(n.cast("string"), 12, "0")).alias("id"), D.pick(L.CATEGORIES, n % 8).alias("category"),
        D.pick(L.URGENCIES, F.floor(n / 8) % 4).alias("urgency"), (n % 5 == 0).alias("escalate"), ((n % 10) / F.lit(10.0)).alias("category_confidence"),
    )
    return routing.route(e).select("id", "category", "urgency", "queue", "escalation_queue")


@query("""WITH card AS (SELECT p_brand AS prefix, min(p_retailprice) / 1000 AS rate_in, min(p_retailprice) / 10000 AS rate_cached, max(p_size) * 1.0::DOUBLE AS rate_out FROM part GROUP BY p_brand),
m AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'unlisted' ELSE p_brand || '-' || p_type END AS model FROM part),
hit AS (SELECT p_partkey, model, prefix, rate_in, rate_out, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS rn FROM m JOIN card ON starts_with(model, prefix))
SELECT m.p_partkey AS id, m.model, coalesce(hit.prefix, d.prefix) AS prefix, round(coalesce(hit.rate_in, d.rate_in), 6) AS rate_in, round(coalesce(hit.rate_out, d.rate_out), 6) AS rate_out
FROM m LEFT JOIN hit ON hit.p_partkey = m.p_partkey AND rn = 1 CROSS JOIN (SELECT * FROM card WHERE prefix = 'Brand#1') d""")
def price_match(spark, sf):
    part = D.table(spark, sf, "part")
    card = part.groupBy(F.col("p_brand").alias("prefix")).agg(
        (F.min("p_retailprice") / 1000).alias("rate_in"), (F.min("p_retailprice") / 10000).alias("rate_cached"), F.max("p_size").cast("double").alias("rate_out")
    )
    model = F.when(F.col("p_type") == "PROMO", F.lit("unlisted")).otherwise(F.concat_ws("-", "p_brand", "p_type"))
    priced = costs.price_match(part.select(F.col("p_partkey").alias("id"), model.alias("model")), card, default="Brand#1")
    return priced.select("id", "model", "prefix", r(F.col("rate_in")).alias("rate_in"), r(F.col("rate_out")).alias("rate_out"))


@query(O.MODEL + """ SELECT id, mode, model, error, cat AS category, urg AS urgency, esc AS escalate, array_to_string(rs, '|') AS reasons, uwhy AS urgency_reason, array_to_string(usig, '|') AS signals,
array_to_string(hits, '|') AS hits, array_to_string(ovr, '|') AS overrides, queue, escalation_queue, c_name AS customer, cost_usd, latency_ms FROM dm""")
def resolve_and_decide(spark, sf):
    x = F.col("extraction")
    return read_by_model(spark, sf).select(
        "id", "mode", "model", "error", x["category"].alias("category"), x["urgency"].alias("urgency"), x["escalate"].alias("escalate"),
        join(x["escalation_reasons"]).alias("reasons"), x["urgency_reason"].alias("urgency_reason"), join(x["urgency_signals"]).alias("signals"),
        hits_text(F.col("rule_hits")).alias("hits"), join(F.col("overrides")).alias("overrides"), "queue", "escalation_queue",
        x["customer"]["name"].alias("customer"), F.col("usage.cost_usd").alias("cost_usd"), "latency_ms",
    )


@query(f"WITH {O.ORDER_TICKETS}, {O.ANSWERS_WITH_GAP} SELECT id, CASE WHEN akey IS NOT NULL AND a_problem IS NULL THEN 'llm' ELSE 'llm_fallback_rules' END AS mode, CASE WHEN akey IS NULL THEN 'ValueError: no answer for this ticket' ELSE a_problem END AS error FROM tickets LEFT JOIN ans ON akey = id")
def resolve_answers_join(spark, sf):
    return resolve_answers(D.eval_tickets(spark, sf), D.answers(spark, sf, gap=True)).select("id", "mode", "error")


_GJ = f"WITH {O.ORDER_TICKETS}, {O.GOLD}, {O.ANSWERS_WITH_GAP}"


@query(f"WITH {O.rules_ctes(O.ORDER_TICKETS)}, {O.GOLD} SELECT gid AS id, e_cat AS expected_category, cat AS got_category FROM gold JOIN d ON gid = d.id")
def join_gold(spark, sf):
    pairs = scoring.join_gold(D.gold(spark, sf), read_by_keywords(spark, sf))
    return pairs.select("id", F.col("expected.category").alias("expected_category"), F.col("decision.extraction.category").alias("got_category"))


@query("SELECT 'O-' || o_orderkey AS id FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def coverage_gaps(spark, sf):
    covered = D.answers(spark, sf, gap=True).select(F.struct(F.col("ticket_key").alias("external_id")).alias("ticket"))
    return scoring.coverage_gaps(D.gold(spark, sf), covered)


def _two_runs(spark, sf):
    """Scores of the same tickets by keywords (a) and by the model (b), from one reading."""
    runs = decide_runs(D.eval_tickets(spark, sf), {"a": None, "b": D.answers(spark, sf, gap=True)})
    return scoring.score(D.gold(spark, sf), runs, also=["run"])


_TWO = (
    O.MODEL
    + f", {O.GOLD}, kd AS (SELECT * FROM (WITH {O.fold_ctes('kw', 'k_cat', 'k_conf', 'k_urg', 'false', '[]::VARCHAR[]', 'urg_why', 'k_sig')} "
    + "SELECT *, 'rules' AS mode, who AS c_name, guess AS c_guess, who_conf AS c_conf, basis AS c_basis, ids AS c_ids FROM d)), "
    + O.scores_cte("dm", "sb")
    + ", "
    + O.scores_cte("kd", "sa")
)
_LABEL = "{0}cat || '/' || {0}urg || '/' || CASE WHEN {0}esc THEN 'ESC' ELSE '-' END"


@query(_TWO + f" SELECT sa.gid AS id, {_LABEL.format('sa.')} AS a, {_LABEL.format('sb.')} AS b, sa.e_cat || '/' || sa.e_urg || '/' || CASE WHEN sa.e_esc THEN 'ESC' ELSE '-' END AS expected FROM sa JOIN sb ON sa.gid = sb.gid WHERE {_LABEL.format('sa.')} <> {_LABEL.format('sb.')}")
def compare_runs(spark, sf):
    return scoring.compare_runs_answers(_two_runs(spark, sf), "a", "b")


@query(O.RULES_ORDERS + f""", c AS (SELECT queue AS name, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT escalation_queue, count(*) FROM d WHERE escalation_queue IS NOT NULL GROUP BY 1)
SELECT a.name, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM (SELECT unnest({O.lst(routing.STANDARD.queue_names())}) AS name) a LEFT JOIN c ON a.name = c.name GROUP BY 1""")
def queue_depths(spark, sf):
    return routing.queue_depths(rules(spark, sf))


_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
_SUBMIT = f"""{_L}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id, CASE WHEN external_id IS NULL THEN id END ORDER BY created_at, id) AS rn
FROM ledger WHERE created_at < {_SPLIT}) WHERE rn = 1), fresh AS (SELECT *, row_number() OVER (PARTITION BY source, external_id, CASE WHEN external_id IS NULL THEN id END ORDER BY created_at, id) AS rn
FROM ledger WHERE created_at >= {_SPLIT})"""


def _before_and_new(spark, sf):
    rows = D.event_ledger(spark, sf)
    split = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return ledger.dedupe_earliest(rows.where(F.col("created_at") < split)), rows.where(F.col("created_at") >= split)


@query(_SUBMIT + """ SELECT id, source, external_id FROM old UNION ALL SELECT id, source, external_id FROM fresh f WHERE rn = 1 AND (external_id IS NULL OR NOT EXISTS
(SELECT 1 FROM old WHERE old.source = f.source AND old.external_id = f.external_id))""")
def record_ledger(spark, sf):
    before, new = _before_and_new(spark, sf)
    after, _ = ledger.record(new, before)
    return after.select("id", "source", "external_id")


@query(_SUBMIT + """ SELECT f.source, f.external_id, f.id AS submitted_id, CASE WHEN f.external_id IS NULL THEN f.id ELSE coalesce(old.id, w.id) END AS id,
CASE WHEN f.external_id IS NULL THEN false ELSE coalesce(old.id, w.id) <> f.id END AS discarded FROM fresh f LEFT JOIN old ON old.source = f.source AND old.external_id = f.external_id
LEFT JOIN fresh w ON w.rn = 1 AND w.source = f.source AND w.external_id = f.external_id""")
def record_authoritative(spark, sf):
    before, new = _before_and_new(spark, sf)
    return ledger.record(new, before)[1]


@query(_SUBMIT + """ SELECT id, source, external_id FROM fresh f WHERE external_id IS NULL OR NOT EXISTS (SELECT 1 FROM old WHERE old.source = f.source AND old.external_id = f.external_id)""")
def new_tickets(spark, sf):
    before, new = _before_and_new(spark, sf)
    return ledger.new_tickets(new, before).select("id", "source", "external_id")


@query(f"WITH {O.ORD}, {O.GOLD} SELECT gid AS id, grp AS \"group\" FROM gold WHERE e_esc")
def must_escalate(spark, sf):
    return scoring.must_escalate(D.gold(spark, sf)).select("id", "group")


@query(f"WITH {O.ORD}, {O.GOLD} SELECT gid AS id, grp AS \"group\" FROM gold WHERE starts_with(grp, '1-') OR grp IN ('5-LOW', '3-MEDIUM')")
def only_ids(spark, sf):
    g = D.gold(spark, sf).select("id", "group")
    return scoring.only_ids(g, prefix="1-", column="group").unionByName(scoring.only_ids(g, ["5-LOW", "3-MEDIUM"], column="group"))


# --- aggregations ----------------------------------------------------------------------------


@query(_L + " SELECT name, count(*) AS count FROM (SELECT queue AS name FROM ledger UNION ALL SELECT escalation_queue FROM ledger WHERE escalation_queue IS NOT NULL) GROUP BY name")
def queue_counts(spark, sf):
    return routing.queue_counts(D.event_ledger(spark, sf))


@query(_L + " SELECT count(*) AS total FROM ledger")
def total(spark, sf):
    return ledger.total(D.event_ledger(spark, sf))


_SCORED = O.MODEL + f", {O.GOLD}, {O.scores_cte()}"


@query(_SCORED + """ SELECT gid AS id, grp AS "group", e_esc AS must_escalate, esc AS escalated, escalation_ok, missed AS missed_escalation, false_esc AS false_escalation, reasons_ok, category_ok,
urgency_exact, urgency_ok, customer_ok, banded AS confidence_scored, ceiling_ok AS confidence_ceiling_ok, floor_ok AS confidence_floor_ok, c_conf AS confidence_got, c_guess AS guess, basis_given,
identifier_ok, array_to_string(list_sort(amb), '|') AS ambiguous, queue, cat AS got_category, urg AS got_urgency, c_name AS got_customer, e_cat AS expected_category, lo AS band_low, hi AS band_high, esc AS got_escalate, array_to_string(rs, '|') AS got_reasons,
e_urg AS expected_urgency, e_esc AS expected_escalate, e_name AS expected_name, e_id AS expected_identifier FROM sc""")
def score(spark, sf):
    return scores(spark, sf).select(
        "id", "group", "must_escalate", "escalated", "escalation_ok", "missed_escalation", "false_escalation", "reasons_ok", "category_ok", "urgency_exact",
        "urgency_ok", "customer_ok", "confidence_scored", "confidence_ceiling_ok", "confidence_floor_ok", "confidence_got", "guess", "basis_given",
        "identifier_ok", join(F.col("ambiguous")).alias("ambiguous"), "queue", F.col("got.category").alias("got_category"),
        F.col("got.urgency").alias("got_urgency"), F.col("got.customer").alias("got_customer"), F.col("expected.category").alias("expected_category"),
        F.get("confidence_band", F.lit(0)).alias("band_low"), F.get("confidence_band", F.lit(1)).alias("band_high"), F.col("got.escalate").alias("got_escalate"),
        join(F.col("got.reasons")).alias("got_reasons"), F.col("expected.urgency").alias("expected_urgency"), F.col("expected.escalate").alias("expected_escalate"),
        F.col("expected.customer_name").alias("expected_name"), F.col("expected.identifier_contains").alias("expected_identifier"),
    )


_DIR = """count(*) FILTER (WHERE gap < 0) AS urgency_under, count(*) FILTER (WHERE gap > 0) AS urgency_over, round(count(*) FILTER (WHERE gap < 0) / count(*), 6) AS urgency_under_rate, round(count(*) FILTER (WHERE gap > 0) / count(*), 6) AS urgency_over_rate,
count(*) FILTER (WHERE gap < 0 AND NOT list_contains(amb, 'urgency')) AS urgency_hard_under, count(*) FILTER (WHERE e_urg = 'critical' AND urg <> 'critical') = 0 AS urgency_never_under_critical"""
_CAL = """count(*) FILTER (WHERE banded) AS confidence_banded, round(count(*) FILTER (WHERE banded AND floor_ok AND ceiling_ok) / greatest(1, count(*) FILTER (WHERE banded)), 6) AS confidence_calibration,
count(*) FILTER (WHERE banded AND NOT ceiling_ok) AS overconfidence, count(*) FILTER (WHERE banded AND NOT (floor_ok AND ceiling_ok)) AS confidence_misses"""
_CARD = f"""count(*) AS n, count(*) FILTER (WHERE e_esc) AS must_n, round(coalesce(count(*) FILTER (WHERE e_esc AND esc) / nullif(count(*) FILTER (WHERE e_esc), 0), 1.0), 6) AS escalation_recall, count(*) FILTER (WHERE missed) AS missed_escalations,
count(*) FILTER (WHERE false_esc) AS false_escalations, round(coalesce(count(*) FILTER (WHERE e_esc AND reasons_ok) / nullif(count(*) FILTER (WHERE e_esc), 0), 1.0), 6) AS reasons_accuracy, round(count(*) FILTER (WHERE category_ok) / count(*), 6) AS category_accuracy,
round(count(*) FILTER (WHERE cat = e_cat) / count(*), 6) AS category_strict, round(count(*) FILTER (WHERE urgency_exact) / count(*), 6) AS urgency_exact, round(count(*) FILTER (WHERE urgency_ok) / count(*), 6) AS urgency_accuracy,
round(count(*) FILTER (WHERE customer_ok) / count(*), 6) AS customer_accuracy, round(count(*) FILTER (WHERE identifier_ok) / count(*), 6) AS identifier_accuracy, {_CAL}, bool_and(basis_given) AS basis_always_given, {_DIR}"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[r(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query(_SCORED + f" SELECT {_CARD} FROM sc")
def scorecard(spark, sf):
    return rounded(scoring.scorecard(scores(spark, sf)))


@query(_SCORED + f' SELECT grp AS "group", {_DIR} FROM sc GROUP BY grp')
def urgency_direction(spark, sf):
    return rounded(scoring.urgency_direction(scores(spark, sf), ["group"]))


@query(_SCORED + f' SELECT grp AS "group", {_CAL} FROM sc GROUP BY grp')
def calibration(spark, sf):
    return rounded(scoring.calibration(scores(spark, sf), ["group"]))


_SAID = "gid || ' said ' || urg || ', gold ' || e_urg"


@query(_SCORED + f""" SELECT gid AS id, 'missed_escalations' AS kind, gid AS entry FROM sc WHERE missed UNION ALL SELECT gid, 'false_escalations', gid FROM sc WHERE false_esc
UNION ALL SELECT gid, 'urgency_under', {_SAID} FROM sc WHERE gap < 0 UNION ALL SELECT gid, 'urgency_over', {_SAID} FROM sc WHERE gap > 0
UNION ALL SELECT gid, 'urgency_hard_under', {_SAID} FROM sc WHERE gap < 0 AND NOT list_contains(amb, 'urgency')
UNION ALL SELECT gid, 'overconfidence', gid || ' claimed ' || format('{{:.2f}}', c_conf) || ', ceiling ' || CAST(hi AS VARCHAR) FROM sc WHERE banded AND NOT ceiling_ok
UNION ALL SELECT gid, 'confidence_misses', gid || ' got ' || format('{{:.2f}}', c_conf) || ', expected [' || CAST(lo AS VARCHAR) || ', ' || CAST(hi AS VARCHAR) || ']' FROM sc WHERE banded AND NOT (floor_ok AND ceiling_ok)""")
def offenders(spark, sf):
    return scoring.offenders(scores(spark, sf))


_USAGE = f"""u AS (SELECT ({O.lst(D.MODELS)})[l_partkey % 4 + 1] AS model, 1000 + CAST(l_quantity AS BIGINT) * 37 AS tin, CAST(l_quantity AS BIGINT) * 30 AS tcached, 200 + l_suppkey % 700 AS tout FROM lineitem)"""


def _usage(spark, sf):
    l = D.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"))
    return l.select(
        D.pick(D.MODELS, F.col("l_partkey") % 4).alias("model"), (1000 + F.col("qty") * 37).alias("input_tokens"), (F.col("qty") * 30).alias("cached_tokens"),
        (200 + F.col("l_suppkey") % 700).alias("output_tokens"),
    )


@query(f"""WITH {_USAGE} SELECT model, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tcached) AS BIGINT) AS tokens_cached, CAST(sum(tout) AS BIGINT) AS tokens_out,
round(avg(tin), 4) AS mean_in, round(avg(tcached), 4) AS mean_cached, round(avg(tout), 4) AS mean_out, round(sum({O.cost_sql('model', 'tin', 'tcached', 'tout')}), 4) AS cost_usd FROM u GROUP BY model""")
def token_totals(spark, sf):
    return rounded(costs.token_totals(_usage(spark, sf), ["model"]), 4)


@query(f"""WITH {_USAGE}, t AS (SELECT model, count(*) AS n, sum(tin)::BIGINT AS tin, sum(tcached)::BIGINT AS tcached, sum(tout)::BIGINT AS tout FROM u GROUP BY model),
c AS (SELECT model, n, {O.cost_sql('model', 'tin', 'tcached', 'tout')} / n AS cpt FROM t) SELECT model, n, round(cpt, 6) AS cost_per_ticket, round(cpt / (SELECT cpt FROM c WHERE model = 'gpt-5-2025-08-07'), 6) AS ratio FROM c""")
def cost_per_ticket(spark, sf):
    return rounded(costs.cost_per_ticket(_usage(spark, sf), "gpt-5-2025-08-07"))


def _latency_sql(src: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by} AS \"{by}\", " if by else ""
    group = f" GROUP BY {by}" if by else ""

    def at(i: str) -> str:
        return f"max(CASE WHEN rn = (CASE WHEN {i} < 0 THEN n + ({i}) ELSE {i} END) THEN v END)"

    return f"""(SELECT {cols}max(n) AS n, {at('n // 2')} AS p50, {at('CAST(floor(n * 0.95::DOUBLE) AS BIGINT) - 1')} AS p95, {at('CAST(floor(n * 0.99::DOUBLE) AS BIGINT) - 1')} AS p99,
max(v) AS max_ms, round(avg(v), 4) AS mean_ms FROM (SELECT *, row_number() OVER ({part} ORDER BY v) - 1 AS rn, count(*) OVER ({part}) AS n FROM (SELECT *, latency_ms AS v FROM {src})){group})"""


@query(_L + " SELECT * FROM " + _latency_sql("ledger", "source"))
def latency_profile(spark, sf):
    return rounded(costs.latency_profile(D.event_ledger(spark, sf), ["source"]), 4)


@query(_L + " SELECT * FROM " + _latency_sql("ledger", None), name="latency_profile_overall")
def latency_profile_overall(spark, sf):
    return rounded(costs.latency_profile(D.event_ledger(spark, sf)), 4)


# Drafts are the answers; a second read of the same order differs by its date.
_FINALS = f"""fin AS (SELECT 'O-' || o_orderkey AS fkey, ({O.lst(L.CATEGORIES)})[(o_orderkey + (o_custkey % 3 = 0)::INTEGER) % 8 + 1] AS f_cat, ({O.lst(L.URGENCIES)})[(o_orderkey // 2) % 4 + 1] AS f_urg,
o_orderkey % 3 = 0 AS f_esc, 1500 + o_orderkey % 1800 AS f_in, o_orderkey % 1200 AS f_cached, 400 + o_orderkey % 900 AS f_out FROM ord)"""


def _finals(spark, sf):
    o = D._orders(spark, sf)
    k = F.col("o_orderkey")
    drafts = D.answers(spark, sf).select(F.col("ticket_key"), F.col("extraction").alias("_x"))
    x = F.coalesce(F.col("_x"), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in D.EXTRACTION]))
    changed = (
        x.withField("category", D.pick(L.CATEGORIES, (k + (F.col("o_custkey") % 3 == 0).cast("int")) % 8))
        .withField("urgency", D.pick(L.URGENCIES, F.floor(k / 2) % 4))
        .withField("escalate", k % 3 == 0)
    )
    usage = {"input_tokens": 1500 + k % 1800, "output_tokens": 400 + k % 900, "cache_read_input_tokens": k % 1200}
    return o.withColumn("ticket_key", F.concat(F.lit("O-"), k.cast("string"))).join(drafts, "ticket_key").select(
        "ticket_key", F.lit("gpt-5-2025-08-07").alias("model"), changed.alias("extraction"),
        F.struct(*[usage.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in D.USAGE]).alias("usage"),
        F.lit(5000).cast("bigint").alias("latency_ms"), F.lit(None).cast("string").alias("error"),
    )


_REREAD = "coalesce(NOT a_failed AND (a_esc OR a_urg IN ('high', 'critical') OR a_conf < 0.5), false)"
_CASC = f"""{_A}, {_FINALS}, c0 AS (SELECT *, {_REREAD} AS reread FROM ans LEFT JOIN fin ON akey = fkey),
c AS (SELECT *, CASE WHEN reread THEN 'gpt-5-2025-08-07' ELSE a_model END AS model, tin + CASE WHEN reread THEN f_in ELSE 0 END AS t_in, tcached + CASE WHEN reread THEN f_cached ELSE 0 END AS t_cached,
tout + CASE WHEN reread THEN f_out ELSE 0 END AS t_out, CASE WHEN reread THEN a_cat <> f_cat OR a_urg <> f_urg OR a_esc <> f_esc END AS changed,
{O.micro_sql('a_model', 'tin', 'tcached', 'tout')} AS d_micro, {O.micro_sql("'gpt-5-2025-08-07'", 'f_in', 'f_cached', 'f_out')} AS f_micro,
{O.cost_sql("'gpt-5-2025-08-07'", 'f_in', 'f_cached', 'f_out')} AS f_cost FROM c0),
cc AS (SELECT *, {O.usd6_sql(O.micro_sql('model', 't_in', 't_cached', 't_out'))} AS cost, {O.usd6_sql('(d_micro + CASE WHEN reread THEN f_micro ELSE 0 END)')} AS own FROM c)"""


@query(_CASC + " SELECT akey AS id, model, CASE WHEN reread THEN f_cat WHEN a_failed THEN NULL ELSE a_cat END AS category, reread, changed, t_in AS input_tokens, cost AS cost_usd, own AS cost_usd_by_reader, CASE WHEN reread THEN a_cat END AS draft_category FROM cc")
def cascade_by_draft(spark, sf):
    c = cascade.cascade_by_draft(D.answers(spark, sf), _finals(spark, sf))
    u = F.col("usage")
    return c.select(
        F.col("ticket_key").alias("id"), "model", F.col("extraction.category").alias("category"), u["cascade"]["reread"].alias("reread"), u["cascade"]["changed"].alias("changed"),
        u["input_tokens"].alias("input_tokens"), u["cost_usd"].alias("cost_usd"), u["cost_usd_by_reader"].alias("cost_usd_by_reader"), u["cascade"]["draft_said"]["category"].alias("draft_category"),
    )


@query(_CASC + """ SELECT count(*) AS n, count(*) FILTER (WHERE reread) AS reread, round(count(*) FILTER (WHERE reread) / count(*), 6) AS reread_share, count(*) FILTER (WHERE changed) AS changed, round(sum(cost), 4) AS spend, round(sum(own), 4) AS spend_by_reader,
round(sum(f_cost), 4) AS base_spend, round(1 - sum(cost) / sum(f_cost), 6) AS saving, round(1 - sum(own) / sum(f_cost), 6) AS saving_by_reader, round(avg(cost), 6) AS mean_cost,
round(avg(CASE WHEN reread THEN cost END), 6) AS mean_cost_reread FROM cc""")
def cascade_report(spark, sf):
    finals = _finals(spark, sf)
    rep = cascade.cascade_report(cascade.cascade_by_draft(D.answers(spark, sf), finals), finals)
    money = {"spend", "spend_by_reader", "base_spend"}
    return rep.select(*[r(F.col(f.name), 4 if f.name in money else 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rep.schema])


def _shipped_sql(out: str, used: str, reread: str) -> str:
    """Decisions on the answers that a cascade ships, folded like any others."""
    def either(final: str, draft: str, words: str) -> str:
        return f"CASE WHEN {used} THEN CASE WHEN {reread} THEN {final} ELSE {draft} END ELSE {words} END"

    fold = O.fold_ctes(
        "both_reads", either("f_cat", "a_cat", "k_cat"), f"CASE WHEN {used} THEN a_conf ELSE k_conf END", either("f_urg", "a_urg", "k_urg"), f"coalesce({either('f_esc', 'a_esc', 'false')}, false)",
        f"CASE WHEN {used} THEN a_rs ELSE []::VARCHAR[] END", f"CASE WHEN {used} THEN 'By its tone.' ELSE urg_why END", f"CASE WHEN {used} THEN ['tone'] ELSE k_sig END",
    )
    return f"{out} AS (SELECT * FROM (WITH {fold} SELECT *, 'llm' AS mode, a_name AS c_name, a_guess AS c_guess, a_who_conf AS c_conf, ['x'] AS c_basis, a_ids AS c_ids FROM d))"


_FAILURES = """count(*) FILTER (WHERE missed) AS {0}missed_escalations, count(*) FILTER (WHERE false_esc) AS {0}false_escalations, count(*) FILTER (WHERE gap < 0) AS {0}urgency_under,
count(*) FILTER (WHERE e_urg = 'critical' AND urg <> 'critical') = 0 AS {0}urgency_never_under_critical, round(count(*) FILTER (WHERE category_ok) / count(*), 6) AS {0}category_accuracy"""


@query(f"""WITH {O.ORDER_TICKETS}, {O.ANSWERS}, {_FINALS}, {O.GOLD}, {O.keyword_ctes()}, both_reads AS (SELECT kw.*, ans.*, fin.*, {_REREAD} AS reread FROM kw JOIN ans ON kw.id = akey JOIN fin ON fkey = akey),
{_shipped_sql("ship", "(CASE WHEN reread THEN NOT a_failed ELSE a_problem IS NULL END)", "reread")}, {_shipped_sql("dear", "(NOT a_failed)", "true")},
{O.scores_cte("ship", "scored_ship")}, {O.scores_cte("dear", "scored_dear")} SELECT * FROM (SELECT {_FAILURES.format("")} FROM scored_ship), (SELECT {_FAILURES.format("base_")} FROM scored_dear)""")
def cascade_quality(spark, sf):
    """What a draft cascade gets wrong beside the dear reader, both decided from one reading of the tickets."""
    finals = _finals(spark, sf)
    runs = {"cascade": cascade.cascade_by_draft(D.answers(spark, sf), finals), "base": finals}
    scored = scoring.score(D.gold(spark, sf), decide_runs(D.eval_tickets(spark, sf), runs), also=["run"])
    return rounded(cascade.cascade_quality(scored))


@query(f"""WITH {O.rules_ctes(O.ORDER_TICKETS)}, {O.ANSWERS}, {_FINALS}, t AS ({_TRIAGE}) SELECT t.id, expensive, CASE WHEN expensive THEN 'gpt-5-2025-08-07' ELSE a_model END AS model,
CASE WHEN expensive THEN f_in ELSE tin END AS input_tokens, {O.usd6_sql("CASE WHEN expensive THEN " + O.micro_sql("'gpt-5-2025-08-07'", 'f_in', 'f_cached', 'f_out') + " ELSE " + O.micro_sql('a_model', 'tin', 'tcached', 'tout') + " END")} AS cost_usd
FROM t JOIN ans ON akey = t.id JOIN fin ON fkey = t.id""")
def cascade_by_rules(spark, sf):
    triaged = cascade.triage_by_rules(D.order_tickets(spark, sf)).select(F.col("id").alias("ticket_key"), "expensive", "why")
    c = cascade.cascade_by_rules(triaged, D.answers(spark, sf), _finals(spark, sf))
    return c.select(
        F.col("ticket_key").alias("id"), F.col("usage.cascade.expensive").alias("expensive"), "model", F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.cost_usd").alias("cost_usd")
    )


_AGREE = f"""WITH {O.RUNS}, f AS (SELECT tk, run, 'category' AS field, cat AS value FROM rd UNION ALL SELECT tk, run, 'urgency', urg FROM rd UNION ALL SELECT tk, run, 'escalate', CASE WHEN esc THEN 'yes' ELSE 'no' END FROM rd
UNION ALL SELECT tk, run, 'route', concat_ws(' + ', queue, eq) FROM rd UNION ALL SELECT tk, run, 'who (stated name)', coalesce(name, 'not stated') FROM rd),
n AS (SELECT tk, field, value, count(*) AS c, min(run) AS first_run FROM f GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY tk, field ORDER BY c DESC, first_run) AS rn,
sum(c) OVER (PARTITION BY tk, field)::BIGINT AS runs FROM n)"""


@query(_AGREE + """, w AS (SELECT tk, max(CASE WHEN field = 'category' THEN value END) AS category, max(CASE WHEN field = 'category' THEN c / runs END) AS category_share, max(CASE WHEN field = 'urgency' THEN value END) AS urgency,
max(CASE WHEN field = 'urgency' THEN c / runs END) AS urgency_share, max(CASE WHEN field = 'escalate' THEN value END) AS escalate, max(CASE WHEN field = 'escalate' THEN c / runs END) AS escalate_share FROM top WHERE rn = 1 GROUP BY tk)
SELECT w.tk AS ticket_key, category, round(category_share, 6) AS category_share, urgency, round(urgency_share, 6) AS urgency_share, escalate, round(escalate_share, 6) AS escalate_share, runs, round(mean_c, 6) AS mean_confidence,
round(sd, 6) AS sd_confidence, mn AS min_confidence, mx AS max_confidence FROM w JOIN (SELECT tk, count(*) AS runs, avg(conf) AS mean_c, CASE WHEN min(conf) = max(conf) THEN 0.0 ELSE stddev_samp(conf) END AS sd, min(conf) AS mn, max(conf) AS mx FROM rd GROUP BY tk) x ON w.tk = x.tk""")
def agreement(spark, sf):
    return rounded(stability.agreement(D.repeated_runs(spark, sf)))


@query(_AGREE + """ SELECT count(DISTINCT tk) AS tickets, count(*) FILTER (WHERE field = 'category' AND c = runs) AS category_unanimous, count(*) FILTER (WHERE field = 'escalate' AND c = runs) AS escalate_unanimous,
(SELECT round(avg(sd), 6) FROM (SELECT CASE WHEN min(conf) = max(conf) THEN 0.0 ELSE stddev_samp(conf) END AS sd FROM rd GROUP BY tk)) AS mean_sd,
(SELECT round(max(sd), 6) FROM (SELECT CASE WHEN min(conf) = max(conf) THEN 0.0 ELSE stddev_samp(conf) END AS sd FROM rd GROUP BY tk)) AS max_sd FROM top WHERE rn = 1""")
def agreement_summary(spark, sf):
    return rounded(stability.agreement_summary(stability.agreement(D.repeated_runs(spark, sf))))


@query(_AGREE + " SELECT tk AS ticket_key, field, value AS most_common, c AS same, runs, c < runs AS flipped FROM top WHERE rn = 1")
def consistency(spark, sf):
    return stability.consistency(D.repeated_runs(spark, sf))


@query(_AGREE + " SELECT tk AS ticket_key, CAST(run AS INTEGER) AS run, field, value FROM f")
def consistency_values(spark, sf):
    return stability.consistency_values(D.repeated_runs(spark, sf))


_NUM = f"""WITH {O.RUNS}, x AS (SELECT tk, 'category confidence' AS field, round(conf, 2) AS v FROM rd UNION ALL SELECT tk, 'who confidence', CASE WHEN name IS NULL THEN 0.4 ELSE 1.0 END::DOUBLE FROM rd),
nm AS (SELECT tk, field, min(v) AS mn, max(v) AS mx, round(max(v) - min(v), 2) AS spread, round(stddev_pop(v), 3) AS sd FROM x GROUP BY ALL)"""


@query(_NUM + " SELECT tk AS ticket_key, field, mn AS min, mx AS max, spread, sd FROM nm")
def consistency_numbers(spark, sf):
    return stability.consistency_numbers(D.repeated_runs(spark, sf))


@query(f"WITH {O.RUNS} SELECT tk AS ticket_key, count(*) AS runs, count(*) FILTER (WHERE mode <> 'llm') AS failed FROM rd GROUP BY tk")
def failed_reads(spark, sf):
    return stability.failed_reads(D.repeated_runs(spark, sf))


@query(_AGREE + """, x AS (SELECT tk, 'category confidence' AS field, round(conf, 2) AS v FROM rd UNION ALL SELECT tk, 'who confidence', CASE WHEN name IS NULL THEN 0.4 ELSE 1.0 END::DOUBLE FROM rd),
nm AS (SELECT tk, field, round(max(v) - min(v), 2) AS spread FROM x GROUP BY ALL)
SELECT field, count(*) AS tickets, count(*) FILTER (WHERE c < runs) AS changed, NULL::DOUBLE AS mean_spread, NULL::DOUBLE AS max_spread FROM top WHERE rn = 1 GROUP BY field
UNION ALL SELECT field, count(*), count(*) FILTER (WHERE spread > 0), round(avg(spread), 6), max(spread) FROM nm GROUP BY field""")
def flip_report(spark, sf):
    runs = D.repeated_runs(spark, sf)
    return rounded(stability.flip_report(stability.consistency(runs), stability.consistency_numbers(runs)))


@query(_AGREE + " SELECT field, tk AS ticket_key FROM top WHERE rn = 1 AND c < runs")
def flipped_tickets(spark, sf):
    return stability.flipped_tickets(stability.consistency(D.repeated_runs(spark, sf)))


_RECHECK = f"""WITH {O.RUNS_OF_SIX}, f AS (SELECT tk, run, unnest([{{'f': 'category', 'd': true, 'v': cat}}, {{'f': 'urgency', 'd': true, 'v': urg}}, {{'f': 'escalate', 'd': true, 'v': CASE WHEN esc THEN 'yes' ELSE 'no' END}},
{{'f': 'escalation_reasons', 'd': true, 'v': CASE WHEN esc THEN reason ELSE '—' END}}, {{'f': 'queue', 'd': true, 'v': concat_ws(' + ', queue, eq)}}, {{'f': 'customer', 'd': false, 'v': coalesce(name, '(not stated) a shop customer')}},
{{'f': 'category_confidence', 'd': false, 'v': format('{{:.2f}}', conf)}}, {{'f': 'customer_confidence', 'd': false, 'v': CASE WHEN name IS NULL THEN '0.40' ELSE '1.00' END}},
{{'f': 'category_reason', 'd': false, 'v': 'reads like ' || cat}}]) AS e FROM rd WHERE run <= 5),
rc AS (SELECT tk, e.f AS field, bool_or(e.d) AS decisive, string_agg(e.v, '|' ORDER BY run) AS vals, count(DISTINCT e.v) = 1 AS agree FROM f GROUP BY ALL)"""


def _recheck(spark, sf):
    original = D.repeated_runs(spark, sf, 1).drop("run")
    return stability.recheck(original, D.repeated_runs(spark, sf, 6, 1), runs=5)


@query(_RECHECK + ' SELECT tk AS ticket_key, field, decisive, vals AS "values", agree FROM rc')
def recheck(spark, sf):
    return _recheck(spark, sf).select("ticket_key", "field", "decisive", join(F.col("values")).alias("values"), "agree")


@query(f"WITH {O.RUNS_OF_SIX} SELECT tk AS ticket_key, run, coalesce(model, 'keyword rules') AS model, latency_ms FROM rd WHERE run <= 5")
def recheck_reads(spark, sf):
    original = D.repeated_runs(spark, sf, 1).drop("run")
    return stability.recheck_reads(original, D.repeated_runs(spark, sf, 6, 1), runs=5)


@query(_RECHECK + " SELECT tk AS ticket_key, bool_and(agree OR NOT decisive) AS stable FROM rc GROUP BY tk")
def recheck_verdict(spark, sf):
    return stability.recheck_verdict(_recheck(spark, sf))


_EVID = "(SELECT grp, gid, text, esc, coalesce(used AND a_esc, false) AS alone, len(list_filter(hits, lambda h: NOT starts_with(h, 'spam.suppress'))) > 0 AS kw FROM gold JOIN dm ON gid = dm.id WHERE e_esc)"


@query(O.MODEL + f', {O.GOLD} SELECT grp AS "group", gid AS id, text, esc AS caught, alone AS model_alone, kw AS keywords FROM ' + _EVID)
def escalation_evidence(spark, sf):
    return evidence.escalation_evidence(D.gold(spark, sf), read_by_model(spark, sf))


@query(O.MODEL + f', {O.GOLD} SELECT grp AS "group", count(*) AS tickets, count(*) FILTER (WHERE esc) AS caught, count(*) FILTER (WHERE esc AND NOT kw) AS caught_without_keyword FROM {_EVID} GROUP BY grp')
def escalation_evidence_counts(spark, sf):
    return evidence.escalation_evidence_counts(evidence.escalation_evidence(D.gold(spark, sf), read_by_model(spark, sf)))


_MIST = f"""WITH {O.RUNS}, {O.GOLD}, j AS (SELECT 'reader-' || run AS model, 'low' AS effort, gid AS id, e_esc, esc, urg, e_urg, amb FROM gold JOIN rd ON gid = tk),
mis AS (SELECT model, effort, id, 'false' AS kind, NULL AS said, NULL AS expected_urgency, NULL::BOOLEAN AS borderline FROM j WHERE NOT e_esc AND esc AND NOT list_contains(amb, 'escalate')
UNION ALL SELECT model, effort, id, 'low', urg, e_urg, list_contains(amb, 'urgency') FROM j WHERE list_position({O.lst(L.URGENCIES)}, urg) < list_position({O.lst(L.URGENCIES)}, e_urg)
UNION ALL SELECT model, effort, id, 'missed', NULL, NULL, NULL FROM j WHERE e_esc AND NOT esc)"""


def _mistakes(spark, sf):
    runs = D.repeated_runs(spark, sf).select(
        F.concat(F.lit("reader-"), F.col("run").cast("string")).alias("model"), F.lit("low").alias("effort"), F.col("ticket_key").alias("id"), "decision"
    )
    return evidence.model_mistakes(D.gold(spark, sf), runs)


@query(_MIST + " SELECT * FROM mis")
def model_mistakes(spark, sf):
    return _mistakes(spark, sf).drop("text")


@query(_MIST + """ SELECT model, effort, count(*) FILTER (WHERE kind = 'false') AS "false", count(*) FILTER (WHERE kind = 'low') AS low, count(*) FILTER (WHERE kind = 'missed') AS missed FROM mis GROUP BY ALL""")
def model_mistake_counts(spark, sf):
    return evidence.model_mistake_counts(_mistakes(spark, sf))


@query(_SCORED + " SELECT count(*) AS n, count(*) FILTER (WHERE customer_ok) AS names_right, count(*) FILTER (WHERE e_id IS NOT NULL) AS identifiers_expected, count(*) FILTER (WHERE e_id IS NOT NULL AND identifier_ok) AS identifiers_found FROM sc")
def extraction_probe(spark, sf):
    return scoring.extraction_probe(scores(spark, sf))


_PROBE = f"WITH {O.rules_ctes(O.ORDER_TICKETS)}, p AS (SELECT 'O-' || o_orderkey AS pid, o_orderstatus <> 'O' AS want FROM ord), j AS (SELECT * FROM p JOIN d ON pid = d.id)"


@query(_PROBE + """ SELECT count(*) AS n, count(*) FILTER (WHERE want) AS must_catch, count(*) FILTER (WHERE want AND esc) AS caught, count(*) FILTER (WHERE want AND NOT esc) AS missed, count(*) FILTER (WHERE NOT want AND esc) AS false_positives,
count(*) FILTER (WHERE len(hits) > 0) AS leaked, count(*) FILTER (WHERE len(hits) > 0) = 0 AS precondition_holds FROM j""")
def keyword_free_probe(spark, sf):
    return scoring.keyword_free_probe(D.probe(spark, sf), read_by_keywords(spark, sf))


@query(_PROBE + " SELECT pid AS id, array_to_string(list_transform(hits, lambda h: string_split(h, '~')[1]), '|') AS rules FROM j WHERE len(hits) > 0")
def keyword_free_leaks(spark, sf):
    leaks = scoring.keyword_free_leaks(D.probe(spark, sf), read_by_keywords(spark, sf))
    return leaks.select("id", join(F.col("rules")).alias("rules"))


@query(_SCORED + """ SELECT gid AS id, e_cat || '/' || e_urg || '/' || CASE WHEN e_esc THEN 'ESC' ELSE 'no esc' END AS wanted, cat || '/' || urg || '/' || CASE WHEN esc THEN 'ESC' ELSE 'no esc' END AS got,
NOT missed AND NOT false_esc AND urgency_ok AND category_ok AS ok FROM sc""")
def stress_report(spark, sf):
    return scoring.stress_report(scores(spark, sf))


@query("""WITH s AS (SELECT *, s_suppkey AS k FROM supplier) SELECT 'model-' || s_name AS model, CASE WHEN k % 3 = 1 THEN 'low' WHEN k % 3 = 2 THEN 'medium' ELSE 'low' END AS effort,
round(CASE WHEN k % 10 <> 0 THEN s_acctbal / 1000000 END, 9) AS cost_per_ticket, k % 3 AS missed_escalations, k % 5 AS false_escalations, k % 6 AS urgency_under, k % 2 + k % 4 AS urgency_under_clear,
k % 4 AS critical_under_clear, k % 4 > 0 AS critical_under_called, CASE WHEN k % 4 <> 0 THEN k % 7 ELSE 0 END AS no_answer, 30 + k % 40 AS n, CASE WHEN k % 6 <> 0 THEN 10 + k % 20 ELSE 11 END AS must_escalate FROM s""")
def model_comparison(spark, sf):
    return rounded(costs.model_comparison(D.run_results(spark, sf)), 9)


@query(_SUBMIT + """ SELECT (SELECT count(*) FROM old) AS rows_before, (SELECT count(*) FROM old) + count(*) AS rows_after, count(*) AS accepted, 0 AS not_stored, count(*) AS added, true AS exact
FROM fresh f WHERE rn = 1 AND (external_id IS NULL OR NOT EXISTS (SELECT 1 FROM old WHERE old.source = f.source AND old.external_id = f.external_id))""")
def reconcile(spark, sf):
    before, new = _before_and_new(spark, sf)
    after, winners = ledger.record(new, before)
    accepted = winners.where(~F.col("discarded")).select("id")
    return ledger.reconcile(before, after, accepted)


_DASH = f"""c AS (SELECT urg AS urgency, cat AS category, esc, mode, latency_ms, coalesce(cost_usd, 0) AS usd FROM dm)
SELECT 'total' AS section, 'tickets' AS name, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'total', 'needs human', count(*) FILTER (WHERE esc) FROM c UNION ALL SELECT 'total', 'failed extractions', count(*) FILTER (WHERE mode <> 'llm') FROM c
UNION ALL SELECT 'total', 'read time ms', sum(latency_ms) FROM c UNION ALL SELECT 'total', 'spend usd', round(sum(usd), 4) FROM c UNION ALL SELECT 'urgency', urgency, count(*) FROM c GROUP BY urgency
UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category"""


@query(O.MODEL + ", " + _DASH, name="dashboard")
def dashboard_figures(spark, sf):
    d = read_by_model(spark, sf)
    x = F.col("extraction")
    flat = d.select(
        x["urgency"].alias("urgency"), x["category"].alias("category"), x["escalate"].alias("escalate"), "mode", "latency_ms", F.col("usage.cost_usd").alias("cost_usd")
    )
    return rounded(dashboard.dashboard(flat), 4)


@query(_L + """ SELECT mode = 'llm' AS ok, CASE WHEN mode = 'llm' THEN 'ok' ELSE 'failing' END AS last_model_call, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS last_model_call_at, CASE WHEN mode <> 'llm' THEN error[:300] END AS last_model_error
FROM ledger WHERE mode <> 'rules' ORDER BY created_at DESC, id DESC LIMIT 1""")
def model_health(spark, sf):
    h = dashboard.model_health(D.event_ledger(spark, sf))
    return h.withColumn("last_model_call_at", F.date_format("last_model_call_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH legs(model, effort, rin, rcached, rout, tout) AS (VALUES ('gpt-5', 'low', 1.25, 0.125, 10.0, 900), ('gpt-5-mini', 'minimal', 0.25, 0.025, 2.0, 450), ('gpt-5-nano', 'high', 0.05, 0.005, 0.4, 2600)),
t AS (SELECT count(*) AS calls FROM conversations) SELECT model, effort, calls, round(calls * (250 * rin + 2250 * rcached + tout * rout) / 1000000.0::DOUBLE, 6) AS usd, calls * (250 * rin + 2250 * rcached + tout * rout) / 1000000.0::DOUBLE > 0.25 AS over_budget FROM t, legs""")
def forecast_spend(spark, sf):
    return rounded(costs.forecast_spend(_turns(spark, sf), [("gpt-5", "low"), ("gpt-5-mini", "minimal"), ("gpt-5-nano", "high")]))


def _headline_sql(t: str) -> str:
    return f"""SELECT unnest([{{'m': 'escalation_recall', 'v': coalesce(count(*) FILTER (WHERE e_esc AND esc) / nullif(count(*) FILTER (WHERE e_esc), 0), 1.0)}}, {{'m': 'category_accuracy', 'v': count(*) FILTER (WHERE category_ok) / count(*)}},
{{'m': 'urgency_exact', 'v': count(*) FILTER (WHERE urgency_exact) / count(*)}}, {{'m': 'urgency_accuracy', 'v': count(*) FILTER (WHERE urgency_ok) / count(*)}}, {{'m': 'customer_accuracy', 'v': count(*) FILTER (WHERE customer_ok) / count(*)}},
{{'m': 'identifier_accuracy', 'v': count(*) FILTER (WHERE identifier_ok) / count(*)}}]) AS e FROM {t}"""


@query(_TWO + f" SELECT x.e.m AS metric, round(x.e.v, 6) AS a, round(y.e.v, 6) AS b FROM ({_headline_sql('sa')}) x JOIN ({_headline_sql('sb')}) y ON x.e.m = y.e.m")
def compare_scorecards(spark, sf):
    return rounded(scoring.compare_runs_scorecards(_two_runs(spark, sf), "a", "b"))


@query(_TWO + """, o AS (SELECT 'missed_escalations' AS kind, gid, 1 AS a, 0 AS b FROM sa WHERE missed UNION ALL SELECT 'false_escalations', gid, 1, 0 FROM sa WHERE false_esc UNION ALL SELECT 'missed_escalations', gid, 0, 1 FROM sb WHERE missed
UNION ALL SELECT 'false_escalations', gid, 0, 1 FROM sb WHERE false_esc) SELECT kind, gid AS id, max(a) > 0 AS in_a, max(b) > 0 AS in_b FROM o GROUP BY kind, gid""")
def compare_offenders(spark, sf):
    return scoring.compare_runs_offenders(_two_runs(spark, sf), "a", "b")


@query(O.MODEL + """, i AS (SELECT *, mode = 'llm_fallback_rules' AS fb FROM dm), v AS (SELECT 'queue never empty' AS c, count(*) FILTER (WHERE coalesce(queue, '') = '') AS n FROM i UNION ALL SELECT 'every field carries a reason', count(*) FILTER (WHERE uwhy = '') FROM i
UNION ALL SELECT 'no unexpected fallback', count(*) FILTER (WHERE fb) FROM i UNION ALL SELECT 'confidence within 0 and 1', count(*) FILTER (WHERE NOT (c_conf BETWEEN 0 AND 1 AND conf BETWEEN 0 AND 1)) FROM i
UNION ALL SELECT 'a stated name is a confident one', count(*) FILTER (WHERE c_name IS NOT NULL AND c_conf < 0.9) FROM i UNION ALL SELECT 'a stated name occurs in the text', count(*) FILTER (WHERE c_name IS NOT NULL AND NOT contains(lower(text), lower(c_name))) FROM i
UNION ALL SELECT 'a guess carries its basis', count(*) FILTER (WHERE len(c_basis) = 0 AND c_conf <> 0) FROM i) SELECT c AS "check", n AS violations, n = 0 AS passed FROM v""")
def invariants(spark, sf):
    return dashboard.invariants(read_by_model(spark, sf))


# --- windows, sorts, sets --------------------------------------------------------------------


@query(_L + _FIRST.format("id, source, external_id", "ledger"))
def dedupe_earliest(spark, sf):
    return ledger.dedupe_earliest(D.event_ledger(spark, sf)).select("id", "source", "external_id")


@query(_L + """ SELECT id, source, external_id FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY created_at DESC, id DESC) AS rn FROM ledger WHERE external_id IS NOT NULL) WHERE rn = 1""")
def latest_by_key(spark, sf):
    return ledger.latest_by_key(D.event_ledger(spark, sf)).select("id", "source", "external_id")


@query(_L + " SELECT id, source, external_id FROM ledger WHERE source = 'click' AND external_id = '46' ORDER BY created_at DESC, id DESC LIMIT 1")
def find_by_external(spark, sf):
    return ledger.find_by_external(D.event_ledger(spark, sf), "click", "46").select("id", "source", "external_id")


@query(_L + f" SELECT id, queue FROM ledger WHERE queue = {O.q(L.ESCALATION_QUEUE)} OR escalation_queue = {O.q(L.ESCALATION_QUEUE)} ORDER BY created_at DESC, id DESC LIMIT 100")
def list_recent(spark, sf):
    return ledger.list_recent(D.event_ledger(spark, sf), 100, L.ESCALATION_QUEUE).select("id", "queue")


@query(_L + " SELECT id, urgency, latency_ms FROM ledger ORDER BY list_position(['critical', 'high', 'medium', 'low'], urgency), created_at DESC, id DESC")
def sort_decisions(spark, sf):
    return dashboard.sort_decisions(D.event_ledger(spark, sf), "most urgent").select("id", "urgency", "latency_ms")


@query(f"""WITH {O.ORD}, {O.GOLD} SELECT gid AS id, grp AS "group", e_cat AS category, e_urg AS urgency, e_esc AS escalate, array_to_string(amb, '|') AS ambiguous FROM gold
UNION ALL SELECT 'O-' || o_orderkey, 'keyword-free', 'other', 'low', o_orderstatus <> 'O', 'category' FROM ord""")
def all_labelled(spark, sf):
    e = F.col("expected")
    return scoring.all_labelled(D.gold(spark, sf), probe=D.probe(spark, sf)).select(
        "id", "group", e["category"].alias("category"), e["urgency"].alias("urgency"), e["escalate"].alias("escalate"), join(F.col("ambiguous")).alias("ambiguous")
    )


@query("SELECT conv_id || '-' || turn AS id, CAST(run AS INTEGER) AS run FROM conversations, (SELECT unnest(range(5)) AS run)")
def expand_runs(spark, sf):
    return stability.expand_runs(_turns(spark, sf), 5).select("id", "run")


# --- scalar functions ------------------------------------------------------------------------


@query(O.RULES_DOCUMENTS + " SELECT id, k_cat AS category, k_conf AS confidence FROM kw")
def keyword_category(spark, sf):
    t = folded_documents(spark, sf)
    return t.select("id", K.keyword_category(F.col("text"), "_low").alias("k")).select("id", "k.*")


@query(O.RULES_DOCUMENTS + " SELECT id, k_cat AS category, k_urg AS urgency, array_to_string(k_sig, '|') AS signals FROM kw")
def keyword_urgency(spark, sf):
    t = folded_documents(spark, sf).select("id", "text", "_low", "_low_heads", K.keyword_category(F.col("text"), "_low")["category"].alias("category"))
    return t.select("id", "category", K.keyword_urgency(F.col("text"), F.col("category"), "_low").alias("u")).select(
        "id", "category", "u.urgency", join(F.col("u.signals")).alias("signals")
    )


@query(O.RULES_DOCUMENTS + " SELECT id, who AS name, contact AS contact_name, array_to_string(ids, '|') AS identifiers, guess AS best_guess, who_conf AS confidence, array_to_string(basis, '|') AS basis FROM kw")
def sender(spark, sf):
    s = K.add_sender(folded_documents(spark, sf), "text", "", low="_low")
    return s.select("id", "name", "contact_name", join(F.col("identifiers")).alias("identifiers"), "best_guess", "confidence", join(F.col("basis")).alias("basis"))


@query(O.RULES_DOCUMENTS + f" SELECT id, array_to_string(ids, '|') AS identifiers, dom AS domain, lower(dom) IN ({', '.join(O.q(m) for m in L.FREE_MAIL)}) AS free_mail, summary FROM kw")
def text_fields(spark, sf):
    t = F.col("text")
    rows = folded_documents(spark, sf).select("id", join(K.identifiers(t, "_low")).alias("identifiers"), K.email_domain(t, "_low").alias("domain"), K.summary_line(t).alias("summary"))
    return rows.select("id", "identifiers", "domain", K.is_free_mail(F.col("domain")).alias("free_mail"), "summary")


@query(O.RULES_ORDERS + f" SELECT id, who_why AS customer_reason, cat_why AS category_reason, urg_why AS keyword_urgency_reason, uwhy AS urgency_reason, {O.q(L.ESCALATION_REASON_TEXT)} AS escalation_reason_text, rationale FROM d")
def reason_texts(spark, sf):
    x = F.col("extraction")
    plain = F.regexp_replace(x["urgency_reason"], r"( |^)Then the .*", "")
    return rules(spark, sf).select(
        "id", x["customer_reason"].alias("customer_reason"), x["category_reason"].alias("category_reason"), plain.alias("keyword_urgency_reason"), x["urgency_reason"].alias("urgency_reason"),
        x["escalation_reason_text"].alias("escalation_reason_text"), x["rationale"].alias("rationale"),
    )


@query(O.RULES_DOCUMENTS + " SELECT id, " + ", ".join(f"g{i} AS {L.GUARDRAILS[i][0].replace('.', '_')}" for i in range(len(L.GUARDRAILS))) + ", CASE WHEN g0 || g1 || g2 <> '' THEN act ELSE '' END AS active FROM m")
def guardrail_matches(spark, sf):
    m = add_guardrail_matches(folded_documents(spark, sf), low="_low")
    return m.select("id", *[F.col(c).alias(rule[0].replace(".", "_")) for c, rule in zip(MATCHES, L.GUARDRAILS)], F.col(ACTIVE).alias("active"))


@query(O.RULES_DOCUMENTS + """ SELECT id, cat AS category, urg AS urgency, esc AS escalate, array_to_string(rs, '|') AS reasons, uwhy AS urgency_reason, array_to_string(usig, '|') AS signals, array_to_string(hits, '|') AS hits,
array_to_string(ovr, '|') AS overrides, queue, escalation_queue FROM d""")
def apply_guardrails(spark, sf):
    x = F.col("extraction")
    return decide(D.document_tickets(spark, sf)).select(
        "id", x["category"].alias("category"), x["urgency"].alias("urgency"), x["escalate"].alias("escalate"), join(x["escalation_reasons"]).alias("reasons"), x["urgency_reason"].alias("urgency_reason"),
        join(x["urgency_signals"]).alias("signals"), hits_text(F.col("rule_hits")).alias("hits"), join(F.col("overrides")).alias("overrides"), "queue", "escalation_queue",
    )


@query(_A + """ SELECT akey AS id, CASE WHEN a_cat = 'spam' AND a_conf >= 0.8 THEN false ELSE a_esc END AS escalate, CASE WHEN a_cat = 'spam' AND a_conf >= 0.8 THEN '' ELSE array_to_string(a_rs, '|') END AS reasons,
CASE WHEN a_cat = 'spam' AND a_conf >= 0.8 THEN 'low' ELSE a_urg END AS urgency FROM ans WHERE NOT a_failed""", name="suppress_spam")
def suppress_spam_query(spark, sf):
    x = F.col("extraction")
    a = D.answers(spark, sf).where(x.isNotNull())
    s = suppress_spam(x["category"], x["category_confidence"], x["escalate"], x["escalation_reasons"], x["urgency"])
    return a.select(F.col("ticket_key").alias("id"), s.alias("s")).select("id", "s.escalate", join(F.col("s.reasons")).alias("reasons"), "s.urgency")


@query(f"""WITH e AS (SELECT event_id AS id, ({O.lst(L.URGENCIES)})[event_id % 4 + 1] AS a, ({O.lst(L.URGENCIES)})[user_id % 4 + 1] AS b FROM events) SELECT id, CAST(list_position({O.lst(L.URGENCIES)}, a) - 1 AS INTEGER) AS rank_a,
({O.lst(L.URGENCIES)})[greatest(list_position({O.lst(L.URGENCIES)}, a), list_position({O.lst(L.URGENCIES)}, b))] AS higher FROM e""")
def urgency_order(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("id"), D.pick(L.URGENCIES, F.col("event_id") % 4).alias("a"), D.pick(L.URGENCIES, F.col("user_id") % 4).alias("b"))
    return e.select("id", ordinal.urgency_rank(F.col("a")).alias("rank_a"), ordinal.max_urgency(F.col("a"), F.col("b")).alias("higher"))


@query(_A + f" SELECT akey AS id, round({O.cost_sql('a_model', 'tin', 'tcached', 'tout')}, 10) AS cost_usd, {O.usd6_sql(O.micro_sql('a_model', 'tin', 'tcached', 'tout'))} AS backfilled FROM ans")
def cost_usd(spark, sf):
    u, m = F.col("usage"), F.col("model")
    return D.answers(spark, sf).select(F.col("ticket_key").alias("id"), r(pricing.cost_usd(u, m), 10).alias("cost_usd"), pricing.backfill_cost(u, m).alias("backfilled"))


@query(f"{_A}, {_FINALS} SELECT akey AS id, tin + f_in AS input_tokens, tout + f_out AS output_tokens, tcached + f_cached AS cached_tokens FROM ans JOIN fin ON akey = fkey")
def merge_usage(spark, sf):
    a = D.answers(spark, sf).select("ticket_key", F.col("usage").alias("first"))
    b = _finals(spark, sf).select("ticket_key", F.col("usage").alias("second"))
    u = pricing.merge_usage(F.col("first"), F.col("second"))
    return a.join(b, "ticket_key").select(F.col("ticket_key").alias("id"), u.alias("u")).select(
        "id", "u.input_tokens", "u.output_tokens", F.col("u.cache_read_input_tokens").alias("cached_tokens")
    )


@query(_A + " SELECT akey AS id, round(a_conf + round(1 - a_conf, 1), 6) AS share, true AS sums_to_one FROM ans WHERE NOT a_failed")
def alternatives_share(spark, sf):
    x = F.col("extraction")
    a = D.answers(spark, sf).where(x.isNotNull())
    return a.select(
        F.col("ticket_key").alias("id"), r(labels.alternatives_share(x["category_confidence"], x["category_alternatives"])).alias("share"),
        labels.shares_sum_to_one(x["category_confidence"], x["category_alternatives"]).alias("sums_to_one"),
    )


@query("""SELECT doc_id AS id, array_to_string(list_sort([lang, source]), ', ') AS sorted, array_to_string(CASE WHEN list_contains([lang, source], 'en') THEN [lang, source] ELSE [lang, source, 'en'] END, '|') AS appended,
lang = 'en' OR source = 'en' AS has_en FROM documents""")
def array_helpers(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("v"))
    en = F.array(F.lit("en"))
    return d.select("id", text.sorted_join(F.col("v")).alias("sorted"), join(text.append_absent(F.col("v"), en)).alias("appended"), text.contains_all(F.col("v"), en).alias("has_en"))


@query("SELECT event_id AS id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS at FROM events")
def utc_iso_millis(spark, sf):
    return D.table(spark, sf, "events").select(F.col("event_id").alias("id"), labels.utc_iso_millis(F.col("ts")).alias("at"))


# --- streaming and the classifier hook -------------------------------------------------------


def _stream_folder(spark, sf, name: str) -> str:
    path = scratch_path(spark, name)
    D.order_tickets(spark, sf).withColumnRenamed("id", "decision_id").write.json(path)
    return path


def _stream(spark, sf, name: str) -> DataFrame:
    return intake.stream_decide(
        intake.stream_tickets(spark, _stream_folder(spark, sf, name), also=("received_at", "decision_id"))
    )


@query(O.RULES_ORDERS + " SELECT id, source, external_id, cat AS category, urg AS urgency, esc AS escalate, queue FROM d")
def stream_decide(spark, sf):
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    decided = _stream(spark, sf, "stream-in")
    x = F.col("extraction")
    flat = decided.select(
        "id", "ticket.source", "ticket.external_id", x["category"].alias("category"), x["urgency"].alias("urgency"), x["escalate"].alias("escalate"), "queue"
    )
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(O.RULES_ORDERS + _FIRST.format("id, source, external_id, queue", "d"))
def stream_record(spark, sf):
    out, ckpt = scratch_path(spark, "stream-ledger"), scratch_path(spark, "stream-ckpt")
    intake.stream_record(_stream(spark, sf, "stream-in"), out, ckpt).awaitTermination()
    return intake.read_stream_ledger(spark, out).select("id", "source", "external_id", "queue")


_MIXED = """SELECT 'D-' || doc_id AS external_id, md5(text) AS body, CASE WHEN length(text) > 20000 THEN 'text is longer than 20000 characters' END AS problem FROM documents
UNION ALL SELECT NULL, md5({0}), CASE WHEN length({0}) > 20000 THEN 'text is longer than 20000 characters' END FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT NULL, NULL, 'not JSON' FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT NULL, NULL, 'text is not a string' FROM documents WHERE doc_id % 10 = 2"""


def _mixed_folder(spark, sf) -> str:
    """Every document as an object line; of each ten ids one more as a plain string, one as a broken line, one as an object without a text."""
    path = scratch_path(spark, "mixed-in")
    d = D.dealt(D.table(spark, sf, "documents").select("doc_id", "text"))
    turn = F.col("doc_id") % 10
    name = F.concat(F.lit("D-"), F.col("doc_id").cast("string"))
    quoted = F.to_json(F.array("text"))
    more = F.when(turn == 0, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).when(turn == 1, F.lit('{"text": "cut')).when(turn == 2, F.lit('{"text": [1]}'))
    lines = F.array_compact(F.array(F.to_json(F.struct("text", name.alias("id"))), more))
    d.select(F.explode(lines).alias("value")).write.text(path)
    return path


@query(_MIXED.format(O.strip("text")))
def stream_quarantine(spark, sf):
    """Accepted and quarantined rows of one stream, which together are its lines."""
    tickets_in = intake.stream_tickets(spark, _mixed_folder(spark, sf))
    out, ckpt = scratch_path(spark, "stream-both"), scratch_path(spark, "stream-ckpt")
    bad = intake.stream_quarantine(tickets_in).select("external_id", F.md5("text").alias("body"), "problem")
    ok = intake.stream_decide(tickets_in).select("ticket.external_id", F.md5("ticket.text").alias("body"), F.lit(None).cast("string").alias("problem"))
    ok.unionByName(bad).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT external_id, body, problem, true AS own_id FROM ({_MIXED.format(O.strip('text'))})")
def stream_intake(spark, sf):
    """The ledger and the quarantine after following a folder that mixes good and bad lines."""
    ledger_path, bad_path, ckpt = (scratch_path(spark, n) for n in ("intake-ledger", "intake-bad", "intake-ckpt"))
    intake.stream_intake(intake.stream_tickets(spark, _mixed_folder(spark, sf)), ledger_path, bad_path, ckpt).awaitTermination()
    kept = intake.read_stream_ledger(spark, ledger_path)
    ids = kept.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    good = kept.join(ids, "id").select("external_id", F.md5("ticket_text").alias("body"), F.lit(None).cast("string").alias("problem"), (F.col("_n") == 1).alias("own_id"))
    return good.unionByName(spark.read.parquet(bad_path).select("external_id", F.md5("text").alias("body"), "problem", F.lit(True).alias("own_id")))


def _copies(lines: DataFrame, path: str, times: int) -> int:
    """Append ``times`` equal copies of ``lines`` to the text folder ``path``, each written by all cores and compressed; the number of files of one copy.

    Later copies are written from the files of the first, one task a file, and are newer, so a stream that takes that many files a trigger reads
    about one copy a batch; its rows do not depend on where the batches part.
    """
    spark = lines.sparkSession
    D.dealt(lines).write.option("compression", "gzip").text(path)
    files = spark.read.text(path).inputFiles()
    for _ in range(times - 1):
        spark.read.text(files).write.mode("append").option("compression", "gzip").text(path)
    return max(len(files), 1)


@query(f"SELECT md5({O.strip('text')}) AS body, 3 * count(*) AS copies, 3 * count(*) AS ids FROM documents WHERE length({O.strip('text')}) BETWEEN 1 AND 20000 GROUP BY ALL")
def stream_repeats(spark, sf):
    """Every document as a plain line, in three micro-batches that say the same: each line is a row with an id of its own."""
    path = scratch_path(spark, "repeats-in")
    quoted = F.to_json(F.array("text"))
    lines = D.table(spark, sf, "documents").select(F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("value"))
    each = _copies(lines, path, 3)
    ledger_path, bad_path, ckpt = (scratch_path(spark, n) for n in ("repeats-ledger", "repeats-bad", "repeats-ckpt"))
    intake.stream_intake(intake.stream_tickets(spark, path, files_per_trigger=each), ledger_path, bad_path, ckpt).awaitTermination()
    rows = intake.read_stream_ledger(spark, ledger_path).groupBy(F.md5("ticket_text").alias("body"))
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("id").alias("ids"))


@query(O.RULES_ORDERS + " SELECT name, count(*) AS count FROM (SELECT queue AS name FROM d UNION ALL SELECT escalation_queue FROM d WHERE escalation_queue IS NOT NULL) GROUP BY name")
def stream_queue_depths(spark, sf):
    out, ckpt = scratch_path(spark, "stream-depths"), scratch_path(spark, "stream-ckpt")
    counts = intake.stream_queue_depths(_stream(spark, sf, "stream-in"))
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"""SELECT conv_id || '-' || turn AS id, CASE WHEN length(text) % 10 > 0 THEN ({O.lst(L.CATEGORIES)})[length(text) % 8 + 1] END AS category, CASE WHEN length(text) % 10 > 0 THEN 'stub' END AS model,
CASE WHEN length(text) % 10 > 0 THEN length(text) END AS input_tokens, CASE WHEN length(text) % 10 = 0 THEN 'ValueError: no parsed output' END AS error FROM conversations""", name="classify_with")
def classify_with_query(spark, sf):
    categories = list(L.CATEGORIES)

    def make():
        def classify(body: str):
            if len(body) % 10 == 0:
                raise ValueError("no parsed output")
            return {"category": categories[len(body) % 8], "urgency": "low", "escalate": False}, {"model": "stub", "input_tokens": len(body)}

        return classify

    a = classify_with(_turns(spark, sf).withColumnRenamed("id", "ticket_key"), make)
    return a.select(F.col("ticket_key").alias("id"), F.col("extraction.category").alias("category"), "model", F.col("usage.input_tokens").alias("input_tokens"), "error")
