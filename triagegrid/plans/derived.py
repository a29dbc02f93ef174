"""Tickets, answers, labels and runs that Spark derives from the given tables.

The tables hold star-schema rows and prose without support vocabulary, so each row becomes a ticket:
a sentence of our own chosen by its key, filled with its columns, around its whole text.  Work grows
with the tables; no row is left out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.operators.routing import escalation_queue_for, queue_for
from triagegrid.operators.stability import expand_runs
from triagegrid.schema import EXTRACTION, USAGE

OPENERS = [
    "Invoice #{n} was charged twice, please refund {amt}.",
    "The export button throws a 500 error on the dashboard.",
    "Yesterday's leaver, now an ex-employee, keeps opening the vault and we can see activity there.",
    "If this is not settled our legal team will open litigation for breach of the agreement.",
    "Under GDPR we send this data subject request to your data protection officer.",
    "Our CEO and the board want an answer.",
    "Get free credits on telegram, guaranteed crypto giveaway, click here.",
    "Our CFO says unsubscribe us from these backlinks and SEO offers.",
    "I was able to see another customer's records right now.",
    "Our customers report that order {n} was billed twice.",
    "The whole checkout is down for all our users.",
    "We want to start the implementation kickoff for {seg}.",
    "Feature request: it would be great to have support for webhooks.",
    "Hello there, a quick question about nothing in particular.",
    "Please add seats to account #A-{n} on our enterprise plan.",
    "Reach me at user{n}@desk{n}.com about the renewal.",
    "Write to buyer{n}@gmail.com about the refund of {amt}.",
    "I found a sql injection vulnerability and follow responsible disclosure.",
    "Our attorney and our CTO read the MSA, this is a permissions issue.",
    "Payroll sheets were set open to anyone last night, and right now they still are.",
    "Someone phished our staff, malware was exported this morning, our lawyer and the regulator know, says the CISO.",
    "About 250 of our analysts use the workspace and the toggle resets.",
    "The team plan shows latency, 40 seats are slow.",
    "Is there a discount of {amt} for ticket #{n}?",
]
CLOSERS = [
    "",
    "No rush, whenever you get a chance.",
    "We need this by friday, it is urgent.",
    "Thanks, from {seg} Logistics",
    "- Dana Whitfield, {seg} Labs",
    "Sent on behalf of Monday Group",
    "Written at The {seg} office - Ana Ruiz, {seg} Group",
    "Reply to @{seg}Desk, ref #{n}.",
    "It is a minor thing, due today.",
    "\nA second line of the letter.  \n",
    "Call our team of 300 users.",
]
# What each opener deserves, as a label.
OPENER_CATEGORY = [
    "billing", "bug", "security", "legal_contract", "legal_contract", "other", "spam", "spam", "security", "billing", "bug",
    "onboarding", "feature_request", "other", "billing", "billing", "billing", "security", "security", "security",
    "security", "bug", "bug", "other",
]
OPENER_REASON = [
    None, None, "security_incident", "legal_threat", "compliance_request", "executive_mention", None, None, "data_exposure",
    None, None, None, None, None, None, None, None, "security_incident", "legal_threat", "data_exposure",
    "security_incident", None, None, None,
]
MODELS = ["gpt-5-2025-08-07", "gpt-5-mini-2025-08-07", "gpt-5-nano", "another-model"]
RUNS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores before tickets are made of them: each given table is one file of one row group."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def ticket_text(key: Column, amount: Column, segment: Column, body: Column | None = None) -> Column:
    opener = pick(OPENERS, key % len(OPENERS))
    closer = pick(CLOSERS, F.floor(key / len(OPENERS)) % len(CLOSERS))
    parts = [opener, closer] if body is None else [opener, body, closer]
    text = F.concat_ws(" ", *parts)
    for slot, value in (("{n}", key.cast("string")), ("{amt}", F.concat(F.lit("$"), amount)), ("{seg}", segment)):
        text = F.replace(text, F.lit(slot), value)
    return text


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = dealt(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("seg", F.initcap("c_mktsegment"))


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint").cast("string")


def order_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """A ticket per order.  Customers write often, so keys repeat; urgent orders carry no key."""
    return _orders(spark, sf).select(
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("id"),
        ticket_text(F.col("o_orderkey"), _whole(F.col("o_totalprice")), F.col("seg")).alias("text"),
        F.concat(F.lit("shop-"), F.col("o_orderstatus")).alias("source"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))).alias("external_id"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
    )


def eval_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """The same tickets, each with its own external_id."""
    return order_tickets(spark, sf).select(
        "id", "text", F.lit("eval").alias("source"), F.col("id").alias("external_id"), "received_at", F.col("id").alias("ticket_key")
    )


def document_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """A ticket per document, holding its whole text."""
    d = dealt(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return d.select(
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("id"),
        ticket_text(F.col("doc_id"), F.col("n_chars").cast("string"), F.initcap("lang"), F.col("text")).alias("text"),
        "source",
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("received_at"),
    )


def line_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """A ticket per order line, for volume."""
    l = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"))
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return l.select(
        F.concat_ws("-", F.lit("L"), "l_orderkey", "l_linenumber").alias("id"),
        ticket_text(key, _whole(F.col("l_extendedprice")), F.lit("Acme")).alias("text"),
        F.concat(F.lit("line-"), F.col("l_returnflag")).alias("source"),
        F.lit(None).cast("string").alias("external_id"),
        F.col("l_shipdate").cast("timestamp").alias("received_at"),
    )


def answers(spark: SparkSession, sf: str, gap: bool = False) -> DataFrame:
    """A model answer per order; some failed, some off the schema.  With ``gap``, orders without a priority have none."""
    o = _orders(spark, sf)
    if gap:
        o = o.where(F.col("o_orderpriority") != "4-NOT SPECIFIED")
    k = F.col("o_orderkey")
    conf = (4 + k % 7) / F.lit(10.0)
    escalate = k % 3 == 0
    reasons = F.when(escalate, F.array(pick(L.REASONS, k % 5))).otherwise(F.array().cast("array<string>"))
    named = k % 4 == 0
    fields = {
        "customer": F.struct(
            F.when(named, F.concat("seg", F.lit(" Corp"))).alias("name"),
            F.lit(None).cast("string").alias("contact_name"),
            F.array(F.concat(F.lit("#"), k.cast("string"))).alias("identifiers"),
            F.when(~named, F.lit("a shop customer")).alias("best_guess"),
            F.when(named, F.lit(1.0)).otherwise(F.lit(0.4)).alias("confidence"),
            F.array(F.lit("order reference")).alias("basis"),
        ),
        "customer_reason": F.lit("An order reference is given."),
        "category": pick([*L.CATEGORIES, "ninth-category"], k % 9),
        "category_confidence": conf,
        "category_reason": F.lit("Read as a whole."),
        "category_alternatives": F.array(
            F.struct(F.lit("other").alias("category"), F.round(1 - conf, 1).alias("confidence"), F.lit("less likely").alias("why_not"))
        ),
        "urgency": pick(L.URGENCIES, F.floor(k / 2) % 4),
        "urgency_signals": F.array(F.lit("tone")),
        "urgency_reason": F.lit("By its tone."),
        "escalate": escalate,
        "escalation_reasons": reasons,
        "escalation_reason_text": F.lit("See reasons."),
        "summary": F.lit("An order question."),
        "rationale": F.lit("Read as a whole."),
    }
    failed = (F.col("o_orderstatus") == "P") & (k % 11 == 0)
    usage = {
        "input_tokens": 1000 + k % 2000,
        "output_tokens": 200 + k % 700,
        "cache_read_input_tokens": k % 1500,
    }
    return o.select(
        F.concat(F.lit("O-"), k.cast("string")).alias("ticket_key"),
        pick(MODELS, k % 4).alias("model"),
        F.when(~failed, F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in EXTRACTION])).alias("extraction"),
        F.struct(*[usage.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in USAGE]).alias("usage"),
        (1000 + (k * 37) % 9000).alias("latency_ms"),
        F.when(failed, F.lit("APITimeoutError: Request timed out.")).alias("error"),
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """A label per order, right for most openers and deliberately off for some orders."""
    o = _orders(spark, sf)
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    opener = k % len(OPENERS)
    reason = pick(OPENER_REASON, opener)
    return o.select(
        F.concat(F.lit("O-"), k.cast("string")).alias("id"),
        priority.alias("group"),
        ticket_text(k, _whole(F.col("o_totalprice")), F.col("seg")).alias("text"),
        F.struct(
            F.when(status == "F", pick(L.CATEGORIES, k % 8)).otherwise(pick(OPENER_CATEGORY, opener)).alias("category"),
            pick(L.URGENCIES, F.floor(k / 3) % 4).alias("urgency"),
            (reason.isNotNull() != (priority == "5-LOW")).alias("escalate"),
            F.when(k % 5 == 0, F.col("seg")).alias("customer_name"),
            F.when(reason.isNotNull(), F.array(reason)).alias("reasons"),
            F.when(opener == 0, k.cast("string")).when(opener == 14, F.concat(F.lit("A-"), k.cast("string"))).alias("identifier_contains"),
            F.when(status == "O", F.array(F.lit(0.2), F.lit(0.9))).when(status == "P", F.array(F.lit(0.0), F.lit(0.3))).alias("customer_confidence"),
        ).alias("expected"),
        F.when(priority == "1-URGENT", F.array(F.lit("urgency")))
        .when(priority == "2-HIGH", F.array(F.lit("category"), F.lit("urgency")))
        .when(priority == "3-MEDIUM", F.array(F.lit("escalate")))
        .otherwise(F.array().cast("array<string>"))
        .alias("ambiguous"),
    )


def probe(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as probe rows: does a reader escalate what its status says it should?"""
    o = _orders(spark, sf)
    return o.select(
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("id"),
        (F.col("o_orderstatus") != "O").alias("expect_escalate"),
        F.lit(None).cast("string").alias("reason"),
        F.col("o_orderpriority").alias("why"),
        ticket_text(F.col("o_orderkey"), _whole(F.col("o_totalprice")), F.col("seg")).alias("text"),
    )


def repeated_runs(spark: SparkSession, sf: str, runs: int = RUNS, first: int = 0) -> DataFrame:
    """Every order read ``runs`` times by a reader whose answers move a little (ticket_key, run, decision)."""
    o = expand_runs(_orders(spark, sf), runs).withColumn("run", F.col("run") + first)
    k = F.col("o_orderkey")
    o = o.withColumn("h", (k * 31 + F.col("run") * 17) % 10)
    h = F.col("h")
    o = o.select(
        "*",
        pick(L.CATEGORIES, (k + (h < 2).cast("int")) % 8).alias("category"),
        pick(L.URGENCIES, (k + h.between(3, 4).cast("int")) % 4).alias("urgency"),
        ((k + (h == 5).cast("int")) % 3 == 0).alias("escalate"),
        ((50 + (k * 7 + F.col("run") * 13) % 45) / F.lit(100.0)).alias("confidence"),
        F.when(h != 7, F.col("seg")).alias("name"),
    )
    reasons = F.when(F.col("escalate"), F.array(pick(L.REASONS, k % 5))).otherwise(F.array().cast("array<string>"))
    return o.select(
        F.concat(F.lit("O-"), k.cast("string")).alias("ticket_key"),
        "run",
        F.struct(
            F.struct(
                F.struct(
                    "name", F.lit("a shop customer").alias("best_guess"), F.when(F.col("name").isNull(), F.lit(0.4)).otherwise(F.lit(1.0)).alias("confidence")
                ).alias("customer"),
                "category",
                F.col("confidence").alias("category_confidence"),
                F.concat(F.lit("reads like "), F.col("category")).alias("category_reason"),
                "urgency",
                "escalate",
                reasons.alias("escalation_reasons"),
            ).alias("extraction"),
            queue_for(F.col("category"), F.col("urgency"), F.col("escalate"), F.col("confidence")).alias("queue"),
            escalation_queue_for(F.col("escalate")).alias("escalation_queue"),
            F.when(h == 9, F.lit("llm_fallback_rules")).otherwise(F.lit("llm")).alias("mode"),
            F.when(h != 9, pick(MODELS, (k + F.col("run")) % 4)).alias("model"),
            (1000 + (k * 13 + F.col("run") * 7) % 5000).alias("latency_ms"),
        ).alias("decision"),
    )


def event_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows: the type is the source, the user the external id (errors carry none)."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("E-"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("external_id"),
        F.when(n % 7 == 0, F.lit("llm_fallback_rules")).when(n % 2 == 0, F.lit("llm")).otherwise(F.lit("rules")).alias("mode"),
        F.when(n % 7 == 0, F.concat(F.lit("error "), n.cast("string"))).alias("error"),
        pick(L.CATEGORIES, n % 8).alias("category"),
        pick(L.URGENCIES, F.floor(n / 8) % 4).alias("urgency"),
        (n % 5 == 0).cast("int").alias("escalate"),
        queue_for(pick(L.CATEGORIES, n % 8), pick(L.URGENCIES, F.floor(n / 8) % 4), n % 5 == 0, (n % 10) / F.lit(10.0)).alias("queue"),
        escalation_queue_for(n % 5 == 0).alias("escalation_queue"),
        F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"),
    )


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """A saved run summary per supplier."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")

    def ids(n: Column, tail: str = "") -> Column:
        made = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("t-"), i.cast("string"), F.lit(tail)))
        return F.slice(made, 1, n.cast("int"))

    return s.select(
        F.concat(F.lit("model-"), F.col("s_name")).alias("model"),
        F.when(k % 3 != 0, pick(["minimal", "low", "medium"], k % 3)).alias("effort"),
        F.struct(
            ids(k % 3).alias("missed_escalations"),
            ids(k % 5).alias("false_escalations"),
            ids(k % 6, " said low, gold high").alias("urgency_under"),
            F.concat(ids(k % 2, " said low, gold high"), ids(k % 4, " said high, gold critical")).alias("urgency_hard_under"),
        ).alias("summary"),
        F.when(k % 4 != 0, k % 7).alias("fails"),
        F.when(k % 6 != 0, 10 + k % 20).alias("must_n"),
        F.when(k % 10 != 0, F.col("s_acctbal") / F.lit(1000000.0)).alias("cost_per_ticket"),
        (30 + k % 40).alias("n"),
    )
