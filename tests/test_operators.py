import hashlib
import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagegrid.functions import pricing
from triagegrid.functions.labels import decision_id
from triagegrid.operators import cascade, costs, ledger, routing, scoring, stability
from triagegrid.operators.classify import classify_with
from triagegrid.operators.decide import decide
from triagegrid.schema import ANSWER
from triagegrid.streaming import intake

LEDGER = "id string, created_at timestamp, source string, external_id string"


def at(minute):
    return datetime(2026, 1, 1, 0, minute)


def test_ledger_first_writer_wins_and_null_keys_stay(spark):
    old = spark.createDataFrame([("a", at(1), "crm", "1"), ("n", at(1), "crm", None)], LEDGER)
    new = spark.createDataFrame(
        [("b", at(2), "crm", "1"), ("c", at(3), "crm", "2"), ("d", at(2), "crm", "2"), ("e", at(2), "web", "1"), ("m", at(2), "crm", None), ("o", at(2), "crm", None)], LEDGER
    )
    after, winners = ledger.record(new, old)
    assert sorted(r["id"] for r in after.collect()) == ["a", "d", "e", "m", "n", "o"]
    assert {(r["submitted_id"], r["id"], r["discarded"]) for r in winners.collect()} == {
        ("b", "a", True), ("c", "d", True), ("d", "d", False), ("e", "e", False), ("m", "m", False), ("o", "o", False)
    }
    # However a key's submissions are dealt, the outcome is the same.
    assert {tuple(r) for r in ledger.authoritative(new, old, salts=1).collect()} == {tuple(r) for r in winners.collect()}
    again, _ = ledger.record(new.where("external_id is not null"), after)
    assert again.count() == 6
    assert sorted(r["id"] for r in ledger.new_tickets(new, old).collect()) == ["c", "d", "e", "m", "o"]
    check = ledger.reconcile(old, after, winners.where("not discarded").select("id")).collect()[0]
    assert check["exact"] and check["added"] == 4


def test_ledger_reads(spark):
    df = spark.createDataFrame([("a", at(1), "s", "1"), ("b", at(5), "s", "1"), ("c", at(5), None, "1")], LEDGER)
    assert [r["id"] for r in ledger.latest_by_key(df.where("source = 's'")).collect()] == ["b"]
    assert [r["id"] for r in ledger.dedupe_earliest(df.where("source = 's'")).collect()] == ["a"]
    assert [r["id"] for r in ledger.keep_source(df, "s").collect()] == ["a", "b"] and ledger.keep_source(df).count() == 0
    queued = df.withColumn("queue", F.lit("q")).withColumn("escalation_queue", F.lit(None).cast("string"))
    assert [r["id"] for r in ledger.list_recent(queued, 2, "q").collect()] == ["c", "b"]


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(40000).select(
        F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id")).alias("created_at"), F.lit("s").alias("source"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("external_id"),
    )
    plan = ledger.dedupe_earliest(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    got = ledger.dedupe_earliest(df)
    assert got.count() == 20001 and got.where("external_id = 'hot'").collect()[0]["id"] == "0"


def test_filters_do_not_repeat_patterns(spark):
    t = spark.createDataFrame([("x", "s", "e")], "text string, source string, external_id string")
    d = decide(t).where("queue = 'human-review' and ticket.source = 's'").select("id")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ransomware") <= 2  # the pattern and its piece


def test_equal_tickets_without_key_get_their_own_ids(spark):
    rows = spark.range(3).select(F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("external_id"), F.col("id").alias("ordinal"))
    now = F.lit("2026-01-01").cast("timestamp")
    ids = [r["id"] for r in decide(rows, now=now).collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(r["id"] for r in decide(rows, now=now).collect())
    one = spark.range(1).select(decision_id(F.lit("a:b"), F.lit("c")).alias("x"), decision_id(F.lit("a"), F.lit("b:c")).alias("y")).collect()[0]
    assert one["x"] != one["y"]


def test_routing(spark):
    cases = [
        ("billing", "critical", False, 0.9, "billing-oncall", None), ("bug", "low", False, 0.5, "engineering-triage", None),
        ("other", "low", False, 0.3, "human-review", None), ("other", "low", True, 0.3, "general-support", "human-escalation-desk"),
        ("unheard-of", "critical", False, 0.9, "general-support", None), ("security", "high", True, 0.8, "security-incident-response", "human-escalation-desk"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "category string, urgency string, escalate boolean, category_confidence double")
    got = {tuple(r) for r in routing.route(df).collect()}
    assert got == set(cases)
    depths = {r["name"]: r["count"] for r in routing.queue_depths(routing.route(df)).collect()}
    assert len(depths) == 12 and depths["human-escalation-desk"] == 2 and depths["spam-review"] == 0


def test_prices(spark):
    u = F.struct(F.lit(2786).alias("input_tokens"), F.lit(2607).alias("cache_read_input_tokens"), F.lit(859).alias("output_tokens"))
    names = ["gpt-5-2025-08-07", "gpt-5-mini-2025-08-07", "gpt-5-nano", "elsewhere", None]
    df = spark.createDataFrame([(n,) for n in names], "model string").select("model", pricing.cost_usd(u, F.col("model")).alias("usd"))
    usd = {r["model"]: r["usd"] for r in df.collect()}
    assert round(usd["gpt-5-2025-08-07"] * 100, 3) == 0.914
    assert usd["gpt-5-nano"] < usd["gpt-5-mini-2025-08-07"] < usd["gpt-5-2025-08-07"] == usd["elsewhere"] == usd[None]
    card = costs.rate_card(spark)
    matched = {r["model"]: r["prefix"] for r in costs.price_match(df, card).collect()}
    assert matched == {"gpt-5-2025-08-07": "gpt-5", "gpt-5-mini-2025-08-07": "gpt-5-mini", "gpt-5-nano": "gpt-5-nano", "elsewhere": "gpt-5", None: "gpt-5"}


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 100, 1500])
def test_latency_follows_the_index_rule(spark, n):
    values = [(i * 7919) % 5003 for i in range(n)]
    got = costs.latency_profile(spark.createDataFrame([(v,) for v in values], "latency_ms long")).collect()[0]
    lat = sorted(values)
    want = (n, lat[n // 2], lat[int(n * 0.95) - 1], lat[int(n * 0.99) - 1], lat[-1])
    assert (got["n"], got["p50"], got["p95"], got["p99"], got["max_ms"]) == want
    assert got["mean_ms"] == pytest.approx(sum(values) / n)


def extraction(**kw):
    base = dict(
        customer=dict(name=None, contact_name=None, identifiers=[], best_guess=None, confidence=0.0, basis=[]), customer_reason="r", category="bug",
        category_confidence=0.9, category_reason="r", category_alternatives=[], urgency="medium", urgency_signals=[], urgency_reason="", escalate=False,
        escalation_reasons=[], escalation_reason_text="r", summary="s", rationale="r",
    )
    return {**base, **kw}


def usage(i, o, c=0):
    return dict(input_tokens=i, output_tokens=o, cache_read_input_tokens=c)


def answers(spark, rows):
    schema = T.StructType(ANSWER.fields)
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


TICKETS = [
    ("k1", "Our attorney will sue."), ("k2", "A former employee logged in this morning."), ("k3", "Our CEO wants an update."), ("k4", "The export gives a 500."),
    ("k5", "Our VP wants a call."), ("k6", "nothing special"),
]


def test_answers_fall_back_when_unusable(spark):
    t = spark.createDataFrame([(k, x, "s", k) for k, x in TICKETS], "ticket_key string, text string, source string, external_id string")
    a = answers(spark, [
        dict(ticket_key="k1", model="mock", extraction=extraction(), usage=usage(1, 1), latency_ms=7, error=None),
        dict(ticket_key="k2", model="mock", extraction=extraction(category="security", urgency="critical", escalate=True, escalation_reasons=["security_incident"], customer=dict(name="Vega", identifiers=[], confidence=1.0, basis=["x"])), usage=usage(1, 1)),
        dict(ticket_key="k3", error="APIConnectionError: gone"),
        dict(ticket_key="k4", model="mock", extraction=extraction(category="ninth"), usage=usage(5, 5)),
        dict(ticket_key="k5", model="mock", extraction={**extraction(), "summary": None}),
    ])
    d = {r["ticket"]["external_id"]: r for r in decide(t, a).collect()}
    assert d["k1"]["mode"] == "llm" and not d["k1"]["llm_extraction"]["escalate"] and d["k1"]["extraction"]["escalate"]
    assert d["k1"]["extraction"]["urgency"] == "high" and d["k1"]["latency_ms"] == 7 and d["k1"]["usage"]["cost_usd"] > 0
    assert d["k2"]["overrides"] == [] and [h["effect"] for h in d["k2"]["rule_hits"]] == ["confirmed model decision"] and d["k2"]["extraction"]["customer"]["name"] == "Vega"
    assert d["k3"]["mode"] == "llm_fallback_rules" and "APIConnectionError" in d["k3"]["error"] and d["k3"]["extraction"]["escalate"]
    assert d["k4"]["extraction"]["category"] == "bug" and "ValidationError" in d["k4"]["error"] and d["k4"]["model"] is None
    assert "summary" in d["k5"]["error"] and d["k6"]["error"].startswith("ValueError")


def test_draft_cascade_reports_both_prices(spark):
    draft = answers(spark, [
        dict(ticket_key="a", model="gpt-5-mini", extraction=extraction(escalate=True), usage=usage(1000, 500), latency_ms=1),
        dict(ticket_key="b", model="gpt-5-mini", extraction=extraction(), usage=usage(1000, 500), latency_ms=1),
        dict(ticket_key="c", model="gpt-5-mini", extraction=extraction(category_confidence=0.4), usage=usage(1000, 500), latency_ms=1),
    ])
    final = answers(spark, [dict(ticket_key=k, model="gpt-5", extraction=extraction(escalate=True), usage=usage(2000, 100), latency_ms=2) for k in "abc"])
    got = {r["ticket_key"]: r for r in cascade.cascade_by_draft(draft, final).collect()}
    assert [got[k]["usage"]["cascade"]["reread"] for k in "abc"] == [True, False, True]
    assert [got[k]["usage"]["cascade"]["changed"] for k in "abc"] == [False, None, True]
    a = got["a"]["usage"]
    assert a["input_tokens"] == 3000 and a["cost_usd"] == pytest.approx((3000 * 1.25 + 600 * 10) / 1e6)
    assert a["cost_usd_by_reader"] == pytest.approx((1000 * 0.25 + 500 * 2 + 2000 * 1.25 + 100 * 10) / 1e6)
    rep = cascade.cascade_report(cascade.cascade_by_draft(draft, final), final).collect()[0]
    assert (rep["n"], rep["reread"], rep["changed"]) == (3, 2, 1) and rep["saving_by_reader"] > rep["saving"]


def test_scorecard_of_nothing_to_escalate(spark):
    gold = spark.createDataFrame([("a", "g", ("bug", "low", False, None, None, None, None), ["urgency"])], "id string, group string, expected struct<category:string,urgency:string,escalate:boolean,customer_name:string,reasons:array<string>,identifier_contains:string,customer_confidence:array<double>>, ambiguous array<string>")
    d = decide(spark.createDataFrame([("The toggle is broken.", "s", "a")], "text string, source string, external_id string"))
    card = scoring.scorecard(scoring.score(gold, d)).collect()[0]
    assert card["escalation_recall"] == 1.0 and card["urgency_over"] == 1 and card["urgency_accuracy"] == 1.0 and card["confidence_calibration"] == 0.0
    scoring.require_coverage(gold, d)
    with pytest.raises(ValueError, match="does not cover"):
        scoring.require_coverage(gold, d.where("false"))


def runs(spark, values):
    d = "struct<extraction:struct<customer:struct<name:string,best_guess:string,confidence:double>,category:string,category_confidence:double,category_reason:string,urgency:string,escalate:boolean,escalation_reasons:array<string>>,queue:string,escalation_queue:string,mode:string>"
    rows = [("t", i, ((("V", None, 1.0), c, p, "w", "low", False, []), "q", None, "llm")) for i, (c, p) in enumerate(values)]
    return spark.createDataFrame(rows, f"ticket_key string, run int, decision {d}")


def test_ties_take_the_value_seen_first(spark):
    r = runs(spark, [("spam", 0.5), ("bug", 0.6), ("bug", 0.7), ("spam", 0.8)])
    row = stability.consistency(r).where("field = 'category'").collect()[0]
    assert (row["most_common"], row["same"], row["runs"], row["flipped"]) == ("spam", 2, 4, True)
    a = stability.agreement(r).collect()[0]
    assert a["sd_confidence"] == pytest.approx(math.sqrt(sum((x - 0.65) ** 2 for x in (0.5, 0.6, 0.7, 0.8)) / 3))
    n = stability.consistency_numbers(r).where("field = 'category confidence'").collect()[0]
    assert (n["spread"], n["sd"]) == (0.3, 0.112)
    same = stability.agreement(runs(spark, [("bug", 0.3)] * 3)).collect()[0]
    assert same["sd_confidence"] == 0.0 and same["category_share"] == 1.0


def test_recheck_takes_every_read_and_compares_decisive_fields(spark):
    r = runs(spark, [("bug", 0.5), ("bug", 0.6), ("bug", 0.7), ("bug", 0.8), ("spam", 0.9)])
    original = r.where("run = 0").drop("run")
    fields = stability.recheck(original, r.where("run > 0"), runs=99)
    by = {x["field"]: x for x in fields.collect()}
    assert len(by) == 9 and by["category"]["values"] == ["bug", "bug", "bug", "bug", "spam"]
    assert not by["category"]["agree"] and not by["category_confidence"]["agree"] and by["urgency"]["agree"]
    assert not stability.recheck_verdict(fields).collect()[0]["stable"]
    fewer = stability.recheck(original, r.where("run > 0"), runs=3)
    assert {x["field"]: len(x["values"]) for x in fewer.collect()}["category"] == 4
    assert stability.recheck_verdict(fewer).collect()[0]["stable"]


def test_recheck_sends_each_read_through_the_shuffle_once_not_once_per_field(spark):
    r = runs(spark, [("bug", 0.5), (None, 0.6), ("bug", 0.7)]).unionByName(runs(spark, [("spam", 0.5)]).withColumn("ticket_key", F.lit("u")))
    fields = stability.recheck(r.where("run = 0").drop("run"), r.where("run > 0"), runs=5)
    plan = fields._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and all("field" not in line for line in keys)
    by = {(x["ticket_key"], x["field"]): x for x in fields.collect()}
    assert len(by) == 18 and by[("t", "category")]["values"] == ["bug", None, "bug"] and not by[("t", "category")]["agree"]
    assert by[("t", "urgency")]["agree"] and by[("u", "category")]["values"] == ["spam"] and by[("u", "category")]["agree"]


def test_classifier_errors_become_data(spark):
    answer = extraction()

    def make():
        def classify(text):
            if "bad" in text:
                raise RuntimeError("no")
            return answer, {"model": "m", "input_tokens": 3}

        return classify

    t = spark.createDataFrame([("1", "good"), ("2", "bad")], "ticket_key string, text string")
    got = {r["ticket_key"]: r for r in classify_with(t, make).collect()}
    assert got["1"]["extraction"]["category"] == "bug" and got["1"]["usage"]["input_tokens"] == 3
    assert got["2"]["error"] == "RuntimeError: no" and got["2"]["extraction"] is None


def test_stream_keeps_the_first_decision_and_survives_a_replay(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "ckpt")
    src.mkdir()

    def drop(name, rows):
        (src / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run(checkpoint):
        intake.stream_record(intake.stream_decide(intake.stream_tickets(spark, str(src))), out, checkpoint).awaitTermination()
        return intake.read_stream_ledger(spark, out)

    drop("1.json", [{"text": "Refund invoice #77.", "source": "crm", "external_id": "T"}, {"text": "no key"}, {"text": ""}])
    assert run(ckpt).count() == 2
    drop("2.json", [{"text": "The export is down.", "source": "crm", "external_id": "T"}, {"text": "no key"}])
    after = run(ckpt)
    assert after.count() == 3
    assert after.where("external_id = 'T'").collect()[0]["category"] == "billing"
    # With another checkpoint batch numbers would start anew and repeat rows without key: refused.
    with pytest.raises(ValueError):
        run(str(tmp_path / "ckpt2"))


def test_stream_loses_no_line_and_tells_equal_ones_apart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"text": "Refund invoice #77.", "id": "T"}), json.dumps({"text": "again", "id": "T"}), '"no key"', '"no key"', json.dumps({"text": "no key"}), "{cut", json.dumps({"text": "a" * 20001}), '"  "', ""]
    (src / "1.json").write_text("\n".join(lines))
    stream = intake.stream_tickets(spark, str(src))
    paths = [str(tmp_path / n) for n in ("ledger", "bad", "ckpt")]
    intake.stream_intake(stream, *paths).awaitTermination()
    kept, bad = intake.read_stream_ledger(spark, paths[0]), spark.read.parquet(paths[1])
    assert kept.count() == 4 and kept.select("id").distinct().count() == 4
    assert sorted(r["problem"] for r in bad.collect()) == ["not JSON", "text is empty", "text is longer than 20000 characters"]
    assert all(json.loads(r["decision_json"])["id"] == r["id"] for r in kept.collect())


def test_scratch_folder_is_named_on_a_cluster(spark, monkeypatch):
    from triagegrid import session

    assert session.shared_folder(spark)

    class Cluster:
        master, applicationId = "spark://host:7077", "elsewhere"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    Cluster.folder = None
    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Cluster.folder = "hdfs://store/scratch/"
    assert session.shared_folder(Session()) == "hdfs://store/scratch"


def test_selections_by_table_and_their_count(spark):
    from triagegrid.operators import scoring

    rows = spark.createDataFrame([("a1", 1), ("a2", 2), ("b1", 3), (None, 4)], "id string, n int")
    ids = spark.createDataFrame([("a2",), ("b1",), ("zz",), (None,)], "wanted string")
    assert sorted(r["n"] for r in scoring.only_ids(rows, ids).collect()) == [2, 3]
    assert [r["n"] for r in scoring.only_ids(rows, ids, prefix="a").collect()] == [2]
    assert scoring.require_count(scoring.only_ids(rows, prefix="a"), 2).count() == 2
    with pytest.raises(ValueError):
        scoring.require_count(rows, 3)


def test_calls_are_made_side_by_side_for_the_model_asked_for(spark):
    answer = extraction()

    def make():
        import threading
        import time

        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def classify(text, model):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
            return answer, {"input_tokens": state["most"]}

        return classify

    t = spark.createDataFrame([(str(i), "x") for i in range(24)], "ticket_key string, text string").coalesce(1)
    got = classify_with(t, make, model="small", in_flight=4).collect()
    assert [r["ticket_key"] for r in got] == [str(i) for i in range(24)] and {r["model"] for r in got} == {"small"}
    assert max(r["usage"]["input_tokens"] for r in got) == 4


def test_several_runs_from_one_reading(spark):
    """Each run's rows are those that ``decide`` gives alone; patterns are in the plan once."""
    from triagegrid.operators.decide import decide_runs

    texts = ["Refund invoice #77 twice please.", "Our CEO wants this fixed right now.", "malware on our staff laptops", "hello"]
    t = spark.createDataFrame([(x, "s", f"k{i}", f"k{i}") for i, x in enumerate(texts)], "text string, source string, external_id string, ticket_key string")
    made = [(f"k{i}", "gpt-5-mini-2025-08-07", None if i == 1 else extraction(), None, 10, "late" if i == 1 else None) for i in range(3)]
    answers = spark.createDataFrame(made, ANSWER)
    now = F.lit("2026-01-01").cast("timestamp")
    both = decide_runs(t, {"words": None, "model": answers}, now=now)
    for name, given in (("words", None), ("model", answers)):
        alone = {r["id"]: r.asDict(True) for r in decide(t, given, now=now).collect()}
        mine = {r["id"]: r.asDict(True) for r in both.where(F.col("run") == name).drop("run").collect()}
        assert mine == alone and len(alone) == 4
    plan = both.select("run", "queue")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ransomware") <= 2


@pytest.mark.parametrize("batch", [5, 10000])
def test_calls_go_on_behind_a_slow_one(spark, batch):
    """One call takes as long as all others together: the two others in flight answer everything meanwhile, whatever the batches."""
    answer = extraction()

    def make():
        import time

        def classify(text):
            time.sleep(1.5 if text == "t0" else 0.05)
            return answer, {"input_tokens": 1}

        return classify

    t = spark.range(0, 60, 1, 1).select(F.concat(F.lit("k"), F.col("id")).alias("ticket_key"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        started = datetime.now()
        got = classify_with(t, make, in_flight=3).collect()
        took = (datetime.now() - started).total_seconds()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert [r["ticket_key"] for r in got] == [f"k{i}" for i in range(60)]
    assert got[0]["latency_ms"] >= 1400 and took < 12


def test_equal_texts_are_asked_once_a_task(spark):
    answer = extraction()

    def make():
        asked = []

        def classify(text):
            if text == "bad":
                raise RuntimeError("no")
            asked.append(text)
            return answer, {"input_tokens": len(asked)}

        return classify

    t = spark.createDataFrame([(str(i), ["same", "bad", "other"][i % 3]) for i in range(30)], "ticket_key string, text string").coalesce(1)
    got = classify_with(t, make, in_flight=2, ask_once=True).collect()
    assert [r["ticket_key"] for r in got] == [str(i) for i in range(30)]
    paid = [r for r in got if r["usage"] is not None]
    assert len(paid) == 2 and {r["usage"]["input_tokens"] for r in paid} == {1, 2}
    assert all(r["extraction"] is not None for r in got if r["error"] is None) and sum(r["error"] is not None for r in got) == 10


def test_stream_repeats_writes_its_copies_over_all_cores_compressed(spark, tmp_path):
    import glob

    from triagegrid.plans import registry
    from triagegrid.session import shared_folder

    texts = ["Refund invoice #77.", "Refund invoice #77.", "The export is down.", "", None, *[f"Order {i} is late." for i in range(40)]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["body"]: (r["copies"], r["ids"]) for r in registry.stream_repeats(spark, str(tmp_path)).collect()}
    want = {}
    for t in texts:
        if t:
            want[hashlib.md5(t.encode()).hexdigest()] = want.get(hashlib.md5(t.encode()).hexdigest(), 0) + 3
    assert got == {k: (n, n) for k, n in want.items()}
    folder = max(glob.glob(shared_folder(spark).removeprefix("file:") + "/repeats-in-*"), key=lambda p: __import__("os").path.getmtime(p))
    parts = [p for p in glob.glob(folder + "/part-*")]
    # Before, one task wrote each copy as one plain text file: three files for three copies.
    assert len(parts) > 3 and all(p.endswith(".gz") for p in parts)
