import json

import pytest
from pyspark.sql import functions as F

from triagegrid.operators import ledger
from triagegrid.operators.decide import decide
from triagegrid.sources import decisions as S
from triagegrid.sources import labelled, tickets


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    data = body if isinstance(body, bytes) else body.encode()
    (folder / name).write_bytes(data)
    return str(folder)


def rows(df):
    return sorted((r["text"], r["external_id"]) for r in df.collect())


def test_json_array_mixes_strings_and_objects(spark, tmp_path):
    body = json.dumps(["  plain ", {"text": "obj", "id": 7}, {"text": "b", "external_id": "x", "id": 1, "source": "crm"}, {"note": 1}, 5, {"text": 9}])
    got = tickets.read_tickets_json(spark, put(tmp_path / "j", "a.json", body)).collect()
    assert {(r["text"], r["external_id"], r["read_error"]) for r in got} == {
        ("plain", None, None), ("obj", "7", None), ("b", "x", None), (None, None, "text is not a string"),
    }
    assert {r["source"] for r in got} == {"upload:a.json", "crm"}
    assert {r["ordinal"] for r in got} == {0}


def test_json_that_is_no_array_is_quarantined(spark, tmp_path):
    folder = put(tmp_path / "j", "bad.json", "{not json")
    put(tmp_path / "j", "object.json", '{"a": "b"}')
    ok, bad = tickets.normalise_tickets(tickets.read_tickets_json(spark, folder))
    assert ok.count() == 0 and bad.where(F.col("problem") == "not a JSON array of tickets").count() == 2


def test_jsonl_skips_blank_lines_and_keeps_bad_ones_apart(spark, tmp_path):
    folder = put(tmp_path / "l", "a.jsonl", '{"text": "one", "id": 3}\n\n"two"\nnot json\n')
    ok, bad = tickets.normalise_tickets(tickets.read_tickets_jsonl(spark, folder))
    assert rows(ok) == [("one", "3"), ("two", None)]
    assert [r["problem"] for r in bad.collect()] == ["not JSON"]


def test_csv_keeps_quoted_breaks_and_doubled_quotes(spark, tmp_path):
    folder = put(tmp_path / "c", "t.csv", 'id,text\n1,"Two\nlines, ""quoted"""\n2,plain\n')
    assert rows(tickets.read_tickets_csv(spark, folder)) == [('Two\nlines, "quoted"', "1"), ("plain", "2")]


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    put(tmp_path / "c", "a.csv", "id,text\n1,first ticket\n")
    put(tmp_path / "c", "b.csv", "text,id,source\nsecond ticket,2,crm\n")
    put(tmp_path / "c", "c.csv", "id,text\n3,third ticket\n")
    folder = put(tmp_path / "c", "d.csv", "id,body\n4,no text here\n")
    ok, bad = tickets.normalise_tickets(tickets.read_tickets_csv(spark, folder))
    assert rows(ok) == [("first ticket", "1"), ("second ticket", "2"), ("third ticket", "3")]
    assert [(r["source"], r["problem"]) for r in bad.collect()] == [("upload:d.csv", "a ticket CSV needs a 'text' column")]


def test_ids_are_distinct_and_do_not_depend_on_splits(spark, tmp_path):
    folder = put(tmp_path / "l", "a.jsonl", '"same"\n' * 40 + '{"text": "keyed", "id": 1}\n' + '"other"\n' * 3)
    seen = []
    for size in ("64m", "100"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            seen.append(sorted(r["id"] for r in decide(tickets.read_tickets_jsonl(spark, folder)).select("id").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] and len(set(seen[0])) == 44


def test_text_blocks(spark, tmp_path):
    folder = put(tmp_path / "t", "t.txt", b"The export is broken.\n\n\n \n\nRefund invoice #1 please. \xff\n")
    got = sorted(r["text"] for r in tickets.read_tickets_text(spark, folder).collect())
    assert got == ["Refund invoice #1 please. �", "The export is broken."]


def test_folder_picks_reader_by_suffix(spark, tmp_path):
    d = tmp_path / "mix"
    put(d, "a.JSON", '["from json"]')
    put(d, "b.jsonl", '{"text": "from lines", "id": "L"}\n')
    put(d, "c.csv", "id,text\n9,from csv\n")
    folder = put(d, "d.log", "from text\n\nmore text")
    got = tickets.read_tickets(spark, folder)
    assert rows(got.fillna("", ["external_id"])) == [("from csv", "9"), ("from json", ""), ("from lines", "L"), ("from text", ""), ("more text", "")]


def test_normalise_bounds_and_keys(spark):
    raw = spark.createDataFrame(
        [("a" * 20000, None, "", "i1"), ("a" * 20001, "s", "e", "i2"), ("", "s", "e", "i3"), (None, "s", None, None)],
        "text string, source string, external_id string, id string",
    )
    ok, bad = tickets.normalise_tickets(raw)
    assert [(r["source"], r["external_id"]) for r in ok.collect()] == [("api", "i1")]
    assert sorted(r["problem"] for r in bad.collect()) == ["text is empty", "text is longer than 20000 characters", "text is missing"]


def test_labelled_probe_fixture_and_results(spark, tmp_path):
    gold = put(tmp_path / "g", "g.jsonl", '{"id": "g1", "group": "a", "text": "t", "expected": {"category": "bug", "urgency": "low", "escalate": false, "customer_confidence": [0.2, 1]}, "ambiguous": ["urgency"]}\n\n')
    row = labelled.read_labelled(spark, gold).collect()
    assert len(row) == 1 and row[0]["expected"]["customer_confidence"] == [0.2, 1.0]
    fixture = put(tmp_path / "f", "f.json", '[{"id": 1, "text": "a"}, {"id": "x", "text": "b"}]')
    assert rows(labelled.read_fixture_tickets(spark, fixture, "demo")) == [("a", "1"), ("b", "x")]
    results = put(tmp_path / "r", "r.json", '[{"model": "m", "n": 3, "summary": {"missed_escalations": ["a"]}, "cost_per_ticket": 0.01, "wall": NaN}]')
    assert labelled.bakeoff_results(spark, results).collect()[0]["summary"]["missed_escalations"] == ["a"]


def recorded(tmp_path):
    one = {
        "id": "abc", "created_at": "2026-01-02T03:04:05.678+00:00", "ticket": {"text": "hi", "source": "s", "external_id": "e"}, "mode": "llm",
        "model": "gpt-5-mini-2025-08-07", "rule_hits": [], "overrides": [], "queue": "bug", "latency_ms": 5, "error": None,
        "extraction": {"category": "bug", "urgency": "low", "escalate": False, "escalation_reasons": [], "customer": {"name": None, "confidence": 0.0, "basis": []}},
        "usage": {"input_tokens": 3000, "cache_read_input_tokens": 2000, "output_tokens": 500},
    }
    return put(tmp_path / "rec", "s.json", json.dumps({"set": "s", "decisions": [one, {**one, "id": "abd", "usage": {}, "model": None, "ticket": {"text": "yo", "source": "s", "external_id": "f"}}]}))


def test_replay_restates_prices_and_is_idempotent(spark, tmp_path):
    old = S.read_recorded_set(spark, recorded(tmp_path))
    now = F.lit("2026-05-01").cast("timestamp")
    again = ledger.replay_decisions(old, "s", now)
    got = {r["ticket"]["external_id"]: r for r in again.collect()}
    assert got["e"]["ticket"]["source"] == "recorded:s" and got["e"]["mode"] == "llm" and got["e"]["id"] != "abc"
    assert got["e"]["usage"]["cost_usd"] == pytest.approx(0.0013, abs=1e-9) and got["f"]["usage"]["cost_usd"] is None
    path = str(tmp_path / "ledger")
    S.write_decisions(again, path)
    S.write_decisions(again, path)
    S.write_decisions(ledger.replay_decisions(old, "s", F.lit("2026-06-01").cast("timestamp")), path)
    stored = S.read_ledger(spark, path)
    assert stored.count() == 2
    assert {r["ticket"]["external_id"] for r in S.hydrate(stored).collect()} == {"e", "f"}


def test_decision_round_trip_is_whole(spark):
    t = spark.createDataFrame([("Our CEO asks about invoice #12345 from Vega Labs, due today.", "s", "e")], "text string, source string, external_id string")
    d = decide(t, now=F.lit("2026-01-01 00:00:00.123").cast("timestamp"))
    back = d.select(S.decision_from_json(S.decision_to_json(F.struct(*d.columns))).alias("d")).select("d.*")
    a, b = d.collect()[0].asDict(True), back.collect()[0].asDict(True)
    assert a == b
    event = json.loads(S.decision_events(d).collect()[0]["value"])
    assert set(event) == {
        "event", "id", "mode", "category", "urgency", "escalate", "reasons", "queue", "escalation_queue", "rule_hits", "overrides", "latency_ms", "usage",
    }


def test_lines_are_parsed_once_however_often_a_decision_reads_them(spark):
    lines = spark.createDataFrame([('{"text": "Invoice #7 was charged twice", "external_id": "a"}',), ("not json",)], "value string")
    read = tickets.tickets_from_lines(lines, F.lit("api"))
    ok, _ = tickets.normalise_tickets(read)

    def fields_read(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("variant_get")

    assert fields_read(decide(ok)) == fields_read(read)
    assert [r.text for r in ok.collect()] == ["Invoice #7 was charged twice"]
