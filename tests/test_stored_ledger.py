"""The stored ledger: removal by copy on write, pruned lookups, newest rows, events written once; the key index of a stream."""
import json
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triagegrid.functions.labels import decision_id
from triagegrid.operators import ledger
from triagegrid.operators.decide import decide
from triagegrid.plans import derived, registry
from triagegrid.sources import decisions as S
from triagegrid.streaming import intake, keys


def decided(spark, n=60, days=6):
    """Decisions over some days; every fifth has no key, and each key but one comes once."""
    t = spark.range(n).select(
        F.concat(F.lit("d"), F.col("id")).alias("decision_id"), F.concat(F.lit("ticket "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("mail")).otherwise(F.lit("web")).alias("source"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.when(F.col("id") < n - 2, F.col("id")).otherwise(2).cast("string"))).alias("external_id"),
        F.timestamp_seconds(F.lit(1767225600) + (F.col("id") % days) * 86400 + F.col("id")).alias("received_at"),
    )
    return decide(t)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*") if "_" not in f.parent.name.split("=")[0].removeprefix("created_date")}


def ids(spark, path):
    return sorted(r["id"] for r in S.read_ledger(spark, path).select("id").collect())


def test_repeated_submissions_are_written_once(spark, tmp_path):
    path, d = str(tmp_path / "ledger"), decided(spark)
    S.write_decisions(d.unionByName(d).unionByName(d.where("ticket.external_id is null").limit(0)), path)
    kept = S.read_ledger(spark, path)
    # Rows without a key are each a submission; rows of one key are one, however often they were sent.
    assert kept.where("external_id is not null").count() == kept.select("source", "external_id").where("external_id is not null").distinct().count()
    assert kept.where("external_id is null").count() == 24
    before = ids(spark, path)
    S.write_decisions(d.where("ticket.external_id is not null"), path)
    assert ids(spark, path) == before


def test_one_decision_goes_and_other_files_stay(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.write_decisions(decided(spark), path)
    before, held = files(path), ids(spark, path)
    assert S.remove_decision(spark, path, "d7") == 1 and S.remove_decision(spark, path, "d7") == 0 and S.remove_decision(spark, path, "unknown") == 0
    after = files(path)
    assert ids(spark, path) == [i for i in held if i != "d7"]
    assert len(before.keys() - after.keys()) == 1 and all(after[f] == before[f] for f in after.keys() & before.keys())
    assert not os.path.exists(f"{path}/{S.REMOVALS}")


def test_a_ledger_is_cleared_but_for_a_source(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.write_decisions(decided(spark, 60, 2), path)
    kept = sorted(r["id"] for r in S.read_ledger(spark, path).where("source = 'mail'").collect())
    untouched = files(f"{path}/created_date=2026-01-01")  # even rows only: all of this source
    S.clear_ledger(spark, path, "mail")
    assert ids(spark, path) == kept and files(f"{path}/created_date=2026-01-01") == untouched
    assert S.clear_ledger(spark, path, "mail") == 0
    S.clear_ledger(spark, path)
    assert ids(spark, path) == [] and S.recent_decisions(spark, path, 5).count() == 0
    S.write_decisions(decided(spark), path)
    assert len(ids(spark, path)) > 50


@pytest.mark.parametrize("step", ["before the list", "after the list", "half moved"])
def test_an_interrupted_removal_is_finished_or_undone(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "ledger")
    S.write_decisions(decided(spark), path)
    held = ids(spark, path)
    with monkeypatch.context() as m:
        m.setattr(S, "resume_removals", lambda *a: None)
        S.remove_decision(spark, path, "d7")
    work = next(Path(path, S.REMOVALS).iterdir())
    if step == "before the list":
        (work / "old" / "_SUCCESS").unlink()
    elif step == "half moved":
        new = next((work / "new").rglob("part-*"))
        new.rename(Path(path, new.parent.name, new.name))
        assert len(ids(spark, path)) > len(held)  # for a moment rows stand twice, and none is missing
    S.resume_removals(spark, path)
    assert ids(spark, path) == (held if step == "before the list" else [i for i in held if i != "d7"])


def scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_open_one_row_group(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(0, 20000, 1, 1).select(*[
        {"id": F.md5(F.col("id").cast("string")), "external_id": F.md5((F.col("id") * 7).cast("string")), "created_at": F.lit("2026-01-01").cast("timestamp"), "source": F.lit("s")}
        .get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.LEDGER if f.name != "created_date"
    ]).withColumn("created_date", F.lit("2026-01-01").cast("date"))
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        S.store_rows(rows, path, "overwrite")
    finally:
        spark.conf.unset("parquet.block.size")
    stored = S.read_ledger(spark, path)
    one = stored.where("id = md5('77')").first()
    assert scanned(ledger.decision_by_id(stored, one["id"]).select("id", "source")) < 20000 / 4
    assert scanned(stored.where(F.col("external_id") == one["external_id"]).select("id")) < 20000 / 4
    assert ledger.decision_by_id(stored, one["id"]).count() == 1 and ledger.find_by_external(stored, "s", one["external_id"]).count() == 1
    assert scanned(ledger.decision_by_id(stored, "not there").select("id", "source")) == 0


@pytest.mark.parametrize("limit, queue", [(3, None), (0, None), (1000, None), (2, "human-review"), (5, "no such queue")])
def test_newest_rows_read_few_dates(spark, tmp_path, limit, queue):
    path = str(tmp_path / "ledger")
    S.write_decisions(decided(spark), path)
    got = S.recent_decisions(spark, path, limit, queue)
    assert [r["id"] for r in got.collect()] == [r["id"] for r in ledger.list_recent(S.read_ledger(spark, path), limit, queue).collect()]
    if limit == 3:
        assert len({r["created_date"] for r in got.collect()}) == 1 and ">= 2026-01-06" in got._jdf.queryExecution().executedPlan().toString().replace("20459", "2026-01-06")


def test_events_of_a_batch_are_written_once(spark, tmp_path):
    path, d = str(tmp_path / "events"), decided(spark)
    sent = d.select("id", "created_at", "ticket.source", "ticket.external_id")
    settled = ledger.authoritative(sent, sent.limit(0))
    for _ in range(2):
        S.write_decision_events(d, path, batch=1, settled=settled)
    S.write_decision_events(d.limit(3), path, batch=2)
    lines = [json.loads(r["value"]) for r in S.read_decision_events(spark, path).collect()]
    assert len(lines) == 63 and sum(x["event"].endswith("deduplicated") for x in lines) == settled.where("discarded").count() == 1


def test_events_written_twice_read_each_ticket_once(spark, monkeypatch):
    """Settling and writing a batch used to decide every ticket again: six times in this query."""
    sf, read = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)

    def watched(text):
        read.add(1)
        return text

    udf = F.udf(watched).asNondeterministic()
    monkeypatch.setattr(registry, "rules", lambda spark, sf: decide(derived.order_tickets(spark, sf).withColumn("text", udf("text"))))
    got = registry.QUERIES["write_decision_events"](spark, sf).collect()
    orders = derived.table(spark, sf, "orders").count()
    assert len(got) == orders and read.value == orders


def test_events_of_narrowed_decisions_are_those_of_whole_ones(spark, tmp_path):
    d = registry.read_by_model(spark, "/root/testdata/sf0.001").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    narrow = S.decided_for_events(d, str(tmp_path / "decided"))
    sent = [x.select("id", "created_at", "ticket.source", "ticket.external_id") for x in (d, narrow)]
    assert sorted(sent[0].collect()) == sorted(sent[1].collect())
    whole, got = [sorted(r["value"] for r in S.decision_events(x).collect()) for x in (d, narrow)]
    assert got == whole and len(whole) > 1000 and any('"usage":{' in v for v in whole)


def generated(plan):
    """Rows that came out of the generators of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(child) for child in children)


def test_winners_have_no_more_copies_than_submissions(spark):
    rows = [(f"d{i}", i % 7, "mail", "hot" if i % 3 == 0 else f"k{i}") for i in range(300)] + [("loose", 1, "mail", None)]
    new = spark.createDataFrame(rows, "id string, created_at int, source string, external_id string").withColumn("created_at", F.timestamp_seconds("created_at"))
    held = new.limit(0).unionByName(new.where("id in ('d1', 'd2')").withColumns({"id": F.concat(F.lit("old-"), "id"), "external_id": F.when(F.col("id") == "d1", F.col("external_id")).otherwise(F.lit("held only"))}))
    first = min((t, i) for i, t, _, k in rows if k == "hot")[1]
    want = {i: first if k == "hot" else "old-d1" if i == "d1" else i for i, _, _, k in rows}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for salts in (1, 16, 100):
            got = ledger.authoritative(new, held, salts)
            assert {r["submitted_id"]: r["id"] for r in got.collect()} == want and got.count() == len(rows)
            assert generated(got._jdf.queryExecution().executedPlan()) <= len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_events_run_as_methods_that_the_jvm_compiles(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        S.decision_events(registry.rules(spark, "/root/testdata/sf0.001")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def follow(spark, folder, tmp_path, **kw):
    paths = [str(tmp_path / n) for n in ("ledger", "bad", "ckpt")]
    intake.stream_intake(intake.stream_tickets(spark, str(folder), 1), *paths, **kw).awaitTermination()
    return intake.read_stream_ledger(spark, paths[0])


@pytest.mark.parametrize("how", ["intake", "record"])
def test_ids_stay_apart_over_batches_and_a_replay_changes_nothing(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(keys, "EVERY", 2)
    monkeypatch.setattr(keys, "MANY", 1)
    monkeypatch.setattr(keys, "BUCKETS", 4)
    src = tmp_path / "in"
    src.mkdir()
    out, ckpt = str(tmp_path / "ledger"), str(tmp_path / "ckpt")

    def run():
        if how == "intake":
            return follow(spark, src, tmp_path)
        intake.stream_record(intake.stream_decide(intake.stream_tickets(spark, str(src), 1)), out, ckpt).awaitTermination()
        return intake.read_stream_ledger(spark, out)

    for i in range(5):
        lines = ['"no key"'] * (1 + i % 2) + [json.dumps({"text": f"text {i}", "id": "T", "source": "crm"}), json.dumps({"text": "own", "id": f"K{i}"})]
        (src / f"{i}.json").write_text("\n".join(lines))
        os.utime(src / f"{i}.json", (1e9 + i, 1e9 + i))
    after = run().collect()
    rows = [(r["id"], r["external_id"], r["ticket_text"]) for r in after]
    loose = [r for r in rows if r[1] is None]
    assert len(loose) == 7 and len({r[0] for r in rows}) == len(rows) == 13
    # The n-th row of an id is named by n alone, whatever the batches.
    base = decision_id(F.lit("api"), F.lit(None), F.lit("no key"), *([F.lit(None).cast("timestamp")]))
    first = spark.range(1).select(base.alias("b")).first()["b"]
    want = [first] + [spark.range(1).select(decision_id(F.lit(first), F.lit(str(n))).alias("x")).first()["x"] for n in range(1, 7)]
    assert sorted(r[0] for r in loose) == sorted(want)
    assert [r[2] for r in rows if r[1] == "T"] == ["text 0"]
    assert all(json.loads(r["decision_json"])["id"] == r["id"] for r in after)
    # The last batch runs again, as after a failure between its ledger folder and its commit.
    os.remove(f"{ckpt}/commits/4")
    (Path(ckpt) / "commits" / ".4.crc").unlink(missing_ok=True)
    assert sorted((r["id"], r["ingest_batch"]) for r in run().collect()) == sorted((r["id"], r["ingest_batch"]) for r in after)


def test_index_opens_the_buckets_of_a_batch_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "BUCKETS", 8)
    index = str(tmp_path / "keys")
    schema = "source string, external_id string, n long"
    for i in range(12):
        keys.add(spark.createDataFrame([("s", f"k{i}", 1), (None, "loose", 2)], schema), index, i)
    keys.add(spark.createDataFrame([("s", "k11", 1), (None, "loose", 2)], schema), index, 11)
    asked = spark.createDataFrame([("s", "k3", 1), (None, "loose", 1), ("s", "new", 1)], schema)
    held = {(r.source, r.external_id): r.n for r in keys.known(asked, index, 12).collect()}
    assert held[("s", "k3")] == 1 and held[(None, "loose")] == 24 and ("s", "new") not in held
    assert {(r.source, r.external_id): r.n for r in keys.known(asked, index, 11).collect()}[(None, "loose")] == 22
    folders = keys._folders(spark, index, "bucket=*/*")
    assert keys.merge(spark, index, 12, many=3) >= 1 and len(keys._folders(spark, index, "bucket=*/*")) < len(folders)
    assert {(r.source, r.external_id): r.n for r in keys.known(asked, index, 12).collect()} == held
    assert keys.merge(spark, index, 12, many=3) == 0
    assert keys.known(asked.where("external_id = 'k3'"), index, 12).inputFiles() and len(keys.known(asked.where("external_id = 'k3'"), index, 12).inputFiles()) < 12


def test_a_ledger_without_index_gets_one(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"text": "a", "id": "T"}\n"loose"')
    follow(spark, src, tmp_path)
    import shutil

    shutil.rmtree(tmp_path / "ledger" / intake.KEYS)
    (src / "2.json").write_text('{"text": "b", "id": "T"}\n"loose"')
    rows = follow(spark, src, tmp_path)
    assert rows.count() == 3 and rows.select("id").distinct().count() == 3
