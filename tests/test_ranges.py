"""JSON arrays and CSV files cut into many ranges give the rows of the whole file."""
import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from triagegrid.sources import labelled, ranges, tickets

ODD = ['plain', 'a, b', 'brackets [1, {2}]', 'quote " and \\ slash', 'line\nbreak, "two"', '', 'é €𝄞', '\\', '\\"', '"', '""', '},{', '],[', 'x' * 300, 'tab\t', "it's"]


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    held = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def items(seed):
    rng = random.Random(seed)
    out = []
    for i in range(40):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))
        out.append(rng.choice([{"text": text, "id": i}, text, {"text": text, "external_id": f"e{i}", "more": [1, [2, {"a": "]"}], "b,"]}, i, None, {"text": 5}, {"note": text}]))
    return out


def expected(values):
    rows = []
    for v in values:
        if isinstance(v, str):
            rows.append((v.strip(), None, None))
        elif isinstance(v, dict) and "text" in v:
            key = v.get("external_id", v.get("id"))
            rows.append((v["text"], None if key is None else str(key), None) if isinstance(v["text"], str) else (None, None, "text is not a string"))
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed, layout", [(1, {}), (2, {"indent": 2}), (3, {"separators": (",", ":")}), (4, {"ensure_ascii": False})])
def test_arrays_in_ranges(spark, tmp_path, small_splits, seed, layout):
    values = items(seed)
    (tmp_path / "a.json").write_text("\n " + json.dumps(values, **layout) + "\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ]\n")
    got = tickets.read_tickets_json(spark, str(tmp_path))
    assert sorted(((r.text, r.external_id, r.read_error) for r in got.collect()), key=str) == expected(values)
    pieces, _ = ranges.cut_records(spark, str(tmp_path), ranges.json_marks, ",")
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 5 and pieces.count() >= 40


BROKEN = [" ", "{}", '"text"', "[1, 2", "[1] [2]", "[1],", "[1, ]", "[,1]", "1", "nonsense", "[{]}", '[{"text": "a}]', '[1]]', "[1}", '{"a": [1]}', "[[1]", "null", '[{"text": "ok"}, {bad}]', 'x["a"]', '["a"]x']


def test_what_is_no_array_is_one_error_row(spark, tmp_path):
    for i, body in enumerate(BROKEN):
        (tmp_path / f"{i:02}.json").write_text(body)
    (tmp_path / "good.json").write_text('[["inner"], "kept"]')
    got = tickets.read_tickets_json(spark, str(tmp_path)).collect()
    bad = sorted(r.source for r in got if r.read_error == "not a JSON array of tickets")
    assert bad == [f"upload:{i:02}.json" for i in range(len(BROKEN))]
    assert [r.text for r in got if r.read_error is None] == ["kept"]


def test_fixture_tickets_in_ranges(spark, tmp_path, small_splits):
    (tmp_path / "f.json").write_text(json.dumps([{"id": i if i % 2 else f"x{i}", "text": ODD[i % len(ODD)]} for i in range(60)], indent=1))
    got = labelled.read_fixture_tickets(spark, str(tmp_path), "demo")
    assert sorted((r.external_id, r.text, r.source) for r in got.collect()) == sorted((str(i) if i % 2 else f"x{i}", ODD[i % len(ODD)], "demo") for i in range(60))


@pytest.mark.parametrize("seed, end, quoting", [(1, "\n", csv.QUOTE_ALL), (2, "\r\n", csv.QUOTE_MINIMAL), (3, "\n", csv.QUOTE_MINIMAL)])
def test_csv_in_ranges(spark, tmp_path, small_splits, seed, end, quoting):
    rng = random.Random(seed)
    rows = [[str(i), "".join(rng.choice(ODD) for _ in range(rng.randint(1, 3))) or "-", rng.choice(["crm", ""])] for i in range(60)]
    body = io.StringIO()
    writer = csv.writer(body, quoting=quoting, lineterminator=end)
    writer.writerows([["id", "text", "source"], *rows])
    (tmp_path / "a file.csv").write_bytes((body.getvalue() + "61,an inch is 5\" long,crm" + end + "62,last line").encode())
    got = tickets.read_tickets_csv(spark, str(tmp_path)).collect()
    want = [(i, t, s or "upload:a file.csv") for i, t, s in rows] + [("61", 'an inch is 5" long', "crm"), ("62", "last line", "upload:a file.csv")]
    assert sorted((r.external_id, r.text, r.source) for r in got) == sorted((i, t or None, s) for i, t, s in want)


def test_csv_files_without_rows_or_text(spark, tmp_path):
    (tmp_path / "head.csv").write_text("id,text")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "short.csv").write_text("text,id\nonly text\n,9\n")
    got = sorted(((r.text, r.external_id, r.read_error) for r in tickets.read_tickets_csv(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("", "9", None), (None, None, "a ticket CSV needs a 'text' column"), ("only text", None, None)], key=str)


def test_many_copies_are_unfolded_in_steps(spark):
    counted = spark.createDataFrame([("a", 1), ("b", 3), ("c", 100_000)], "text string, n long")
    got = tickets.unfolded(counted, "n", "turn")
    assert {(r.text, r.k, r.most, r.least) for r in got.groupBy("text").agg(F.countDistinct("turn").alias("k"), F.max("turn").alias("most"), F.min("turn").alias("least")).collect()} == {("a", 1, 0, 0), ("b", 3, 2, 0), ("c", 100_000, 99_999, 0)}
    assert got.count() == 100_004
    huge = tickets.unfolded(spark.createDataFrame([("d", 10**10)], "text string, n long"), "n", "turn").limit(5)
    assert huge.count() == 5


def test_csv_ranges_begun_inside_quotes_with_bare_quotes(spark, tmp_path, small_splits):
    # Bare quotes inside unquoted fields are text, while a range begun inside a quoted field ends it at its next quote: the two cases a range
    # can begin in need not end opposite each other.
    rows = [[str(i), 'say "hi"\nthen 5" more,' * (i % 3 + 1) if i % 2 else 'an inch is 5" long', "crm"] for i in range(60)]
    body = io.StringIO()
    csv.writer(body, lineterminator="\n").writerows([["id", "text", "source"], *rows])
    (tmp_path / "b.csv").write_text(body.getvalue())
    got = tickets.read_tickets_csv(spark, str(tmp_path)).collect()
    assert sorted((r.external_id, r.text, r.source) for r in got) == sorted(tuple(r) for r in rows)
