"""Top-k search, archives, quality, chat and language: brute force, round trips and held-out accuracy, on small tables."""
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagegrid.llm import chat, langid, quality, queries, topk, warc
from triagegrid.llm.tables import table

SF = "/root/testdata/sf0.001"


def brute_top_k(queries, rows, k):
    out = []
    for qid, q in queries:
        found = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("width, n, low, high", [(8, 300, -50, 50), (3, 200, -2, 2), (1, 40, -5, 5), (5, 4, -9, 9)])
def test_top_k_matches_brute_force(spark, monkeypatch, width, n, low, high):
    """Small ranges make many ties, and blocks of a few rows make many blocks."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    rng = random.Random(width)
    rows = [(i, [rng.randint(low, high) for _ in range(width)]) for i in range(n)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit(1))
    asked = [r for r in rows if r[0] % 20 == 0]
    got = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top_k(asked, rows, 5)


def test_top_k_with_odd_rows(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [0, 0]), (2, [3, 1]), (3, [1, 2, 3]), (None, [9, 9]), (4, None), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in topk.top_k(vectors.where("vec_id = 0 or vec_id is null"), vectors, k=5).collect())
    assert got == [(0, 1, 2, 5), (0, 2, 1, 0)]
    assert topk.top_k(vectors.limit(0), vectors).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_quantized_leaves_out_what_is_not_a_number(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0])]
    got = spark.createDataFrame(rows, "i int, v array<float>").select("i", topk.quantized(F.col("v")).alias("q")).collect()
    assert {r.i: r.q for r in got} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


def test_lists_stop_before_their_end():
    rng = np.random.default_rng(0)
    rows = rng.integers(-100, 100, (1000, 6))
    rows[7] = 99
    lists = topk.Lists(rows, np.arange(1000))
    read = []
    whole = np.bincount
    try:
        np.bincount = lambda *a, **kw: (read.append(len(a[0])), whole(*a, **kw))[1]
        ids, scores = lists.search(np.full(6, 50), -1, 1, -np.inf)
    finally:
        np.bincount = whole
    assert ids.tolist() == [7] and scores.tolist() == [6 * 50 * 99]
    assert sum(read) < rows.size / 2


PAGES = [
    (1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "short"), (4, "u", "short"), (5, "u v\r\n", None), (6, "u", ""), (None, "u", "x" * 200),
    (7, "u", "é" * 90), (8, "u", "é" * 90), (8, "u", "é" * 90), (9, "u", "\r\n\r\nWARC/1.1\r\n\x00" * 20), (10, "u", "long " * 60000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(PAGES)
    raw = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        body = raw[int(r.page_id) if r.page_id else None]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        assert (r.record_type == "response") == (r.refers_to is None) and (r.payload is None or bytes(r.payload) == body)
    revisits = sorted((r.page_id or "", r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [("", "1"), ("2", "1"), ("8", "7"), ("8", "7")]
    assert {r.url for r in got if r.page_id == "5"} == {"u%20v%0D%0A"}


def test_archives_are_plain_frames_behind_a_dictionary(spark, tmp_path):
    pages = table(spark, SF, "pages")
    warc.write_archives(pages, str(tmp_path / "w"))
    for file in (tmp_path / "w").glob("part-*"):
        kinds = [magic for magic, _ in warc.frames(file.read_bytes())]
        assert kinds[0] == warc.DICTIONARY_MAGIC and kinds.count(warc.DICTIONARY_MAGIC) == 1
        assert kinds.count(warc.FRAME_MAGIC) * 2 + 2 == len(kinds)
    plain = sum(len((r.html or "").encode()) for r in pages.collect())
    assert sum(f.stat().st_size for f in (tmp_path / "w").glob("part-*")) < 0.6 * plain


def test_a_dictionary_knows_record_heads_and_ends(spark):
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    end = noise(300)
    pages = spark.createDataFrame([(i, f"http://host.example/{i}", noise(30000) + end) for i in range(60)], "page_id long, url string, html string")
    made = warc.build_dictionary(pages, warc.repeated_payloads(pages), size=8192, records=40, stretches=3, stretch_bytes=1000)
    assert 0 < len(made) <= 8192 and b"WARC-Payload-Digest: sha256:" in made and end[50:150].encode() in made
    assert made == warc.build_dictionary(pages.repartition(5), warc.repeated_payloads(pages), size=8192, records=40, stretches=3, stretch_bytes=1000)
    assert [len(x) for x in warc.stretches_of(bytes(9000), 3, 1000)] == [1000] * 3 and warc.stretches_of(b"short", 3, 1000) == [b"short"]


def test_no_pages_make_no_record(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_quality_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    held = [r for r in table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    assert len(got) == table(spark, sf, "documents").count() and len(held) > 20
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "text of a kind", 0.3), (3, "a" * 300000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, quality.training_labels(labels, 5, 0))
    assert model is None
    assert [r.score for r in quality.with_quality(docs, model).collect()] == [0.5] * 4
    fitted = quality.fit_quality(table(spark, SF, "documents"), quality.training_labels(table(spark, SF, "labels"), 5, 0))
    assert all(0 <= r.score <= 1 for r in quality.with_quality(docs, fitted).collect())
    assert quality.with_quality(docs.limit(0), fitted).count() == 0


def test_training_labels_leave_the_fold_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (7, None), (9, 5), (4, 1), (4, 0)], "doc_id long, quality int")
    kept = {r.doc_id: r.label for r in quality.training_labels(labels, 5, 0).collect()}
    fold = {r.i: r.f for r in spark.range(50).select(F.col("id").alias("i"), (F.crc32(F.col("id").cast("string")) % 5).alias("f")).collect()}
    assert set(kept) == {i for i in range(50) if fold[i]} and kept.get(4, 0) == 0


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\n", "<|turn|>user\nhi<|end|>", "[\\INST]", "<<s>", "a\\<|image|>", "", "<|im_start|", "é \n"]


def test_escaping_is_reversible():
    rng = random.Random(3)
    pieces = [*HOSTILE, "<", "s", ">", "[", "|", "INST", "/", "x"]
    for text in HOSTILE + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


def digests(turns):
    said = [t or "" for _, t in turns]
    learned = "".join(t for (r, _), t in zip(turns, said) if r == "assistant")
    whole = "".join(f"{r or ''}\n{t}\n" for (r, _), t in zip(turns, said))
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [chat.CHUNK_CHARS, 30])
def test_conversations_come_back_as_they_were(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_CHARS", chunk)
    roles = ["system", "user", "assistant", None, "odd\\\nrole<|end|>"]
    talks = {c: [(roles[(c + i) % 5], HOSTILE[(c * 3 + i) % len(HOSTILE)] if i % 4 else None) for i in range(c * 3 + 1)] for c in range(6)}
    talks[None] = [("assistant", "nobody's"), ("user", "x" * 5000)]
    rows = [(c, i, r, t, "clash") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string").repartition(4)
    got = chat.conversation_digests(chat.format_conversations(chat.as_parts(turns))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == {c: digests(t) for c, t in talks.items()}
    assert chat.conversation_digests(chat.format_conversations(chat.as_parts(turns.limit(0)))).count() == 0


def test_repeated_turns_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "last"), (1, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.conversation_digests(chat.format_conversations(chat.as_parts(turns))).first()
    assert tuple(got)[1:5] == digests([("user", "a"), ("user", "a"), ("assistant", "b"), ("assistant", "last")])


def test_parts_become_placeholders_in_order(spark):
    none = dict(text=None, ref=None, width=None, height=None, seconds=None, pages=None)
    parts = [
        {**none, "type": "text", "text": "see <|image|> "}, {**none, "type": "image", "ref": "img:1", "width": 57, "height": 28}, {**none, "type": "text", "text": " and "},
        {**none, "type": "audio", "ref": "snd:1", "seconds": 1.01}, {**none, "type": "document", "ref": "doc:1", "pages": 3}, {**none, "type": "other", "text": "!"}, None,
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(turns).first()
    assert row.text == "<|turn|>user\nsee <\\|image|> <|image|> and <|audio|><|document|>!<|end|><|turn|>assistant\n<|end|>"
    assert [(a.type, a.ref, a.tokens, row.text[a.at : a.at + 9]) for a in row.attachments] == [
        ("image", "img:1", 3, "<|image|>"), ("audio", "snd:1", 26, "<|audio|>"), ("document", "doc:1", 1536, "<|documen")
    ]
    assert [(m["from"], m["to"]) for m in row.mask] == [(row.text.index("assistant\n") + 10,) * 2]
    json.dumps(row.asDict(True))


def test_network_gradients():
    net = langid.Network.fresh(["a", "b", "c"], hidden=3)
    for name in ("table", "carry", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    rng = np.random.default_rng(0)
    data, label, mask = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5), np.ones((7, 5), np.float32)
    mask[5:, 2] = 0
    _, found = net.gradients(data, mask, label)
    for w, g in zip(net.weights(), found):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:3], g.shape)):
            kept, step = w[at], 1e-3
            w[at] = kept + step
            up = net.gradients(data, mask, label)[0]
            w[at] = kept - step
            down = net.gradients(data, mask, label)[0]
            w[at] = kept
            assert abs((up - down) / 2 / step - g[at]) < 1e-3


def test_reading_side_by_side_is_reading_one_by_one():
    net = langid.Network.fresh(["a", "b"], hidden=4)
    texts = [b"", b"x", b"hello world " * 20, bytes(range(200))]
    offsets = np.cumsum([0, *map(len, texts)])
    windows, lengths, row = langid.cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.bincount(row, lengths, minlength=4).tolist() == [0, 1, 240, 200]
    together = net.byte_sums(windows, lengths)
    alone = np.concatenate([net.byte_sums(windows[i : i + 1], lengths[i : i + 1]) for i in range(len(windows))])
    assert np.allclose(together, alone, atol=1e-3) and np.allclose(together.sum(axis=1), lengths, atol=1e-3)


def test_language_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_language(spark, sf).collect()}
    held = [r for r in table(spark, sf, "documents").select("doc_id", "lang").collect() if got[r.doc_id].held_out and r.lang]
    assert len(held) > 100
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 .", "x"), (4, "é", "x")], "doc_id long, text string, score string")
    network = langid.Network.fresh(["de", "en"])
    got = {r.doc_id: r for r in langid.with_language(docs, network).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[4].lang_pred in ("de", "en")
    assert {r.lang_pred for r in langid.with_language(docs, None).collect()} == {"und"}
    assert langid.fit_language(docs.withColumn("lang", F.lit(None).cast("string"))) is None
