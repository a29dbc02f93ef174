"""The pipeline's stages and their chain, each against a plain Python rule on planted rows."""
import random
import re

import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from triagegrid.llm.tables import stash, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sentence(rng, n):
    return " ".join(f"{rng.choice(['river', 'Stone', 'été', 'lamp', 'of'])}{rng.randrange(10**6)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(20)
    item = " ".join(f"bench{i}" for i in range(14))
    passage = sentence(rng, 55)
    rows = [(i, "\n".join(sentence(rng, 12) for _ in range(8)), "en", f"s{i % 3}") for i in range(40)]
    near = rows[3][1].split(" ")
    near[40] = "edited"
    rows += [(100, rows[2][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, f"{sentence(rng, 30)} {item.title()}! {sentence(rng, 30)}", "en", "s2")]
    rows += [(103 + i, f"{sentence(rng, 40)}\n{passage}\n{sentence(rng, 40)}", None, "s0") for i in range(3)]
    rows += [(200, None, None, None), (201, "", "en", None), (None, sentence(rng, 20), "en", "s1")]
    return rows, item, passage


@pytest.fixture(scope="module")
def docs(spark, planted):
    rows = [(*r, len(r[1] or "")) for r in planted[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def folder(planted, tmp_path_factory):
    """The labels of the test tables with documents of their own, and a benchmark of one item."""
    path = tmp_path_factory.mktemp("tables")
    rows = [(*r, len(r[1] or "")) for r in planted[0]]
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    mine = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
    # Poor texts to learn from, marked 0; all planted ones are marked 1.
    poor = [(1000 + i, "!!! BUY NOW $$$ " * (20 + i), "en", "s0", 0) for i in range(40)]
    worse = pa.table([pa.array([r[i] for r in poor], t) for i, t in enumerate(kinds.values())], names=list(kinds))
    pq.write_table(pa.concat_tables([mine, worse]), path / "documents.parquet")
    labels = [(r[0], 1) for r in rows if r[0] is not None and r[1]] + [(r[0], 0) for r in poor]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32())}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": pa.array([planted[1], None])}), path / "benchmark.parquet")
    return str(path)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_stage_drops_what_the_labels_call_poor(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    assert not {i for i in kept if i is not None and i >= 1000}
    assert {r.doc_id for r in docs.collect() if r.text and (r.doc_id or 0) < 1000} <= kept


def test_line_stage_keeps_one_place_of_the_passage(spark, docs, planted, folder):
    rows, _, passage = planted
    out = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs.where("doc_id between 103 and 105 or doc_id is null or doc_id >= 200"), folder).collect()}
    want = {i: t for i, t, *_ in rows if i is None or i >= 103}
    for i in (104, 105):
        want[i] = want[i].replace(passage + "\n", "")
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in out.values())


def test_near_copy_stage_keeps_one_of_each_group(spark, docs, planted, folder):
    rows = planted[0]
    sets = [brute.shingle_set(t, 5) for _, t, *_ in rows]
    kept = []
    for i, own in enumerate(sets):
        earlier = [j for j in range(i) if own and sets[j] and 100 * len(own & sets[j]) >= 80 * len(own | sets[j])]
        if not earlier:
            kept.append(rows[i][:2])
    assert {100, 101} == {r[0] for r in rows} - {k[0] for k in kept}
    assert texts(corpus_pipeline.near_copy_stage(spark, docs, folder)) == sorted(kept, key=str)


def test_benchmark_stage_drops_documents_with_an_item(spark, docs, planted, folder):
    rows, item, _ = planted
    lower = lambda t: ALNUM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = lower(item)
    windows = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    hit = lambda t: any(tuple(lower(t)[i : i + 10]) in windows for i in range(len(lower(t))))
    want = sorted(((i, t) for i, t, *_ in rows if not hit(t)), key=str)
    assert len(want) == len(rows) - 1
    assert texts(corpus_pipeline.benchmark_stage(spark, docs, folder)) == want


def test_mix_stage_holds_the_texts_of_its_documents(spark, docs, planted, folder):
    held = {r[0]: (r[1] or "").split() for r in planted[0]}
    pieces = corpus_pipeline.mix_stage(spark, docs, folder).collect()
    assert pieces
    for p in pieces:
        assert p.text.split() == held[p.doc_id][p.from_word : p.from_word + p.n_words]


def test_run_applies_the_stages_in_turn(spark, planted, folder):
    rows, item, passage = planted
    pieces = corpus_pipeline.run(spark, folder).collect()
    found = {p.doc_id for p in pieces}
    # The exact copy has lost every passage to its first place, the near copy all but the sentence that was edited.
    assert not found & {100, 102} and not {i for i in found if i is not None and i >= 1000}
    text = {r[0]: r[1] for r in rows}
    (edited,) = [x for x in text[101].split("\n") if "edited" in x]
    assert {w for p in pieces if p.doc_id == 101 for w in p.text.split()} <= set(edited.split())
    # What reaches the mix is every other document; the mix draws from them by weight.
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, folder), name)
    reached = {r.doc_id for r in docs.collect() if r.text}
    assert {i for i in text if text[i]} - {100, 102} == reached | {101} and found <= reached
    mark = passage.split()[30]
    assert {p.doc_id for p in pieces if mark in p.text} <= {103}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "mix"]
