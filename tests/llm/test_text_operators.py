"""Near copies, decontamination, suffix and line dedup, mixing: against brute force on small tables with awkward rows."""
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from triagegrid.llm import decontaminate, jaccard, line_chunks, mix, suffix_dedup
from triagegrid.llm.tables import components, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, class string, `key` int, n long"
WORDS = ["alpha", "Beta", "gamma", "été", "ß", "x1", "same", "the", "of", "Zeile"]


def words(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def awkward(rng, n=60):
    """Rows with copies, near copies, shared passages, nulls, empties and a long text; extra columns clash with inner names."""
    base = [words(rng, rng.randrange(1, 120)) for _ in range(n // 3)]
    passage = words(rng, 70)
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        if i % 3 == 1 and len(w) > 20:
            w[rng.randrange(len(w))] = "edit"
        if i % 5 == 2:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        text = "".join(x + rng.choice([" ", "\n", "\t", " "]) for x in w)
        rows.append((i, text, f"s{i % 4}", "c", 1, 2))
    rows += [(n, None, None, None, None, None), (n + 1, "", "s0", "", 0, 0), (n + 2, " \n\t ", None, "", 0, 0), (n + 3, "one", "s1", "", 0, 0)]
    rows += [(n + 4, "one", "s1", "", 0, 0), (n + 5, "a b c", "s2", "", 0, 0), (n + 6, " ".join(words(rng, 9000)), "s3", "", 0, 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 50)])
def test_near_copies_match_brute_force(docs, rows, k, percent):
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute.near_groups([r[:2] for r in rows], k, percent))


def test_near_copies_with_repeated_and_null_ids(spark):
    held = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (3, "A b  c d e f g"), (None, "q r s t u"), (9, None), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(held, "doc_id long, text string"), 4, 85).collect()
    assert len(got) == len(held)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    assert {r.component_id for r in got if r.doc_id is None} == {3, None}


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    held = [(5, "m n o p q"), (5, near + " x"), (3, near), (3, near + " y"), (3, near), (None, near), (None, "q r s t u"), (None, "q r  s t u"), (7, None), (None, None), (7, " ")]
    docs = spark.createDataFrame(held, "doc_id long, text string").withColumn("class", F.lit("c"))
    kept = jaccard.keep_one(docs, 4, 80)
    assert kept.columns == ["doc_id", "text", "class"]
    got = sorted((r.doc_id or 0, (r.text or "").replace("  ", " ").replace(" y", "")) for r in kept.collect())
    assert got == [(0, ""), (0, "q r s t u"), (3, near), (5, "m n o p q"), (7, ""), (7, " ")]


def test_ids_may_be_strings_and_columns_may_have_inner_names(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    held = [("x", near, 1, 2, 3), ("y", near + " u", 4, 5, 6), ("z", "own words of z", 7, 8, 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(held, "doc_id string, text string, __class int, __mark int, __of int")
    got = jaccard.jaccard_components(docs, 4, 80).collect()
    assert sorted((r.doc_id or "", r.component_id or "") for r in got) == [("", ""), ("x", "x"), ("y", "x"), ("z", "z")]
    kept = jaccard.keep_one(docs, 4, 80)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([held[0], held[2], held[3]], key=str)
    items = spark.createDataFrame([(1, "own words of z")], "item_id long, text string")
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([held[0], held[1], held[3]], key=str)


def test_common_tokens_are_dealt_to_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 1)
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, 4, 60).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute.near_groups([r[:2] for r in rows], 4, 60))


def test_a_large_group_of_near_copies_is_not_expanded(spark):
    """Some hundred edits of one text: one component, found through far fewer links than pairs."""
    rng = random.Random(8)
    base = words(rng, 150)
    held = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"edit{i}"
        held.append((i, " ".join(w)))
    docs = spark.createDataFrame(held, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, 5, 80).collect()
    assert {r.component_id for r in got} == {0}


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)]
    ring = [(300, 301), (301, 302), (302, 300), (300, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star + ring, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 230)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, "Alpha beta, gamma delta 5 é x y z w q"), (2, "short item"), (2, "short item"), (3, None), (4, "..."), (None, "nameless item here"), (10, "short item")]


def test_contamination_matches_brute_force(spark, docs, rows):
    items = [*ITEMS, (20, rows[2][1]), (21, " ".join(rows[2][1].split()[5:20])), (22, rows[66][1][:200])]
    held = [*rows, (900, "xx SHORT-item yy short item", "s", "", 0, 0), (901, "alpha BETA gamma delta 5 é x y z w", "s", "", 0, 0), (901, "alpha BETA gamma delta 5 é x y z w", "s", "", 0, 0)]
    table_of = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for blocks in (10**6, 40):
        found = decontaminate.contamination(spark.createDataFrame(held, SCHEMA), table_of, 10, block_windows=blocks)
        digest = F.sha2(F.array_join("items", ","), 256)
        got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), digest, F.col("n_hit") > 0).collect())
        assert got == sorted(brute.contaminated([r[:2] for r in held], items, 10))


def test_contamination_without_items_or_documents(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, none).count() == 0


def test_contaminated_rows_go_and_others_with_their_id_stay(spark):
    held = [(1, "q short item q"), (1, "clean words"), (None, "short item"), (None, "clean"), (2, None)]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.without_contaminated(docs, items).collect()) == [(0, "clean"), (1, "clean words"), (2, "")]


@pytest.mark.parametrize("spread_from", [suffix_dedup.SPREAD_FROM, 1])
def test_suffix_dedup_matches_brute_force(docs, rows, monkeypatch, spread_from):
    monkeypatch.setattr(suffix_dedup, "SPREAD_FROM", spread_from)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    for length in (100, 400):
        found = suffix_dedup.suffix_dedup(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert sorted(tuple(r) for r in found.collect()) == sorted(brute.repeated_bytes([r[:2] for r in rows], length))


def test_suffix_dedup_of_repeats_inside_and_across(spark, nothing):
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdéf ") for _ in range(120))
    held = [(1, unit * 3), (2, "ab" * 150), (3, "x" + unit), (4, "a" * 99), (5, "a" * 101), (6, "same text " * 12), (6, "same text " * 12), (None, unit[:110]), (7, None)]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    order = lambda r: (r[0] is None, *[x or 0 for x in r[:4]])
    assert sorted((tuple(r) for r in found), key=order) == sorted(brute.repeated_bytes(held, 100), key=order)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_dedup_of_long_texts_goes_in_stretches(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH_BYTES", 700)
    found = suffix_dedup.suffix_dedup(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute.repeated_bytes([r[:2] for r in rows], 100))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for n in (1, 2, 9, 60, 700):
        for letters in (b"a", b"ab", bytes(range(0, 256, 5))):
            text = bytes(rng.choice(letters) for _ in range(n))
            whole = np.frombuffer(text, np.uint8)
            order, rank = suffix_dedup.suffix_array(whole)
            assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
            assert (rank[order] == np.arange(n)).all()
            common = suffix_dedup.common_prefixes(whole, order, rank, np.array([0]), np.array([n]), 300)
            for a, b in zip(order[:-1], order[1:]):
                same = 0
                while same < min(300, n - max(a, b)) and text[a + same] == text[b + same]:
                    same += 1
                assert common[b] == same


def lines_brute(rows):
    chunks, first = {}, {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        chunks[doc_id] = [(line_chunks._body(raw, c), c) for c in line_chunks._chunks(raw, line_chunks.SPREAD)]
        for i, (body, c) in enumerate(chunks[doc_id]):
            if c[2] >= 2:
                first[body] = min(first.get(body, (doc_id, i)), (doc_id, i))
    return {d: b"".join((t or "").encode()[c[0] : c[1]] for i, (b, c) in enumerate(chunks[d]) if c[2] < 2 or first[b] == (d, i)).decode() for d, t in rows}


def test_line_dedup_matches_brute_force(docs, rows):
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(docs).collect()}
    want = lines_brute([r[:2] for r in rows])
    assert {k: v or "" for k, v in got.items()} == want
    assert got[60] is None and got[61] == ""


def test_line_dedup_removes_shifted_passages(spark):
    rng = random.Random(6)
    passages = [[" ".join(words(rng, 6)) for _ in range(20)] for _ in range(4)]
    held = [(i, "\n".join([f"own {i} {j}" for j in range(i % 5)] + rng.choice(passages) + [f"end {i}"])) for i in range(40)]
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    assert got == lines_brute(held)
    assert sum(len(t) for t in got.values()) < 0.5 * sum(len(t) for _, t in held)


def test_line_dedup_keeps_rows_columns_and_first_places(spark, nothing):
    body = "\n".join(f"line {i} of a passage that repeats" for i in range(12))
    held = [(2, body, 1, "x"), (1, "top\n" + body, 2, "y"), (1, "top\n" + body, 2, "y"), (None, body, 3, "z"), (4, None, 4, "w")]
    found = line_chunks.line_dedup(spark.createDataFrame(held, "doc_id long, text string, n_lines int, gone string"))
    assert found.columns == ["doc_id", "text", "gone", "n_lines", "n_removed_lines", "n_removed_chunks"]
    assert sorted(r.gone for r in found.collect()) == ["w", "x", "y", "y", "z"]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed_lines) for r in found.collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 4]
    assert got[1] == got[2] == (1, 13, 0) and got[0][2] > 5 and got[3][2] > 5
    assert line_chunks.line_dedup(nothing).count() == 0


def planted(n_lines, copies=6, words_in_all=52):
    """Own lines around a passage of some fifty words in ``n_lines`` lines, the surroundings different in every document."""
    rng = random.Random(n_lines)
    passage = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(words_in_all)]
    at = [words_in_all * i // n_lines for i in range(n_lines + 1)]
    passage = "\n".join(" ".join(passage[a:b]) for a, b in zip(at, at[1:]))
    own = lambda i, side: "\n".join(f"own line {side} {i} {j} {rng.random()}" for j in range(1 + i % 4))
    return passage, [(i, own(i, "above") + "\n" + passage + "\n" + own(i, "below")) for i in range(copies)]


@pytest.mark.parametrize("n_lines", [1, 2, 3, 5, 10, 30])
def test_a_passage_of_any_number_of_lines_stays_once(spark, n_lines):
    passage, held = planted(n_lines, words_in_all=max(52, 2 * n_lines))
    got = {r.doc_id: r for r in line_chunks.passage_dedup(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    assert got[0].text == held[0][1] and got[0].n_removed_passages == 0
    for i, text in held[1:]:
        assert got[i].text == text.replace(passage + "\n", "")
        assert (got[i].n_removed_passages, got[i].n_lines, got[i].n_removed_bytes) == (1, text.count("\n") + 1, len(passage.encode()) + 1)


def passages_brute(rows, least):
    """Plain Python: a unit goes if some run around it, with words enough, has an equal run at an earlier place."""
    units = {}
    for doc_id, text in rows:
        units[doc_id] = [s.strip() for line in text.split("\n") for s in line.replace(". ", ".\0").split("\0") if s.strip()]
    seen, gone = {}, set()
    for doc_id in sorted(units):
        for i in range(len(units[doc_id])):
            for e in range(i + 1, len(units[doc_id]) + 1):
                run = tuple(units[doc_id][i:e])
                if sum(len(u.split()) for u in run) >= least and seen.setdefault(run, (doc_id, i)) != (doc_id, i):
                    gone.update((doc_id, j) for j in range(i, e))
    return {d: [u for j, u in enumerate(us) if (d, j) not in gone] for d, us in units.items()}


def test_passages_of_lines_and_sentences_match_brute_force(spark):
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(["alpha", "gamma", "été", "x1", "the"]) + str(rng.randrange(10**5)) for _ in range(n)) + "."
    shared = [[sentence(rng.randrange(2, 40)) for _ in range(rng.randrange(1, 6))] for _ in range(6)]
    held = []
    for i in range(40):
        units = [sentence(rng.randrange(1, 9)) for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(units) + 1)
            units[at:at] = rng.choice(shared)[rng.randrange(2) :]
        # No chunk of lines without words enough repeats, as own sentences and line ends differ.
        held.append((i, "".join(u + rng.choice(["  ", " ", "\n"]) for u in units)))
    found = line_chunks.passage_dedup(spark.createDataFrame(held, "doc_id long, text string"), spread=10**12).collect()
    got = {r.doc_id: [s.strip() for line in r.text.split("\n") for s in line.replace(". ", ".\0").split("\0") if s.strip()] for r in found}
    assert got == passages_brute(held, line_chunks.LEAST_WORDS)
    assert sum(r.n_removed_passages for r in found) > 10


def test_passages_inside_a_text_nulls_and_equal_rows(spark, nothing):
    body = " ".join(f"word{i}" for i in range(30))
    held = [(2, "x\n" + body, "a"), (1, body + "\n" + body + "\ny", "b"), (1, body + "\n" + body + "\ny", "b"), (None, "own. " + body + "\nz", "c"), (4, None, "d"), (5, "", "e")]
    found = line_chunks.passage_dedup(spark.createDataFrame(held, "doc_id long, text string, gone string"))
    assert found.columns == ["doc_id", "text", "gone", "n_lines", "n_removed_bytes", "n_removed_passages"]
    assert sorted(((r.doc_id or 9, r.text) for r in found.collect()), key=str) == [(1, body + "\ny"), (1, body + "\ny"), (2, "x\n"), (4, None), (5, ""), (9, "own. \nz")]
    assert line_chunks.passage_dedup(nothing).count() == 0


def test_units_end_at_lines_and_sentences():
    texts = ["  One two. Three (four!) five.six\n\n seven?\" eight ", "", " \n ", "一二。三四！\n五 六。", "。", "nine"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = list(zip(*(x.tolist() for x in line_chunks._units(data, offsets))))
    got = [(row, b"".join(raw)[a:b].decode(), n) for row, a, b, n in found]
    assert got == [
        (0, "One two.", 2), (0, "Three (four!)", 2), (0, "five.six", 1), (0, 'seven?"', 1), (0, "eight", 1),
        (3, "一二。", 1), (3, "三四！", 1), (3, "五 六。", 2), (4, "。", 1), (5, "nine", 1),
    ]


def test_mix_meets_targets_and_limits(docs, rows, nothing):
    pieces, sources = mix.mix(docs, block_words=8, shard_slots=100)
    got = mix.words_taken(docs, pieces, sources).collect()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.SPACE_WORD.findall((text or "").encode()))
    assert len(got) == len(rows)
    assert {(r.source, r.source_size) for r in sources.collect()} == set(sizes.items())
    taken = {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r.size == len(brute.SPACE_WORD.findall((by_id[r.doc_id][1] or "").encode())) and 0 <= r.taken <= 3 * r.size
        taken[by_id[r.doc_id][2]] = taken.get(by_id[r.doc_id][2], 0) + r.taken
    for r in sources.collect():
        assert abs(taken[r.source] - r.target) <= 0.05 * r.target + 8
    again = mix.words_taken(docs.repartition(5), *mix.mix(docs.repartition(2), block_words=8, shard_slots=100)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mix.mix(nothing)[0].count() == 0


def test_mix_texts_are_those_of_the_documents(docs, rows):
    pieces = mix.mix(docs, with_text=True, block_words=8)[0].collect()
    texts = {r[0]: (r[1] or "").split() for r in rows}
    assert pieces
    for p in pieces:
        assert p.text.split() == texts[p.doc_id][p.from_word : p.from_word + p.n_words]
    slots = {}
    for p in pieces:
        slots[p.shard, p.slot] = slots.get((p.shard, p.slot), 0) + p.n_words
    assert max(slots.values()) == 8


def test_targets_reshare_what_is_above_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 500)], "source string, size long")
    rows = {r["source"]: r["target"] for r in mix.source_targets(sizes)}
    assert rows["a"] == 30 and rows["c"] == 60
    assert abs(sum(rows.values()) - 1530) < 1e-6 and abs(rows["b"] / rows[None] - 2 / 5) < 1e-9


def test_permutation_is_one():
    for size in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            assert sorted(mix.permuted(np.arange(size), size, key).tolist()) == list(range(size))
    draws = mix.shard_counts(np.array([500, 3, 0, 97]), 64, 1)
    assert sum(draws).tolist() == [500, 3, 0, 97] and all(d.sum() == 64 for d in draws[:-1])


def test_shingles_of_documents_in_a_batch_do_not_touch(spark):
    docs = table(spark, SF, "documents").limit(40)
    whole = {r.doc_id: r.n_shingles for r in jaccard.shingle_classes(docs, 4).collect()}
    for r in docs.collect():
        assert whole[r.doc_id] == len(brute.shingle_set(r.text, 4))
