import random

import numpy as np
import pytest
from brute import components, contained, prose, repeated_words, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st

from txmetrics.llm import decontamination, graph, near_dedup, passages
from txmetrics.llm import words as fast


def test_words_and_shingles_against_brute_force(corner_rows):
    texts = [t for _, t in corner_rows]
    cut = fast.split(texts)
    assert [[cut.word(k).decode() for k in range(a, b)] for a, b in zip(cut.first, cut.first[1:])] == [words(t) for t in texts]
    grams, first = fast.shingles(cut, cut.hashes())
    for text, a, b in zip(texts, first, first[1:]):
        assert len(np.unique(grams[a:b])) == len(shingles(text))
    alone = [fast.shingles(c := fast.split([t]), c.hashes())[0] for t in texts]
    assert (np.concatenate(alone) == grams).all()


def test_pruning_bound_is_the_posterior():
    plan = near_dedup.Settings(percent=85).least_matches()
    assert all(0 < k < n for n, k in plan) and plan[-1][0] == near_dedup.Settings(percent=85).hashes
    random = np.random.default_rng(3)
    for n, k in plan:  # a pair at the threshold almost never falls under the bound
        assert (random.binomial(n, 0.85, 200_000) < k).mean() < 1e-4


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 60), (201, 200), (140, 139)]
    links += [(500 - k, 499 - k) for k in range(0, 60, 2)] + [(499 - k, 498 - k) for k in range(0, 60, 2)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(10, 61)} == {10} and got[200] == got[201] == 10
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in range(440, 501)} == {440}
    assert 7 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_documents(documents, document_rows):
    for percent in (80, 85):
        got = near_dedup.near_duplicates(documents, near_dedup.Settings(percent=percent)).collect()
        want = components(document_rows, percent)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in document_rows}


def test_a_dense_group_at_the_threshold_in_leaders_and_in_blocks(spark):
    base = prose(1, 150).split()
    rows = []
    for i in range(120):
        own = list(base)
        for k in range(1 + i % 4):
            own[(i * 37 + k * 29) % 150] = f"w{i}x{k}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(i, prose(900 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 85)
    for setting in (
        near_dedup.Settings(percent=85),
        near_dedup.Settings(percent=85, leader_rounds=0, block=16),
        near_dedup.Settings(percent=85, leader_rounds=1, block=7),
    ):
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, setting).collect()} == want


def test_near_duplicate_corner_cases(corner, corner_rows, empty):
    got = [tuple(r) for r in near_dedup.near_duplicates(corner).collect()]
    assert len(got) == len(corner_rows)
    by_id = {r[0]: r for r in got}
    assert [by_id[i][2] for i in (1, 2, 3)] == [1, 1, 1]
    assert by_id[7][2] == by_id[8][2] == 7
    assert all(by_id[i][1:] == (0, i, True) for i in (4, 5, 6))
    assert sum(r[0] == 2 for r in got) == 2
    assert all(r[2] is None and r[3] for r in got if r[0] is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_items_in_documents(spark, documents, document_rows):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {tuple(r) for r in decontamination.find_items(documents, items).collect()}
    assert got == contained(document_rows, rows) and got


def test_item_corner_cases(spark, corner, corner_rows, empty):
    passage = prose(3, 40).split()
    partly = passage[:34] + ["other"] * 6  # 30 of 36 shingles
    scattered = prose(11 - 5, 30_000).split()
    rows = [
        (1, " ".join(passage)),
        (1, " ".join(passage)),
        (2, " ".join(partly)),
        (3, "one"),
        (4, "B C"),
        (5, None),
        (6, ""),
        (7, " ".join(scattered[29_000:29_200])),
        (None, "a b c d"),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string")
    for setting in (decontamination.Settings(), decontamination.Settings(block_chars=300)):
        got = sorted(map(repr, map(tuple, decontamination.find_items(corner, items, setting).collect())))
        assert got == sorted(map(repr, contained(corner_rows, set(rows))))
    flagged = corner.where(decontamination.is_contaminated(corner, items)).select("doc_id").collect()
    assert {r[0] for r in flagged} == {d for d, *_ in contained(corner_rows, rows)}
    assert decontamination.find_items(empty, items).count() == 0
    assert decontamination.find_items(corner, items.limit(0)).count() == 0
    assert corner.where(decontamination.is_contaminated(corner, items.limit(0))).count() == 0


@given(st.lists(st.integers(0, 30), min_size=0, max_size=200), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_minimisers_against_their_definition(values, window):
    seeds = np.array(values, np.uint64)
    want = {i + min(range(window), key=lambda k: (values[i + k], k)) for i in range(len(values) - window + 1)}
    assert set(passages.minimisers(seeds, window).tolist()) == want


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_passages_of_documents(documents, document_rows):
    got = passages.repeated_passages(documents).collect()
    assert covered(got) == repeated_words(document_rows)
    assert all(r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_doc_id"] != r["doc_id"] for r in got)


def test_a_passage_that_many_documents_share_over_many_tasks(spark):
    passage = prose(1, 55)
    rows = [(i, f"{prose(i + 10, 20)} {passage} {prose(i + 500, 20)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for setting in (passages.Settings(), passages.Settings(task_rows=25), passages.Settings(reach=50, task_rows=7)):
        assert covered(passages.repeated_passages(docs, setting).collect()) == repeated_words(rows)


@pytest.mark.parametrize("twice", [1, 2, 3])
def test_every_copy_inside_a_document_meets_the_other_document(spark, twice):
    passage = prose(1, 300)
    once, copies = f"{prose(2, 20)} {passage} {prose(3, 20)}", f"{prose(4, 20)} {passage} {prose(5, 30)} {passage} {prose(6, 20)}"
    rows = [(i, copies if i == twice else once) for i in ((1, 2) if twice < 3 else (1, 2, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for setting in (passages.Settings(), passages.Settings(task_rows=2)):
        assert covered(passages.repeated_passages(docs, setting).collect()) == repeated_words(rows)


def test_runs_longer_than_a_task_meet_the_other_document(spark):
    passage = prose(1, 200)
    rows = [(1, passage), (2, " ".join([passage] * 9)), (3, prose(2, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(passages.repeated_passages(docs, passages.Settings(task_rows=2)).collect()) == repeated_words(rows)


def test_many_items_in_many_blocks(spark):
    items = [(i, prose(1000 + i, 6)) for i in range(10_000)]
    rows = [(d, f"{prose(d, 30)} {items[37 * d][1]} {prose(d + 500, 30)}" if d % 2 else prose(d, 60)) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    size = sum(len(t) for _, t in items)
    setting = decontamination.Settings(block_chars=size // 3)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, bench, setting).collect()}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, bench).collect()}
    assert got >= {(d, 37 * d) for d in range(1, 200, 2)}
    hit = {d for d, _ in got}
    for one in (setting, decontamination.Settings()):
        assert {r["doc_id"] for r in decontamination.uncontaminated(docs, bench, one).collect()} == set(range(200)) - hit
    with pytest.raises(ValueError, match="blocks"):
        decontamination.is_contaminated(docs, bench, setting)


def test_rows_without_items_stay(spark, corner, empty):
    items = spark.createDataFrame([(1, "one two three four five six"), (None, "")], "item_id int, text string")
    flagged = corner.where(~decontamination.is_contaminated(corner, items))
    for setting in (decontamination.Settings(), decontamination.Settings(block_chars=5)):
        left = decontamination.uncontaminated(corner, items, setting)
        assert left.columns == corner.columns
        assert sorted(map(repr, left.collect())) == sorted(map(repr, flagged.collect()))
        assert decontamination.uncontaminated(empty, items, setting).count() == 0
    assert decontamination.uncontaminated(corner, items.limit(0)).count() == corner.count()


def test_nearest_foreign_rows_at_borders_against_a_loop(spark):
    rng = random.Random(5)
    keys = sorted((rng.randint(1, 4), rng.randint(1, 3), at) for at in range(60))
    rng.shuffle(keys)  # neighbours of one seed in any order of documents, as a sort by what follows leaves them
    keys.sort(key=lambda k: k[0])
    cuts = sorted({0, len(keys), *(rng.randrange(len(keys)) for _ in range(25))})
    edges, want = [], set()
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        head = next((k for k in range(lo, hi) if keys[k][:2] != keys[lo][:2]), hi)
        tail = next((k for k in range(hi - 1, lo - 1, -1) if keys[k][:2] != keys[hi - 1][:2]), lo - 1)
        places = {passages._FIRST: lo, passages._LAST: hi - 1}
        if head < hi and keys[head][0] == keys[lo][0]:
            places[passages._BELOW_HEAD] = head
        if tail >= lo and keys[tail][0] == keys[hi - 1][0]:
            places[passages._ABOVE_TAIL] = tail
        edges += [(part, edge, *keys[k], b"a", b"b") for edge, k in places.items()]
        before = next((k for k in range(lo - 1, -1, -1) if keys[k][:2] != keys[lo][:2]), None)
        after = next((k for k in range(hi, len(keys)) if keys[k][:2] != keys[hi - 1][:2]), None)
        for run, own, far in ((passages._HEAD, lo, before), (passages._TAIL, hi - 1, after)):
            if far is not None and keys[far][0] == keys[own][0]:
                want.add((part, run, *keys[far][1:]))
    frame = spark.createDataFrame(edges, "part int, edge int, seed long, doc_id long, at int, after binary, before binary")
    got = passages._foreign(frame).collect()
    assert {(r["part"], r["edge"], r["far_doc"], r["far_at"]) for r in got} == want and len(got) == len(want) > 10


def test_suffixes_of_hot_and_rare_seeds(spark, monkeypatch):
    rows = [(d, d, 1, 0) for d in range(60)] + [(d, d, 2 + d // 2, 1) for d in range(20)] + [(7, 7, 99, k) for k in range(30)]
    kept = spark.createDataFrame(rows, "doc_id long, copy long, seed long, at int")
    for hot in (1, 2, 1000):  # no seed is hot, one is, all are
        monkeypatch.setattr(passages, "HOT", hot)
        got = passages._in_several(kept).select("doc_id", "copy", "seed", "at").collect()
        assert sorted(map(tuple, got)) == sorted(r for r in rows if r[2] != 99)


def test_an_id_with_a_long_and_a_short_text(spark):
    passage, other = prose(1, 60), prose(2, 60)
    rows = [(1, f"{prose(3, 400)} {passage}"), (1, f"{other} {prose(4, 20)}"), (2, f"{prose(5, 30)} {passage} {prose(6, 9)} {other}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(passages.repeated_passages(docs).collect()) == repeated_words(rows)


def test_passage_corner_cases(spark, corner, corner_rows, empty):
    rows = [(i, t) for i, t in corner_rows if i is not None]
    assert covered(passages.repeated_passages(corner).collect()) == repeated_words(rows)
    assert passages.repeated_passages(empty).count() == 0
    alone = spark.createDataFrame([(1, prose(1, 60) + " " + prose(1, 60))], "doc_id long, text string")
    assert passages.repeated_passages(alone).count() == 0  # within one document only


def test_ids_that_are_repeated_with_other_texts(spark):
    a, b, c, d = (prose(k, 60) for k in (1, 2, 3, 4))
    near = " ".join(["other"] + c.split()[1:])
    cases = [
        [(1, a), (5, a), (5, b), (9, b)],
        [(5, a), (5, b), (9, b), (7, c), (8, near), (8, d), (6, d)],
        [(3, a), (3, b), (3, c), (2, near), (4, d), (4, "")],
    ]
    for rows in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for setting in (near_dedup.Settings(percent=85), near_dedup.Settings(percent=85, leader_rounds=0, block=2)):
            got = near_dedup.near_duplicates(docs, setting).collect()
            want = components(rows, 85)
            assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in rows)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(10,0)"])
def test_ids_of_other_types(corner, kind):
    from pyspark.sql import functions as F

    def renamed(frame):
        key = F.lpad(F.col("doc_id").cast("string"), 4, "0") if kind == "string" else F.col("doc_id").cast(kind)
        return frame.withColumn("doc_id", key)

    def rows(frame, *ids):
        plain = [F.col(c).cast("long").alias(c) if c in ids else F.col(c) for c in frame.columns]
        return sorted(map(repr, frame.select(*plain).collect()))

    other = renamed(corner)
    assert rows(near_dedup.near_duplicates(other), "doc_id", "component_id") == rows(near_dedup.near_duplicates(corner))
    assert rows(passages.repeated_passages(other), "doc_id", "other_doc_id") == rows(passages.repeated_passages(corner))
    items = corner.where("doc_id in (7, 9, 13)")
    found = decontamination.find_items(other, renamed(items), item_id="doc_id")
    plain = decontamination.find_items(corner, items, item_id="doc_id")
    assert rows(found, "doc_id", "item_id") == rows(plain)
