import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from brute import SF, components, contained, personal, prose
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from txmetrics.llm import queries
from txmetrics.llm.sentencepieces import CharacterMap, PieceModel, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceModel(PATH)


@given(st.lists(st.text(st.sampled_from("ab é日▁ \n\t\0<s>🎉."), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_and_spans_for_any_text(texts):
    found = MODEL.ids(texts)
    assert found == MODEL.library.encode(texts)
    import numpy as np

    for text, ids in zip(texts, found):
        starts, ends = MODEL.spans(text, np.array(ids, np.int64))
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data
        slow = PieceModel.__new__(PieceModel)
        slow.__dict__ = MODEL.__dict__ | {"by_word": False}
        assert [x.tolist() for x in slow.spans(text, np.array(ids, np.int64))] == [starts.tolist(), ends.tolist()]


def double_array(entries):
    """A small trie in the compiled form: entries map byte strings to offsets."""
    tree: dict = {}
    for key, value in entries.items():
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[0] = value
    units, used, bases = {0: 0}, {0}, set()

    def place(node, at):
        base = 1
        labels = list(node)
        while base in bases or any((base ^ b) in used for b in labels):
            base += 1
        bases.add(base)
        used.update(base ^ b for b in labels)
        units[at] |= ((base ^ at) << 10) | ((1 << 8) if 0 in node else 0)
        for b, child in node.items():
            units[base ^ b] = (0x80000000 | child) if b == 0 else b
        for b, child in node.items():
            if b:
                place(child, base ^ b)

    place(tree, 0)
    return struct.pack(f"<{max(units) + 1}I", *[units.get(k, 0) for k in range(max(units) + 1)])


def test_longest_prefix_and_alignment():
    strings = b"x\0yz\0 \0"
    trie = double_array({"é".encode(): 0, "éa".encode(): 2, b"\t": 5})
    cmap = CharacterMap(struct.pack("<I", len(trie)) + trie + strings)
    data = "béaé\t日é".encode()
    out, begin, end = cmap.apply(data)
    assert out == "byzx 日x".encode()
    assert [(a, b) for a, b in zip(begin.tolist(), end.tolist())] == [(0, 1), (1, 4), (1, 4), (4, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 12)]


def test_normaliser_trims_and_squeezes_spaces():
    model = PieceModel.__new__(PieceModel)
    model.__dict__ = MODEL.__dict__ | {"squeeze": True}
    normal, begin, end = model.normalise("  a   b ")
    assert normal.decode() == "▁a▁b" and len(begin) == len(end) == len(normal)
    assert begin[3] == 2 and begin[-1] == 6


def test_digests_of_all_documents(spark, document_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r["doc_id"]: r for r in queries.op9_sentencepiece(spark, SF).collect()}
    assert len(got) == len(document_rows)
    for i, text in document_rows:
        ids = library.encode(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoding_corner_cases(corner, corner_rows, empty):
    got = encode(corner, PATH).collect()
    assert len(got) == len(corner_rows)
    assert all(r["ids"] == [] and r["decoded"] == "" for r in got if r["doc_id"] in (4, 5))
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t in corner_rows)
    assert encode(empty, PATH).count() == 0


def test_every_stage_against_brute_force(spark, documents, document_rows):
    stages = dict(corpus_pipeline.STAGES)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def rows(df):
        return {r["doc_id"]: r for r in df.collect()}

    told = stages["language_id"](spark, documents, SF)
    assert told.columns == documents.columns
    assert set(rows(told)) == {i for i, t in document_rows if t and any(c.isalpha() for c in t)}
    single = stages["near_duplicates"](spark, documents, SF)
    assert set(rows(single)) == set(components(document_rows, 80).values())
    assert sorted(single.columns) == sorted(documents.columns)
    clean = stages["decontamination"](spark, documents, SF)
    assert set(rows(clean)) == {i for i, _ in document_rows} - {d for d, *_ in contained(document_rows, items)}
    masked = rows(stages["pii"](spark, documents, SF))
    assert set(masked) == {i for i, _ in document_rows}
    for i, text in document_rows:
        assert sum(personal(masked[i]["text"])[0]) == 0
        assert masked[i]["n_chars"] == len(masked[i]["text"])
        if not sum(personal(text)[0]):
            assert "<card>" not in masked[i]["text"] and "<ip>" not in masked[i]["text"]


def test_run_is_the_stages_in_order(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, SF).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "sentencepiece"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_corner_cases(spark, corner, empty, name):
    docs = corner.drop("quality", "words", "ids", "node", "bucket")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.count() <= docs.count()
    if name != "sentencepiece":
        assert sorted(out.columns) == sorted(docs.columns)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, SF).count() == 0


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [
        (1, a, "en", "x"), (5, a, "en", "y"), (5, b, "en", "x"), (9, b, "en", "x"),  # 5 is a copy of 1 and 9 one of 5
        (7, c, "de", "y"), (7, c, "de", "x"), (7, c, "de", None),  # copies that differ in other columns
        (8, "", None, None), (8, prose(4, 9), "fr", None), (2, None, None, "x"), (2, " ", None, "x"), (None, a, "en", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for parts in (1, 5):
        out = corpus_pipeline.without_near_duplicates(spark, docs.repartition(parts), SF).collect()
        got = sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in out)
        assert got == sorted([(1, a, "x"), (7, c, "x"), (8, prose(4, 9), ""), (2, " ", "x"), (0, a, "x")])
