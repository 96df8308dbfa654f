import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import SF, prose, words
from pyspark.sql import functions as F

from txmetrics.llm import language_id, maxent_lm, quality, queries
from txmetrics.llm.ftrl import Settings, train_logistic


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_leader_learns_and_l1_clears_useless_features():
    random = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(400):
        y = int(random.integers(0, 2))
        noise = int(random.integers(2, 200))
        rows.append((np.array([y, noise]), np.array([1.0, 0.2])))
        labels.append(y)
    w = train_logistic(rows, np.array(labels), 200, Settings(l1=0.5))
    assert w[0] < -1 and w[1] > 1
    assert (w[2:] == 0).mean() > 0.8


def test_long_text_is_counted_whole(monkeypatch):
    text = prose(1, 400)
    whole = language_id.count_features(text)
    monkeypatch.setattr(language_id, "STEP_CHARS", 97)
    assert (language_id.count_features(text) == whole).all()


def test_language_held_out_accuracy(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    out = queries.op1_language_id(spark, SF).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9


def test_language_corner_cases(documents, corner, empty):
    model = language_id.train(documents)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(corner, model).collect()]
    assert len(got) == corner.count()
    unknown = {i for i, lang, _ in got if lang == "und"}
    assert {4, 5, 6} <= unknown and 12 not in unknown and 1 not in unknown
    assert all(s == 0 for _, lang, s in got if lang == "und")
    assert language_id.predict(empty, model).count() == 0
    for nothing in (language_id.train(empty), language_id.train(corner)):  # no row, no label
        assert {r["lang_pred"] for r in language_id.predict(corner, nothing).collect()} == {"und"}


def test_temperature_is_finite_without_errors_and_large_for_guesses():
    y = np.arange(60) % 3
    assert 0.02 < language_id.fit_temperature(np.eye(3)[y] * 5, y) < 20
    random = np.random.default_rng(2).normal(size=(60, 3)) * 50
    assert language_id.fit_temperature(random, y) > 10


def test_too_many_languages_is_an_error(documents):
    with pytest.raises(ValueError):
        language_id.train(documents, max_languages=2)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op2_quality(spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.93
    good = [r["score"] for r in held if truth[r["doc_id"]]]
    bad = [r["score"] for r in held if not truth[r["doc_id"]]]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95


def test_quality_corner_cases(spark, corner, empty):
    rows = [(i, prose(i, 30) if i % 2 else "### $$$ " * 9, i % 2) for i in range(60)] + [(99, None, 1), (100, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table, table)
    again = quality.train(table, table.union(table))  # repeated labels count once
    assert (again.weights == model.weights).all() and again.bias == model.bias
    got = [(r["doc_id"], r["score"]) for r in quality.score(corner, model).collect()]
    assert len(got) == corner.count() and all(0 <= s <= 1 for _, s in got)
    blank = [s for i, s in got if i in (4, 5, 6)]
    assert max(blank) == min(blank)
    assert quality.score(empty, model).count() == 0
    assert len({r["score"] for r in quality.score(corner, quality.train(empty, empty)).collect()}) == 1


def test_lm_counts_against_brute_force(spark, document_rows):
    train = Counter()
    for i, text in document_rows:
        if crc(i, 5) != 1:
            train.update(words(text))
            train["\n"] += 1
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in queries.op8_lm_scores(spark, SF).collect()}
    assert set(got) == {i for i, _ in document_rows}
    for i, text in document_rows:
        own = [*words(text), "\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (crc(i, 5) == 1, len(own), n)
        assert r["n_known"] == sum(w in train for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_looks_rare_words_up_by_join_alike(documents):
    few = maxent_lm.Settings(frequent=20)
    one = {r["doc_id"]: r for r in maxent_lm.score(documents, *maxent_lm.train(documents)).collect()}
    two = {r["doc_id"]: r for r in maxent_lm.score(documents, *maxent_lm.train(documents, few)).collect()}
    for i, r in one.items():
        assert r["n_known"] == two[i]["n_known"]
        assert math.isclose(r["base_score"], two[i]["base_score"], rel_tol=1e-9)


def test_lm_is_a_distribution_and_beats_its_start(spark):
    settings = maxent_lm.Settings(bits=8, classes=4, anchors=6)
    rows = [(i, "alpha beta gamma delta " * 20 + f"once{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = maxent_lm.train(docs, settings)
    seen = {r["word"]: r["n"] for r in counts.collect()}
    kind = model.known.classes(np.array(list(seen), np.int64).view(np.uint64))
    share = np.zeros(5)
    for k, n in zip(kind, seen.values()):
        share[k] += (n + 0.5) / 10 ** model.total[k]
    share[4] += 0.5 / 10 ** model.total[4]  # a new word
    assert np.allclose(share[np.unique([*kind, 4])], 1)
    r = maxent_lm.score(docs.limit(1), model, counts).first()
    assert r["score"] > r["base_score"] / 2  # the order of the words is learnt


def test_lm_score_against_a_loop_over_its_tables(spark, documents):
    """Every token by itself: features, softmax and share written out with plain numbers."""
    model, counts = maxent_lm.train(documents)
    n_of = {r["word"] % 2**64: r["n"] for r in counts.collect()}
    class_of = dict(zip(model.known.words.tolist(), model.known.kind.tolist()))
    mask, shift = 2**64 - 1, 64 - model.bits

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    some = documents.orderBy("doc_id").limit(12)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(some, model, counts).collect()}
    for row in some.collect():
        past = [int(maxent_lm.BEFORE)] * 3
        total = 0.0
        for h in maxent_lm.tokens([row["text"]]).hashes.tolist():
            three, two, one = past
            bigram = mix((two * 5 + one) & mask)
            features = [mix(x & mask) >> shift for x in (one * 3, bigram, two * 7, three * 11)]
            z = [math.exp(model.bias[k] + sum(float(model.weights[f, k]) for f in features)) for k in range(len(model.bias))]
            k = class_of.get(h, model.known.rare)
            total += math.log10(z[k] / sum(z)) + math.log10(n_of.get(h, 0) + 0.5) - model.total[k]
            past = [two, one, h]
        assert math.isclose(got[row["doc_id"]], total, rel_tol=1e-4)


def test_lm_sums_of_a_round_against_a_loop(spark):
    """Counts of features with classes, and what the model foresees, summed over tasks and token by token."""
    texts = [f"a b c a{i % 3} b a" for i in range(50)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    model, _ = maxent_lm.train(docs.withColumn("doc_id", F.lit(1)), maxent_lm.Settings(bits=6, classes=2, anchors=3))
    known, bits, classes = model.known, model.bits, len(model.bias)
    size = classes << bits
    weights, bias = model.weights, model.bias.astype(np.float32)
    seen = maxent_lm._total(docs, lambda t, out: maxent_lm.observed(t, out, known, bits), size)
    foreseen = maxent_lm._total(docs, lambda t, out: maxent_lm.expected(t, out, weights, bias, bits), size, np.float32)
    own_seen, own_foreseen = np.zeros((1 << bits, classes)), np.zeros((1 << bits, classes))
    for text in texts:
        t = maxent_lm.tokens([text])
        for kind, *features in zip(known.classes(t.hashes), *maxent_lm.context_features(t, bits)):
            z = np.exp(model.bias + sum(weights[f].astype(float) for f in features))
            for f in features:
                own_seen[f, kind] += 1
                own_foreseen[f] += z / z.sum()
    assert (seen.reshape(own_seen.shape) == own_seen).all()
    assert np.allclose(foreseen.reshape(own_seen.shape), own_foreseen, rtol=1e-4, atol=1e-4)


def test_lm_does_not_depend_on_tasks(documents):
    scores = []
    for tasks in (1, 8, 64):
        model, counts = maxent_lm.train(documents.repartition(tasks))
        scores.append({r["doc_id"]: r["score"] for r in maxent_lm.score(documents, model, counts).collect()})
    for i, value in scores[0].items():
        assert all(math.isclose(value, other[i], rel_tol=1e-5) for other in scores[1:])


def test_lm_held_out_gain_grows_with_the_corpus(spark):
    """The gain a token over the unigrams on held-out documents, and the part of them that gain."""
    gains = []
    for directory in (SF, SF.replace("sf0.001", "sf0.01")):
        rows = [r for r in queries.op8_lm_scores(spark, directory).collect() if r["held_out"]]
        gains.append(sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows))
        assert sum(r["score"] > r["base_score"] for r in rows) > 0.6 * len(rows)
    assert gains[0] > 0.05 and gains[1] > 0.15


def test_lm_corner_cases(corner, empty):
    model, counts = maxent_lm.train(corner)
    got = maxent_lm.score(corner, model, counts).collect()
    assert len(got) == corner.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    nothing, none = maxent_lm.train(empty)
    assert maxent_lm.score(empty, nothing, none).count() == 0
    assert all(r["n_known"] == 0 for r in maxent_lm.score(corner, nothing, none).collect())
