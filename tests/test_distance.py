import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txmetrics.functions import distance as ds


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


CASES = [
    ("abc", "abc", 0), ("", "", 0), ("abc", "", 3), ("", "xyz", 3), ("abc", "abcd", 1), ("abcd", "abc", 1),
    ("abc", "axc", 1), ("kitten", "sitting", 3), ("བཀྲ་ཤིས", "བཀྲ་ཤི", 1), ("བཀྲ་ཤིས", "བཀྲ་ཤིས", 0),
]


@pytest.mark.parametrize("method", ["auto", "builtin", "arrow"])
def test_cases(spark, method):
    rows = spark.createDataFrame(CASES, "a STRING, b STRING, d INT")
    got = rows.select("d", ds.edit_distance(F.col("a"), F.col("b"), method).alias("x"), ds.edit_distance(F.col("b"), F.col("a"), method).alias("y"))
    assert all(r.d == r.x == r.y for r in got.collect())


def test_error_rate(spark):
    pairs = [("hello", "hello", 0.0), ("", "", 0.0), ("some text", "", 1.0), ("", "hello", 1.0), ("axc", "abc", 1 / 3), ("abcdef", "ab", 2.0)]
    rows = spark.createDataFrame(pairs, "i STRING, r STRING, e DOUBLE")
    value = ds.cer(ds.edit_distance(F.col("i"), F.col("r")), F.length("i"), F.length("r"))
    assert all(r.e == r.v for r in rows.select("e", value.alias("v")).collect())


def test_rounding_is_half_even(spark):
    row = spark.sql("SELECT 1D / 128 AS a, 3D / 128 AS b").select(ds.round6(F.col("a")), ds.round6(F.col("b"))).first()
    assert tuple(row) == (0.007812, 0.023438)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", max_size=30), max_size=5), st.text("abé", max_size=30))
def test_long_route_against_brute_force(texts, reference):
    assert ds.text_distances(texts, reference) == [brute(x, reference) for x in texts]
    assert ds.full_distances(texts, reference) == [brute(x, reference) for x in texts]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 60))
def test_very_long_route(seed, percent):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 700)))
    noisy = ["".join(rng.choice(["", c + "x", "y"]) if rng.random() * 100 < p else c for c in text) or "z" for p in (percent, 5)]
    assert ds.very_long_distances(noisy, text) == [brute(x, text) for x in noisy]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.text("abc", min_size=1, max_size=30), st.integers(0, 40)), min_size=1, max_size=4),
    st.text("abc", min_size=1, max_size=30),
)
def test_band_is_exact_up_to_its_bound(patterns, text):
    bounds = [abs(len(text) - len(p)) + extra for p, extra in patterns]
    found = ds.band_distances([p for p, _ in patterns], text, bounds)
    for (p, _), bound, d in zip(patterns, bounds, found):
        true = brute(p, text)
        assert d == true if true <= bound else d is None


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_metric_laws(a, b, c):
    d = lambda x, y: ds.text_distances([x], y)[0]
    assert d(a, b) == d(b, a)
    assert (d(a, b) == 0) == (a == b)
    assert d(a, c) <= d(a, b) + d(b, c)


def test_routes_agree_on_long_texts(spark):
    rng = random.Random(7)
    rows = []
    for n in (300, 700, 1500, 5000, 9000):
        text = "".join(rng.choice("abcdefgh éཀ") for _ in range(n))
        noisy = "".join(c for c in text if rng.random() > 0.1).replace("a", "xy")
        rows += [(text, noisy), (text, text), (text, "".join(rng.choice("abc") for _ in range(n)))]
    frame = spark.createDataFrame(rows, "a STRING, b STRING")
    got = frame.select(*[ds.edit_distance(F.col("a"), F.col("b"), m).alias(m) for m in ("auto", "builtin", "arrow")]).collect()
    assert all(r.auto == r.builtin == r.arrow for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=300), min_size=1, max_size=4), st.text("abc", min_size=1, max_size=300), st.integers(1, 70))
def test_bounds_hold(patterns, text, reach):
    true = [brute(p, text) for p in patterns]
    assert all(u >= d for u, d in zip(ds.path_bounds(patterns, text, reach), true))
    assert all(low <= d <= high for (low, high), d in zip((ds._bounds(patterns, text)[p] for p in patterns), true))


def test_bounds_settle_long_texts_or_give_a_tight_band(monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    readings = [text.translate(str.maketrans("abc", "418")), text.replace("e", ""), text.replace("f", "ff"), "X" * 40 + text.replace("d", "4")]
    asked = []
    monkeypatch.setattr(ds, "full_distances", lambda *a: asked.append(a) or [])
    monkeypatch.setattr(ds, "band_distances", lambda *a: asked.append(a) or [])
    assert ds.text_distances(readings[:2], text) == [sum(map(text.count, "abc")), text.count("e")]
    assert ds.text_distances(readings[2:], text) == [text.count("f"), 40 + text.count("d")] and not asked
    monkeypatch.undo()
    mixed = "".join(rng.choice(["", c + "x", "b", "a"]) if rng.random() < 0.08 else c for c in text)
    true = ds.full_distances([mixed], text)
    assert ds.text_distances([mixed], text) == true and ds.path_bounds([mixed], text)[0] <= true[0] + 50
