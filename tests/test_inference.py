import os
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from txmetrics.plans import Provider, batch_infer, plan_work, split_cached
from txmetrics.plans.inference import append_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE = "model STRING, batch_id STRING, stem STRING, kind STRING, raw STRING"


def plain(image, settings, state):
    if image["image_name"].startswith("bad"):
        raise ValueError("unreadable")
    return f"  {state}:{image['image_name']} \n"


def structured(image, settings, state):
    if image["image_name"].startswith("bad"):
        return "", ""
    line = '{"raw_transcription":"%s","normalized_text":"","confidence_score":1,"orientation":"h","bounding_box":[1]}'
    return image["image_name"], '{"lines":[' + line % image["image_name"] + "]}"


def no_start(settings):
    raise RuntimeError("no weights")


PROVIDERS = {
    "local": Provider(plain, init=lambda s: s["tag"], kind=None),
    "plain": Provider(plain, init=lambda s: s["tag"]),
    "structured": Provider(structured, kind="structured"),
    "broken": Provider(plain, init=no_start),
}
MODELS = {
    "default.1": {"tag": "d"},
    "p": {"provider": "plain", "tag": "p"},
    "s": {"provider": "structured"},
    "x": {"provider": "broken", "tag": "x"},
    "u": {"provider": "who"},
}


@pytest.fixture
def images(spark):
    return spark.createDataFrame([("a.png", "b1"), ("a.tif", "b1"), ("bad.png", "b2")], "image_name STRING, batch_id STRING")


def texts(df):
    return {(r.model, r.image_name): r.inference for r in df.collect()}


def test_plan(spark, images):
    work, skipped = plan_work(images, MODELS, PROVIDERS)
    assert work.count() == 12 and [m for m, _ in skipped] == ["u"]
    assert plan_work(images, {"u": {"provider": "who"}}, PROVIDERS)[0].count() == 0
    assert "Cartesian" not in work._jdf.queryExecution().executedPlan().toString()


def test_run_and_resume(spark, images, tmp_path):
    first = batch_infer(images, MODELS, PROVIDERS, max_parallel=2)
    got = texts(first.outputs)
    assert got[("default.1", "a.png")] == "d:a.png" and got[("p", "bad.png")] == "" and got[("s", "a.tif")] == "a.tif"
    assert {m for m, _ in got} == {"default.1", "p", "s"} and len(got) == 9
    status = {r.model: (r.ok, r.error) for r in first.status.collect()}
    assert status["x"] == (False, "RuntimeError: no weights") and status["u"][0] is False and status["p"] == (True, None)

    append_cache(first.cache_rows, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    stored = {(r.model, r.batch_id, r.stem): r.raw for r in cache.collect()}
    assert stored[("p", "b1", "a")].startswith("p:a.") and ("p", "b2", "bad") not in stored
    assert {m for m, _, _ in stored} == {"p", "s"}

    work, _ = plan_work(images, MODELS, PROVIDERS)
    done, pending = split_cached(work, cache)
    assert {(r.model, r.image_name) for r in done.collect()} == {("p", "a.png"), ("p", "a.tif"), ("s", "a.png"), ("s", "a.tif")}
    assert pending.count() == 8
    second = batch_infer(images, MODELS, PROVIDERS, cache)
    again = texts(second.outputs)
    assert set(again) == set(got)
    # both images with the stem share the stored response
    assert again[("p", "a.png")] == again[("p", "a.tif")] == stored[("p", "b1", "a")]


def test_failures_in_cache(spark, images):
    kept = batch_infer(images, MODELS, PROVIDERS, cache_failures=True).cache_rows
    rows = {(r.model, r.stem): r.raw for r in kept.collect()}
    assert rows[("p", "bad")] == "" and ("s", "bad") not in rows and not any(m in ("x", "default.1") for m, _ in rows)


def test_latest_response_wins(spark, images):
    cache = spark.createDataFrame([("p", "b1", "a", "plain", "old", 1), ("p", "b1", "a", "plain", "new", 2)], CACHE + ", t INT")
    cache = cache.withColumn("written", F.timestamp_seconds("t")).drop("t")
    work, _ = plan_work(images, {"p": MODELS["p"]}, PROVIDERS)
    done, pending = split_cached(work, cache)
    assert {r.text for r in done.collect()} == {"new"} and done.count() == 2 and pending.count() == 1


def fragile(image, settings, state):
    """Notes each call in a file; kills its worker at one image the first time."""
    with open(settings["calls"], "a") as log:
        log.write(f"{image['image_name']} {len(image.get('content') or b'')}\n")
    if image["image_name"] == settings["deadly"] and not os.path.exists(settings["killed"]):
        open(settings["killed"], "w").close()
        os._exit(1)
    if image["image_name"] == "i3.png":
        raise ValueError("unreadable")
    return "text of " + image["image_name"]


@pytest.mark.parametrize("content", [False, True])
def test_a_killed_run_goes_on_from_its_journal(spark, tmp_path, content):
    names = [f"i{k}.png" for k in range(24)]
    images = spark.createDataFrame([(n, None if n == "i5.png" else "b", n.encode()) for n in names], "image_name STRING, batch_id STRING, content BINARY")
    images = images if content else images.drop("content")
    log, journal = tmp_path / "calls", str(tmp_path / "journal")
    models = {"m": {"provider": "fragile", "calls": str(log), "killed": str(tmp_path / "killed"), "deadly": "i7.png"}}
    providers = {"fragile": Provider(fragile, kind=None)}
    run = lambda: batch_infer(images, models, providers, journal=journal, chunk_rows=5)
    with pytest.raises(Exception) as failure:
        run()
    before = Counter(line.split()[0] for line in log.read_text().splitlines())
    held = spark.read.parquet(journal) if os.path.isdir(journal) else None
    committed = {r.image_name for r in held.collect()} if held is not None else set()
    assert "i7.png" not in committed and len(before) < 24 and str(journal) in "".join(failure.value.__notes__)
    result = run()
    after = Counter(line.split()[0] for line in log.read_text().splitlines())
    assert all(after[n] == before[n] == 1 for n in committed) and set(after) == set(names)
    assert {(r.image_name, r.inference) for r in result.outputs.collect()} == {(n, "" if n == "i3.png" else "text of " + n) for n in names}
    assert result.status.first()["answered"] == 24
    assert run().outputs.count() == 24 and Counter(line.split()[0] for line in log.read_text().splitlines()) == after
    if content:
        assert all(int(line.split()[1]) == len(line.split()[0]) for line in log.read_text().splitlines())
    fewer = batch_infer(images.where("image_name < 'i2'"), models, providers, journal=journal)
    assert {r.image_name for r in fewer.outputs.collect()} == {n for n in names if n < "i2"}


def test_a_model_that_did_not_start_is_pending_again_in_its_journal(spark, images, tmp_path):
    journal = str(tmp_path / "journal")
    models = {"x": {"provider": "broken", "tag": "x"}, "p": {"provider": "plain", "tag": "p"}}
    first = batch_infer(images, models, PROVIDERS, journal=journal)
    assert {r.model: (r.answered, r.unanswered) for r in first.status.collect()} == {"x": (0, 3), "p": (3, 0)}
    again = batch_infer(images, models, PROVIDERS | {"broken": PROVIDERS["plain"]}, journal=journal)
    assert {r.model: (r.answered, r.unanswered) for r in again.status.collect()} == {"x": (3, 0), "p": (3, 0)}
    assert texts(again.outputs)[("x", "a.png")] == "x:a.png"


def test_images_are_joined_once_for_all_chunks(spark, tmp_path, monkeypatch):
    from txmetrics.plans import inference

    rows = [(f"i{k}.png", None if k == 3 else "b", f"text {k}".encode()) for k in range(40)]
    images = spark.createDataFrame([*rows, rows[0]], "image_name STRING, batch_id STRING, content BINARY")
    each = Provider(lambda image, settings, state: image["content"].decode(), kind=None)
    joins, join = [], inference.same_key
    monkeypatch.setattr(inference, "same_key", lambda *a: joins.append(a) or join(*a))
    found = batch_infer(images, {"m": {"provider": "each"}, "n": {"provider": "each"}}, {"each": each}, journal=str(tmp_path / "j"), chunk_rows=8)
    assert len(joins) == 1
    got = Counter((r.model, r.image_name, r.inference) for r in found.outputs.collect())
    assert set(got) == {(m, n, c.decode()) for m in "mn" for n, _, c in rows}
    assert {(r.model, r.answered) for r in found.status.collect()} == {("m", 41), ("n", 41)}
