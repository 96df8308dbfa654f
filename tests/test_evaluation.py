import csv

import pytest
from pyspark.sql import functions as F

from txmetrics import sources
from txmetrics.operators import by_batch, grouped_scores, last_wins, micro_average, model_summary, overall
from txmetrics.plans import evaluate, evaluate_directory, result_map, score

OUTPUTS = "model STRING, image_name STRING, batch_id STRING, inference STRING"
TRUTH = "image_name STRING, batch_id STRING, transcript STRING"


def scored(spark, outputs, truth, **options):
    rows = score(spark.createDataFrame(outputs, OUTPUTS), spark.createDataFrame(truth, TRUTH), truth_order=None, **options).collect()
    return {(r.model, r.image_name, r.batch_id): r for r in rows}


def outputs_of(truth, model, change=lambda name, text: text):
    return [(model, name, batch, change(name, text)) for name, batch, text in truth]


def test_models(spark, benchmark_tree):
    truth = sources.load_truth(spark, str(benchmark_tree / "benchmark.csv"))
    data = [(r.image_name, r.batch_id, r.transcript) for r in truth.collect()]
    outputs = (
        outputs_of(data, "perfect")
        + outputs_of(data, "one wrong", lambda n, t: "wrong text" if n == "img_001.png" else t)
        + outputs_of(data, "silent", lambda n, t: "")
    )
    result = evaluate(spark.createDataFrame(outputs, OUTPUTS), truth)
    totals = {r.model: r.overall_cer for r in result.overall.collect()}
    assert totals["perfect"] == 0.0 and totals["silent"] == 1.0 and totals["one wrong"] > 0
    batches = {(r.model, r.batch_id): (r.cer, r["count"]) for r in result.per_batch.collect()}
    assert batches[("one wrong", "batch-2")] == (0.0, 1)
    assert batches[("one wrong", "batch-1")][1] == 2
    assert len(batches) == 6
    nested = {r.model: r for r in result_map(result.per_batch, result.overall).collect()}
    assert nested["silent"].per_batch["batch-1"].asDict() == {"cer": 1.0, "count": 2}


def test_edges(spark):
    truth = [("a", "1", "x" * 128), ("b", "1", ""), ("c", "1", None), ("d", "1", "unscored"), ("n", None, "null batch")]
    outputs = [
        ("m", "a", "1", "x" * 127 + "y"), ("m", "a", "1", "x" * 128), ("m", "b", "1", ""), ("m", "b", "2", ""), ("m", "c", "1", "t"),
        ("m", "zz", "1", "unknown"), ("m", "n", None, "null batch"), ("m", "e", "1", None),
    ]
    rows = score(spark.createDataFrame(outputs, OUTPUTS), spark.createDataFrame(truth, TRUTH), truth_order=None)
    got = sorted((r.image_name, r.batch_id or "", round(r.cer, 9)) for r in rows.collect())
    assert got == [
        ("a", "1", 0.0), ("a", "1", 0.0078125), ("b", "1", 0.0), ("b", "2", 0.0), ("c", "1", 1.0), ("e", "1", 0.0), ("n", "", 0.0),
        ("zz", "1", 1.0),
    ]
    one = rows.where("image_name = 'a' AND distance = 1")
    assert by_batch(one).first().cer == 0.007812


def test_last_truth_wins(spark):
    truth = spark.createDataFrame(
        [("a", "1", "old", 1), ("a", "1", "new", 2), (None, "1", "x", 1), (None, "1", None, 5)], TRUTH + ", _pos INT"
    )
    got = {r.image_name: r.transcript for r in last_wins(truth, ["image_name", "batch_id"], "_pos").collect()}
    assert got == {"a": "new", None: None}
    outputs = spark.createDataFrame([("m", "a", "1", "new")], OUTPUTS)
    assert [r.distance for r in score(outputs, truth).collect()] == [0]
    renamed = truth.withColumnRenamed("_pos", "version")
    assert [r.distance for r in score(outputs, renamed, truth_order="version").collect()] == [0]
    with pytest.raises(ValueError, match="position"):
        score(outputs, renamed)


def test_normalisation_is_off_by_default(spark):
    truth, outputs = [("a", "1", "h\u00e9 llo")], [("m", "a", "1", " he\u0301   llo\n")]
    key = ("m", "a", "1")
    assert scored(spark, outputs, truth)[key].distance == 6
    assert scored(spark, outputs, truth, whitespace=True)[key].distance == 2
    assert scored(spark, outputs, truth, unicode_form="NFC")[key].distance == 4
    assert scored(spark, outputs, truth, whitespace=True, unicode_form="NFC")[key].distance == 0
    cleaned = scored(spark, [("m", "a", "1", "ཀ་་ཁ་།")], [("a", "1", "ཀ་ཁ།")], script=True)
    assert cleaned[key].distance == 0


def test_aggregates(spark):
    scores = spark.createDataFrame(
        [("v2.5_x", "batch-1", 0.1, 1, 10), ("v2.5_x", "batch-1", 0.3, 3, 10), ("v2.5_x", "2", 1.0, 5, 0), ("m", "2", 0.5, 1, 2)],
        "model STRING, batch_id STRING, cer DOUBLE, distance INT, ref_len INT",
    )
    wide = {r.model: r for r in model_summary(scores).collect()}
    assert model_summary(scores).columns == ["model", "overall_cer", "cer_2", "cer_batch-1"]
    assert (wide["v2.5_x"]["cer_batch-1"], wide["v2.5_x"]["cer_2"], wide["m"]["cer_batch-1"]) == (0.2, 1.0, None)
    assert wide["v2.5_x"].overall_cer == 0.466667
    totals = {r.model: (r.overall_cer, r["count"]) for r in overall(scores, ["m", "none"]).collect()}
    assert totals == {"m": (0.5, 1), "none": (0.0, 0)}
    sets = {(r.model, r.batch_id, r.is_overall): (r.cer, r["count"]) for r in grouped_scores(scores).collect()}
    assert sets[("v2.5_x", None, 1)] == (0.466667, 3) and sets[("v2.5_x", "batch-1", 0)] == (0.2, 2)
    micro = {r.model: r.micro_cer for r in micro_average(scores).collect()}
    assert micro == {"v2.5_x": 0.45, "m": 0.5}


def test_evaluate_directory(spark, benchmark_tree, tmp_path):
    out = tmp_path / "models"
    out.mkdir()
    truth = benchmark_tree / "benchmark.csv"
    with open(truth, encoding="utf-8") as f:
        data = [(r["image_name"], r["batch_id"], r["transcript"]) for r in csv.DictReader(f)]
    for model, text in (("v2.5 exact", lambda t: t), ("blank", lambda t: "")):
        with open(out / f"{model}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([("image_name", "batch_id", "inference"), *[(n, b, text(t)) for n, b, t in data]])
    result = evaluate_directory(spark, str(out), str(truth), str(tmp_path / "all"))
    assert {r.model: r.overall_cer for r in result.overall.collect()} == {"v2.5 exact": 0.0, "blank": 1.0}
    summary = sources.scan_csv(spark, str(tmp_path / "all" / "summary.csv"))
    assert summary.columns == ["model", "overall_cer", "cer_batch-1", "cer_batch-2"]
    exported = sources.load_scores(spark, str(tmp_path / "all" / "per_image"))
    assert exported.count() == 6 and exported.where("model = 'blank' AND cer = 1").count() == 3
    single = evaluate_directory(spark, str(out), str(truth), str(tmp_path / "one"), model="blank")
    assert [r.model for r in single.overall.collect()] == ["blank"]
    assert not (tmp_path / "one" / "summary.csv").exists()
    with pytest.raises(FileNotFoundError):
        evaluate_directory(spark, str(out), str(truth), str(tmp_path / "none"), model="absent")


def test_hot_image_is_split_at_run_time(spark):
    """One image with most of the outputs: the join must split it, and lose nothing."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        outputs = spark.range(0, 30000, 1, 8).select(
            F.lit("m").alias("model"),
            F.when(F.col("id") % 3 > 0, F.concat(F.lit("i"), "id")).otherwise(F.lit("hot")).alias("image_name"),
            F.lit("1").alias("batch_id"),
            F.sha2(F.col("id").cast("string"), 512).alias("inference"),
        )
        truth = outputs.select("image_name", "batch_id").distinct().withColumn("transcript", F.lit("abc"))
        scores = by_batch(score(outputs, truth, truth_order=None))
        assert [r["count"] for r in scores.collect()] == [30000]
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k in names:
            spark.conf.unset(k)


def test_averages_do_not_depend_on_the_order_of_rows(spark):
    from txmetrics.plans import score_map

    values = [(f"m{k % 2}", f"i{k}", f"b{k % 3}", (k * 7919 % 1009) / (1 + k % 97)) for k in range(3000)]
    schema = "model string, image_name string, batch_id string, cer double"
    jobs = (by_batch, overall, grouped_scores, model_summary, score_map)
    found = []
    for parts, rows in ((1, values), (8, values[::-1]), (64, sorted(values, key=lambda r: r[3]))):
        scores = spark.createDataFrame(rows, schema).repartition(parts)
        found.append([sorted(map(repr, job(scores).collect())) for job in jobs])
    assert found[0] == found[1] == found[2]


def test_average_of_a_tie_and_of_odd_numbers(spark):
    from txmetrics.operators.aggregates import average6

    def mean(values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(average6(F.col("v"))).first()[0]

    assert mean([0.105996, 0.105997]) == 0.105996 and mean([0.105997, 0.105998]) == 0.105998  # half to even
    assert mean([]) is None and mean([None, None]) is None and mean([None, 0.5]) == 0.5
    assert mean([1e300, 1.0]) == 5e299 and mean([float("inf"), 1.0]) == float("inf")
    assert mean([float("nan"), 1.0]) != mean([float("nan"), 1.0])


@pytest.mark.parametrize("more, shuffled_twice", [([], False), ([(None, "1", "n")], False), ([("a", "1", "last")], True), ([(None, "1", "n"), (None, "1", "m")], True)])
def test_truth_without_repeated_keys_is_shuffled_once(spark, tmp_path, monkeypatch, more, shuffled_twice):
    from txmetrics.plans import evaluation

    asked = []
    monkeypatch.setattr(evaluation, "last_wins", lambda *args: asked.append(1) or last_wins(*args))
    outputs = [("a", "1", "last"), ("b", "1", "b"), (None, "1", "m"), ("b", "2", "x")]
    truth = [("a", "1", "a"), ("b", "1", "b"), *more]
    for name, table in (("out/m.csv", [("image_name", "batch_id", "inference"), *outputs]), ("truth.csv", [("image_name", "batch_id", "transcript"), *truth])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows(table)
    result = evaluate_directory(spark, str(tmp_path / "out"), str(tmp_path / "truth.csv"), str(tmp_path / "result"))
    last = {(name, batch): text for name, batch, text in truth}
    expected = {(n, b): (0 if last.get((n, b), "") == text else max(len(text), len(last.get((n, b), "")))) for n, b, text in outputs}
    got = {(r.image_name, r.batch_id): r.distance for r in result.scores.collect()}
    expected["a", "1"] = 0 if last["a", "1"] == "last" else 3
    assert got == expected and bool(asked) == shuffled_twice
