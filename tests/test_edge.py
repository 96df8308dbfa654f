"""Nothing is lost at the edge: odd files, odd names, odd sessions."""

import os
import sys
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle

from txmetrics import sources
from txmetrics.operators import last_wins, widen_scores
from txmetrics.plans import Provider, batch_infer, evaluate_directory, score_map
from txmetrics.sinks import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER = "image_name,batch_id,inference\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)


def test_a_row_with_a_cell_too_many_raises_and_a_short_one_ends_in_null(spark, tmp_path):
    write(tmp_path / "long" / "m.csv", HEADER + "a,b,one, two\n")
    with pytest.raises(Exception, match="more cells than the header"):
        sources.scan_outputs(spark, str(tmp_path / "long")).count()  # also if no column is read
    write(tmp_path / "short" / "m.csv", HEADER + "a,b\n")
    assert [r.inference for r in sources.scan_outputs(spark, str(tmp_path / "short")).collect()] == [None]


def test_last_part_wins_however_large_the_parts_are(spark, tmp_path):
    head = "image_name,batch_id,transcript\n"
    write(tmp_path / "truth" / "part-00000.csv", head + "a,1,first\n")
    write(tmp_path / "truth" / "part-00001.csv", head + "a,1,LAST\n" + "".join(f"x{i},1,{'y' * 200}\n" for i in range(500)))
    truth = sources.load_truth(spark, str(tmp_path / "truth"))
    got = {r.image_name: r.transcript for r in last_wins(truth, ["image_name", "batch_id"], "_pos").collect()}
    assert got["a"] == "LAST" and len(got) == 501


def test_every_part_is_bound_by_its_own_header(spark, tmp_path):
    write(tmp_path / "model=m" / "part-0.csv", HEADER + "i1,b1,t1\n")
    write(tmp_path / "model=m" / "part-1.csv", "\ufeff batch_id , image_name,inference,note\nb2,i2,t2,n\n")
    write(tmp_path / "n.csv" / "part-0.csv", HEADER + "i3,b3,t3\n")
    write(tmp_path / "n.csv" / "part-1.csv", "inference,batch_id,image_name\nt4,b4,i4\n")
    rows = {tuple(r)[:4] for r in sources.scan_outputs(spark, str(tmp_path)).collect()}
    assert rows == {("m", "i1", "b1", "t1"), ("m", "i2", "b2", "t2"), ("n", "i3", "b3", "t3"), ("n", "i4", "b4", "t4")}
    write(tmp_path / "model=m" / "part-2.csv", "image_name,inference\ni5,t5\n")
    with pytest.raises(ValueError, match="batch_id"):
        sources.scan_outputs(spark, str(tmp_path))


def test_names_with_pattern_characters_and_files_of_no_bytes(spark, tmp_path):
    for name in ("m[1]", "m{a,b}", "m*", "plain"):
        write(tmp_path / f"{name}.csv", HEADER + f"i,b,{name[:2]}\n")
    assert {r.model for r in sources.scan_outputs(spark, str(tmp_path)).collect()} == {"m[1]", "m{a,b}", "m*", "plain"}
    assert [r.model for r in sources.scan_outputs(spark, str(tmp_path), "m[1]").collect()] == ["m[1]"]
    write(tmp_path / "void.csv", "")
    with pytest.raises(ValueError, match="no header"):
        sources.scan_outputs(spark, str(tmp_path))


def test_a_cluster_needs_a_shared_folder():
    def session(master, conf=None, checkpoint=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf), sparkContext=context)

    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, conf="s3a://b/c")) == "s3a://b/c"
        assert shared_folder(session(master, checkpoint="hdfs:/c")) == "hdfs:/c"
    assert os.path.isdir(shared_folder(session("local[4]"))) and os.path.isdir(shared_folder(session("local")))


def test_wide_scores_forbid_repeats_unless_asked(spark):
    scores = spark.createDataFrame([("m", "i", "b", 0.1), ("m", "i", "b", 0.2)], "model STRING, image_name STRING, batch_id STRING, cer DOUBLE")
    with pytest.raises(Exception, match="scored more than once"):
        widen_scores(scores).collect()
    assert widen_scores(scores, duplicates="multiply").count() == 2


def test_averages_of_rows_without_a_batch(spark):
    scores = spark.createDataFrame([("m", None, 0.5), ("m", "b", 1.0)], "model STRING, batch_id STRING, cer DOUBLE")
    row = score_map(scores).first()
    assert row.overall_cer == 0.75 and {k: v.cer for k, v in row.per_batch.items()} == {"": 0.5, "b": 1.0}


def test_summary_is_written_for_two_models_only(spark, tmp_path):
    write(tmp_path / "one" / "m.csv", HEADER + "i,b,t\n")
    write(tmp_path / "truth.csv", "image_name,batch_id,transcript\ni,b,t\n")
    evaluate_directory(spark, str(tmp_path / "one"), str(tmp_path / "truth.csv"), str(tmp_path / "r1"))
    assert not os.path.exists(tmp_path / "r1" / "summary.csv")
    write(tmp_path / "one" / "n.csv", HEADER + "i,b,x\n")
    evaluate_directory(spark, str(tmp_path / "one"), str(tmp_path / "truth.csv"), str(tmp_path / "r2"))
    assert os.path.exists(tmp_path / "r2" / "summary.csv")


def test_a_start_that_fails_in_one_task_keeps_the_rest(spark):
    def fragile(settings):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            raise RuntimeError("no memory")

    images = spark.createDataFrame([(f"i{k}.png", "b") for k in range(8)], "image_name STRING, batch_id STRING").repartition(2)
    stored = spark.createDataFrame([("m", "b", "i0", "plain", "stored")], "model STRING, batch_id STRING, stem STRING, kind STRING, raw STRING")
    provider = Provider(lambda image, settings, state: "fresh", init=fragile)
    done = batch_infer(images, {"m": {"provider": "p"}}, {"p": provider}, stored, max_parallel=2)
    got = {r.image_name: r.inference for r in done.outputs.collect()}
    assert got["i0.png"] == "stored" and set(got.values()) == {"stored", "fresh"}
    status = done.status.first()
    assert status.ok and status.error == "RuntimeError: no memory"
    assert status.answered + status.unanswered == 7 and status.answered == len(got) - 1 > 0


def test_image_bytes_are_moved_once_and_not_with_the_keys(spark):
    images = spark.createDataFrame([(f"i{k}.png", "b", b"x") for k in range(8)], "image_name STRING, batch_id STRING, content BINARY")
    from txmetrics.plans import plan_work, split_cached
    from txmetrics.plans.inference import with_content

    stored = spark.createDataFrame([("m", "b", "i0", "plain", "s")], "model STRING, batch_id STRING, stem STRING, kind STRING, raw STRING")
    provider = {"p": Provider(lambda image, settings, state: "")}
    models = {m: {"provider": "p"} for m in ("m", "n", "o")}
    work, _ = plan_work(images.drop("content"), models, provider)
    done, pending = split_cached(work, stored)
    for part in (done, pending):
        exchanges = [x for x in part._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert exchanges and "content" not in part.columns and not any("content" in x for x in exchanges)
    whole = with_content(pending, images)
    assert whole.count() == 23 and {bytes(r.content) for r in whole.collect()} == {b"x"}
