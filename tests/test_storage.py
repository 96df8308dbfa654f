"""Trees of files: listed, read and written by tasks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from txmetrics.plans import lay_out
from txmetrics.sources import image_bytes, image_listing, images_of, list_tree, read_files, read_manifest, refresh_manifest, transcript_files, write_files
from txmetrics.sources.storage import file_system


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a tree +%20é"
    for batch, name, text in (
        ("b1", "x.png", "one"), ("b1", "empty.png", ""), ("b 2", "ü é+%.tif", "two"), ("b 2", "no_suffix", "three"), ("b1", ".hidden", "h"), ("b1", "_not", "h"), ("_b", "y.png", "h"),
    ):
        (root / "images" / batch).mkdir(parents=True, exist_ok=True)
        (root / "images" / batch / name).write_text(text)
    (root / "images" / "stray.png").write_text("s")
    (root / "images" / "b1" / "deeper").mkdir()
    (root / "images" / "b1" / "deeper" / "z.png").write_text("d")
    (root / "images" / "bare").mkdir()
    return root


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_listing_made_by_tasks_is_that_of_the_file_source(spark, tree):
    columns = ("batch_id", "image_name", "stem", "suffix", "mime_type", "length")
    listed = images_of(list_tree(spark, f"{tree}/images"))
    assert rows(listed, *columns) == rows(image_listing(spark, str(tree)), *columns)
    assert [(r[0], r[1], r[5]) for r in rows(listed, *columns)] == [("_b", "y.png", 1), ("b 2", "no_suffix", 5), ("b 2", "ü é+%.tif", 3), ("b1", "empty.png", 0), ("b1", "x.png", 3)]
    assert rows(list_tree(spark, f"file:{tree}/images", ".tif"), "name") == [("ü é+%.tif",)]
    assert len(rows(list_tree(spark, f"{tree}/images", hidden=True), "name")) == 7
    assert list_tree(spark, f"{tree}/nothing").count() == 0


def test_bytes_are_read_by_the_task_of_their_row(spark, tree):
    found = image_bytes(spark, str(tree), "language", manifest=list_tree(spark, f"{tree}/images"))
    assert rows(found, "image_name", "content", "native") == rows(image_bytes(spark, str(tree), "language"), "image_name", "content", "native")
    one = image_bytes(spark, str(tree), "vision", "b1", manifest=list_tree(spark, f"{tree}/images"))
    assert rows(one, "image_name") == [("empty.png",), ("x.png",)]
    nothing = spark.createDataFrame([(None, 1)], "path STRING, content INT")
    assert read_files(nothing).collect() == [(None, None)]
    with pytest.raises(Exception, match="gone.png"):
        read_files(spark.createDataFrame([(f"{tree}/gone.png",)], "path STRING")).collect()


def test_files_are_passed_on_a_few_at_a_time(spark, tree, monkeypatch):
    from txmetrics.sources import storage

    monkeypatch.setattr(storage, "STEP_BYTES", 4)
    found = read_files(list_tree(spark, f"{tree}/images").select("name", "path").coalesce(1))
    assert rows(found, "name", "content") == [("empty.png", b""), ("no_suffix", b"three"), ("x.png", b"one"), ("y.png", b"h"), ("ü é+%.tif", b"two")]


def test_a_manifest_follows_its_tree(spark, tree, tmp_path, monkeypatch):
    from txmetrics.sources import storage

    top, store = f"{tree}/images", str(tmp_path / "manifest")
    assert read_manifest(spark, store) is None
    long_ago = time.time() - 3600
    for folder in ("b1", "b 2", "_b"):
        os.utime(f"{top}/{folder}", (long_ago, long_ago))
    first = rows(refresh_manifest(spark, top, store), "batch_id", "name")
    assert first == rows(read_manifest(spark, store), "batch_id", "name") and len(first) == 5
    # what only changes inside a file is not seen, until all folders are listed
    (tree / "images" / "b1" / "x.png").write_text("longer")
    (tree / "images" / "b 2" / "new.png").write_text("n")
    (tree / "images" / "b3").mkdir()
    (tree / "images" / "b3" / "n.png").write_text("n")
    listed = []
    plain = storage.list_files
    monkeypatch.setattr(storage, "list_files", lambda folders, *a: listed.append(rows(folders, "batch_id")) or plain(folders, *a))
    found = rows(refresh_manifest(spark, top, store), "batch_id", "name", "length")
    assert listed.pop() == [("b 2",), ("b3",), ("bare",)]
    assert ("b1", "x.png", 3) in found and ("b 2", "new.png", 1) in found and ("b3", "n.png", 1) in found and len(found) == 7
    assert ("b1", "x.png", 6) in rows(refresh_manifest(spark, top, store, full=True), "batch_id", "name", "length")
    for path in (tree / "images" / "b3" / "n.png", tree / "images" / "b1" / "x.png"):
        path.unlink()
    (tree / "images" / "b3").rmdir()
    assert {r[0] for r in rows(refresh_manifest(spark, top, store), "name")} == {"empty.png", "ü é+%.tif", "no_suffix", "new.png", "y.png"}
    assert rows(refresh_manifest(spark, f"{tree}/nothing", store, full=True), "name") == [] == rows(read_manifest(spark, store), "name")


def test_written_files_are_whole_and_found_again(spark, tmp_path):
    data = [(f"{tmp_path}/out/transcripts/b{k % 2}/é {k}.txt", f"text {k}" if k else None) for k in range(5)] + [(None, "x")]
    assert write_files(spark.createDataFrame(data, "path STRING, content STRING")) == 5
    found = transcript_files(spark, f"{tmp_path}/out", manifest=list_tree(spark, f"{tmp_path}/out/transcripts", ".txt"))
    want = sorted((f"b{k % 2}", f"é {k}", f"text {k}" if k else "") for k in range(5))
    assert rows(found, "batch_id", "stem", "transcript") == want == rows(transcript_files(spark, f"{tmp_path}/out"), "batch_id", "stem", "transcript")
    assert not list(tmp_path.glob("out/transcripts/*/.*"))
    assert write_files(spark.createDataFrame([], "path STRING, content STRING")) == 0


def test_bytes_of_a_layout_are_read_after_all_shuffles(spark, tmp_path, monkeypatch):
    from txmetrics.plans import dataset

    names = [(f"{tmp_path}/t/images/b{int(k > 2)}/{k}.png", "x" * 100) for k in range(40)]
    write_files(spark.createDataFrame(names, "path STRING, content STRING"))
    images = images_of(list_tree(spark, f"{tmp_path}/t/images"))
    tasks = spark.createDataFrame([(f"{k}.png", "b1" if k > 2 else "b0", f"t{k}") for k in range(40)], "task_name STRING, batch_id STRING, task_transcript STRING")
    plans = []
    write = dataset.write_partitioned
    monkeypatch.setattr(dataset, "write_partitioned", lambda df, *a, **o: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **o))
    # canonical_batch gives "b1" another name, so the images of that batch are looked for under it
    images = images.withColumn("batch_id", F.when(F.col("batch_id") == "b1", "batch-1").otherwise(F.col("batch_id")))
    path = lay_out(tasks, images, f"{tmp_path}/benchmark", target_bytes=1000)
    below = plans[0][plans[0].index("MapInArrow") :]
    assert below.index("Repartition") > 0 and "content" not in below[below.index("Repartition") :]
    files = sorted(p.parent.name for p in (tmp_path / "benchmark").glob("*/*.parquet"))
    assert files.count("batch_id=b0") == 1 and 2 <= files.count("batch_id=batch-1") <= 4  # 300 and 3,700 bytes
    found = spark.read.parquet(path)
    assert found.count() == 40 and found.where("length(content) = 100 AND transcript = concat('t', split(image_name, '[.]')[0])").count() == 40
    with pytest.raises(Exception, match="no image"):
        lay_out(tasks, images.where("image_name <> '7.png'"), f"{tmp_path}/other")


def test_paths_of_stores():
    assert file_system("/a b/c")[1] == file_system("file:/a b/c")[1] == file_system("file:///a b/c")[1] == "/a b/c"
