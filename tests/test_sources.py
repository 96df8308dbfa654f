import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from txmetrics import sources
from txmetrics.plans import batch_stats, build_benchmark, lay_out, normalise_outputs, stats_document, write_benchmark, write_outputs
from txmetrics.plans.dataset import canonical_batch, source_images
from txmetrics.sinks import export_csv, write_json
from txmetrics.sources.csv import header_names


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def write_rows(path, header, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *data])


def test_truth(spark, benchmark_tree):
    truth = sources.load_truth(spark, str(benchmark_tree / "benchmark.csv"))
    got = {(r.image_name, r.batch_id): r.transcript for r in truth.collect()}
    assert len(got) == 3
    assert got[("img_001.png", "batch-1")] == "བཀྲ་ཤིས་བདེ་ལེགས"


def test_stray_whitespace(spark, tmp_path):
    path = tmp_path / "ws.csv"
    path.write_text(" image_name , batch_id , transcript \n foo.png , b1 , hello \n")
    assert rows(sources.load_truth(spark, str(path)).drop("_pos")) == [("foo.png", "b1", "hello")]


def test_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image_name,batch_id\nx.png,b\n")
    assert sources.load_truth(spark, str(tmp_path / "a.csv")).first().transcript == ""
    (tmp_path / "b.csv").write_text("name,batch_id\nx.png,b\n")
    with pytest.raises(ValueError):
        sources.load_truth(spark, str(tmp_path / "b.csv"))


def test_quotes_newlines_and_tokens(spark, tmp_path):
    data = [("a", "b", 'x ""q"" , y\nline2'), ("b", "b", "NA"), ("c", "b", " NA "), ("d", "b", ""), ("e", "b", 'say "hi"')]
    write_rows(tmp_path / "m.csv", ["image_name", "batch_id", "inference"], data)
    got = rows(sources.scan_outputs(spark, str(tmp_path)).drop("_pos"), "image_name")
    assert got == [
        ("m", "a", "b", 'x ""q"" , y\nline2'), ("m", "b", "b", None), ("m", "c", "b", "NA"), ("m", "d", "b", None),
        ("m", "e", "b", 'say "hi"'),
    ]


def test_headers():
    assert header_names(["﻿a", None, "b", "b", ""]) == ["a", "Unnamed: 1", "b", "b.1", "Unnamed: 4"]


def test_models_with_own_headers(spark, tmp_path):
    write_rows(tmp_path / "v2.5_x.csv", ["image_name", "batch_id", "inference"], [("a.png", "b1", "t1"), ("a.png", "b1", "t2")])
    write_rows(tmp_path / "other one.csv", [" inference", "image_name ", "batch_id", "extra"], [("u", "a.png", "b1", "e")])
    write_rows(tmp_path / "textless.csv", ["image_name", "batch_id"], [("a.png", "b1")])
    got = rows(sources.scan_outputs(spark, str(tmp_path)).drop("_pos"), "model", "inference")
    assert got == [
        ("other one", "a.png", "b1", "u"), ("textless", "a.png", "b1", None), ("v2.5_x", "a.png", "b1", "t1"),
        ("v2.5_x", "a.png", "b1", "t2"),
    ]
    only = sources.scan_outputs(spark, str(tmp_path), "v2.5_x")
    assert {r.model for r in only.collect()} == {"v2.5_x"}
    order = [r.inference for r in only.orderBy("_pos").collect()]
    assert order == ["t1", "t2"]
    with pytest.raises(FileNotFoundError):
        sources.scan_outputs(spark, str(tmp_path), "absent")
    with pytest.raises(FileNotFoundError):
        sources.scan_outputs(spark, str(tmp_path / "nowhere"))


def test_outputs_roundtrip(spark, tmp_path):
    data = [
        ("m 1", "i.png", "b", 'quote " and , comma'), ("m 1", "j.png", "b", "two\nlines"), ("v2.5/x", "i.png", "b", None),
        ("v2.5/x", "k.png", "b", "བཀྲ་ཤིས"),
    ]
    frame = spark.createDataFrame(data, "model STRING, image_name STRING, batch_id STRING, inference STRING")
    write_outputs(frame, str(tmp_path / "out"), in_order=True)
    assert rows(sources.scan_outputs(spark, str(tmp_path / "out")).drop("_pos"), "model", "image_name") == data
    again = normalise_outputs(spark, str(tmp_path / "out"), str(tmp_path / "again"))
    assert rows(again.drop("_pos"), "model", "image_name") == data


def test_empty_outputs_have_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], "image_name STRING, batch_id STRING, inference STRING")
    export_csv(empty, str(tmp_path / "none.csv"))
    assert sources.scan_outputs(spark, str(tmp_path)).count() == 0


def test_scores_and_report_scan(spark, tmp_path):
    write_rows(tmp_path / "m_cer.csv", ["image_name", "batch_id", "cer"], [("a", "1", "0.1"), ("b", "1", "")])
    write_rows(tmp_path / "n_cer.csv", ["image_name", "batch_id", "cer"], [("a", "1", "0.25")])
    got = rows(sources.load_scores(spark, str(tmp_path)), "model", "image_name")
    assert got == [("m", "a", "1", 0.1), ("m", "b", "1", None), ("n", "a", "1", 0.25)]
    write_rows(tmp_path / "report.csv", ["image_name", "x.y", "m_cer"], [("a", "01", "0.5"), ("b", "", "bad")])
    report = sources.scan_report(spark, str(tmp_path / "report.csv"))
    assert report.schema["m_cer"].dataType.simpleString() == "double"
    assert rows(report) == [("a", "01", 0.5), ("b", None, None)]
    assert rows(sources.scan_names(spark, str(tmp_path / "absent.csv"))) == []


def test_generic_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n3,z\n")
    frame = sources.read_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in frame.collect()] == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "d.json").write_text(json.dumps({"key": "བཀྲ", "nested": {"a": 1}, "list": [1, 2]}, ensure_ascii=False, indent=1))
    row = sources.read_json(spark, str(tmp_path / "d.json")).first()
    assert (row.key, row.nested.a, row.list) == ("བཀྲ", 1, [1, 2])
    write_json(sources.read_json(spark, str(tmp_path / "d.json")), str(tmp_path / "out"))
    assert "བཀྲ" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    for reader in (sources.read_csv, sources.read_json):
        with pytest.raises(FileNotFoundError):
            reader(spark, str(tmp_path / "absent"))


def test_image_listing(spark, benchmark_tree):
    root = benchmark_tree
    (root / "images" / "stray.png").write_text("x")
    (root / "images" / "batch-1" / "sub").mkdir()
    (root / "images" / "batch-1" / "sub" / "deep.png").write_text("x")
    (root / "images" / "batch-2" / "a b.TIF").write_text("x")
    listing = sources.image_listing(spark, str(root)).orderBy("batch_id", "image_name")
    assert rows(listing.select("batch_id", "image_name", "stem", "mime_type")) == [
        ("batch-1", "img_001.png", "img_001", "image/png"), ("batch-1", "img_002.png", "img_002", "image/png"),
        ("batch-2", "a b.TIF", "a b", "image/tiff"), ("batch-2", "img_003.png", "img_003", "image/png"),
    ]
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    assert sources.image_listing(spark, str(root), "batch-2").count() == 2
    assert sources.image_listing(spark, str(root / "nothing")).count() == 0
    assert sources.image_listing(spark, str(root), content=True).where("length(content) > 0").count() == 4
    for service, natives in (("vision", 4), ("language", 3)):
        data = sources.image_bytes(spark, str(root), service).where("native")
        assert data.count() == natives


def test_build_benchmark(spark, benchmark_tree):
    root = benchmark_tree
    (root / "images" / "batch-1" / "img_001.tif").write_text("same stem")
    images = sources.image_listing(spark, str(root))
    texts = sources.transcript_files(spark, str(root))
    built = build_benchmark(images, texts)
    got = {(r.image_name, r.batch_id): r.transcript for r in built.collect()}
    assert got[("img_001.tif", "batch-1")] == got[("img_001.png", "batch-1")] == "བཀྲ་ཤིས་བདེ་ལེགས"
    assert len(got) == 4
    write_benchmark(built, str(root / "built.csv"))
    again = sources.load_truth(spark, str(root / "built.csv"))
    assert {(r.image_name, r.batch_id): r.transcript for r in again.collect()} == got
    (root / "images" / "batch-2" / "orphan.png").write_text("x")
    with pytest.raises(Exception, match="no transcript for batch-2/orphan.png"):
        build_benchmark(sources.image_listing(spark, str(root)), texts).collect()


def test_empty_transcript_is_a_transcript(spark, benchmark_tree):
    (benchmark_tree / "images" / "batch-2" / "blank.png").write_text("x")
    (benchmark_tree / "transcripts" / "batch-2" / "blank.txt").write_text("")
    built = build_benchmark(sources.image_listing(spark, str(benchmark_tree)), sources.transcript_files(spark, str(benchmark_tree)))
    assert built.where("image_name = 'blank.png'").first().transcript == ""


def test_stats(spark, benchmark_tree, tmp_path):
    listing = sources.image_listing(spark, str(benchmark_tree))
    row = stats_document(listing).first()
    assert (row.per_batch, row.total) == ({"batch-1": 2, "batch-2": 1}, 3)
    assert sorted((r["count"], r.is_total) for r in batch_stats(listing).collect()) == [(1, 0), (2, 0), (3, 1)]
    none = stats_document(sources.image_listing(spark, str(tmp_path / "nothing"))).first()
    assert (none.per_batch, none.total) == ({}, 0)


def test_lay_out(spark, tmp_path):
    for batch, name in (("batch-1", "a.png"), ("batch-5", "b.png")):
        (tmp_path / "src" / batch / "images").mkdir(parents=True)
        (tmp_path / "src" / batch / "images" / name).write_bytes(b"\x00" + name.encode())
    write_rows(tmp_path / "tasks.csv", ["task_name", "batch_id", "task_transcript", "x"], [("a.png", "b1", "ta", 1), ("b.png", "batch-05", "tb", 2)])
    tasks = sources.load_annotations(spark, str(tmp_path / "tasks.csv"))
    images = source_images(spark, str(tmp_path / "src"))
    lay_out(tasks, images, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).select("batch_id", "image_name", "transcript", "content")
    assert [(r[0], r[1], r[2], bytes(r[3])) for r in got.orderBy("batch_id").collect()] == [
        ("batch-1", "a.png", "ta", b"\x00a.png"), ("batch-5", "b.png", "tb", b"\x00b.png"),
    ]
    lost = spark.createDataFrame([("zz.png", "b1", "t")], "task_name STRING, batch_id STRING, task_transcript STRING")
    with pytest.raises(Exception, match="no image batch-1/zz.png"):
        lay_out(lost, images, str(tmp_path / "out2"))
    assert spark.range(1).select(canonical_batch(F.lit("batch-2"))).first()[0] == "batch-2"


def test_response_caches(spark, tmp_path):
    (tmp_path / "v" / "b 1").mkdir(parents=True)
    with gzip.open(tmp_path / "v" / "b 1" / "x.y.json.gz", "wt", encoding="utf-8") as f:
        json.dump({"fullTextAnnotation": {"text": " བཀྲ \n"}}, f, ensure_ascii=False, indent=2)
    got = sources.vision_cache(spark, str(tmp_path / "v"), "seer").first()
    assert (got.model, got.batch_id, got.stem, got.kind) == ("seer", "b 1", "x.y", "vision")
    assert json.loads(got.raw)["fullTextAnnotation"]["text"] == " བཀྲ \n"
    (tmp_path / "g" / "m.1" / "b").mkdir(parents=True)
    (tmp_path / "g" / "m.1" / "b" / "p.txt").write_text(" verbatim \n")
    (tmp_path / "g" / "m.1" / "b" / "empty.txt").write_text("")
    (tmp_path / "g" / "m.1" / "b" / "p.json").write_text('{"lines":[]}')
    plain = rows(sources.plain_cache(spark, str(tmp_path / "g"), "m.1").select("stem", "raw"), "stem")
    assert plain == [("empty", ""), ("p", " verbatim \n")]
    assert sources.structured_cache(spark, str(tmp_path / "g"), "m.1").first().raw == '{"lines":[]}'
    assert sources.structured_cache(spark, str(tmp_path / "g"), "absent").count() == 0
    assert sources.vision_cache(spark, str(tmp_path / "g2"), "m").count() == 0


def test_scans_of_trees_hold_no_paths_in_the_driver(spark, benchmark_tree, tmp_path):
    import gzip

    (benchmark_tree / "images" / "batch-1" / "void.bin").write_bytes(b"")
    images = sources.image_listing(spark, str(benchmark_tree), content=True)
    texts = sources.transcript_files(spark, f"file:{benchmark_tree}")
    (tmp_path / "v" / "b 1").mkdir(parents=True)
    (tmp_path / "v" / "b 1" / "x.y.json.gz").write_bytes(gzip.compress('{"a": "é"}'.encode()) + gzip.compress(b" "))
    (tmp_path / "v" / "b 1" / "none.json.gz").write_bytes(b"")
    (tmp_path / "v" / "b 1" / "other.json").write_text("{}")
    cache = sources.vision_cache(spark, str(tmp_path / "v"), "m")
    assert images.inputFiles() == texts.inputFiles() == cache.inputFiles() == []
    assert {r.path for r in images.collect()} >= {f"file:{benchmark_tree}/images/batch-1/void.bin"} and images.count() == 4
    assert {(r.batch_id, r.stem) for r in texts.collect()} == {("batch-1", "img_001"), ("batch-1", "img_002"), ("batch-2", "img_003")}
    assert [tuple(r) for r in cache.collect()] == [("m", "b 1", "x.y", "vision", '{"a": "é"} ')]


def test_json_documents_are_scanned_as_packed_texts(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "1.json").write_text('{\n "x": 1,\n "t": "é\\n"}\n', encoding="utf-8")
    (folder / "2.json").write_text('\ufeff[{"x": 2.5}, {"x": 3,\n "u": {"v": [1]}}]', encoding="utf-8")
    (folder / "3.json").write_text("")
    found = sources.read_json(spark, f"{tmp_path}/*")
    assert "FileScan json" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["t", "u", "x"]
    assert sorted((r.x, r.t, r.u and r.u.v) for r in found.collect()) == [(1.0, "é\n", None), (2.5, None, None), (3.0, None, [1])]
    (tmp_path / "by" / "k=5").mkdir(parents=True)
    (tmp_path / "by" / "k=5" / "1.json").write_text('{"x":\n 1}')
    assert [(r.k, r.x) for r in sources.read_json(spark, f"{tmp_path}/by").collect()] == [(5, 1)]


def test_a_listing_gives_spark_folders_and_takes_empty_files_from_tasks(spark, benchmark_tree):
    (benchmark_tree / "images" / "batch-1" / "void é.bin").write_bytes(b"")
    (benchmark_tree / "images" / "batch-1" / "sub").mkdir()
    (benchmark_tree / "images" / "batch-1" / "sub" / "void.bin").write_bytes(b"")
    for k in range(3):
        (benchmark_tree / "images" / f"stray {k}.bin").write_bytes(b"x")
    listing = sources.image_listing(spark, str(benchmark_tree))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Location: InMemoryFileIndex(2 paths)" in plan
    assert {r.image_name: r.length for r in listing.collect()}["void é.bin"] == 0 and listing.count() == 4


def test_json_documents_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    def refused(*args, **options):
        raise AssertionError("a file source would keep every path in the driver")

    (tmp_path / "a [b]" / "deeper").mkdir(parents=True)
    (tmp_path / "a [b]" / "é 1.json").write_text('{"x":\n 1}', encoding="utf-8")
    (tmp_path / "a [b]" / "_hidden.json").write_text('{"x": 2}')
    (tmp_path / "a [b]" / "void.json").write_text("")
    (tmp_path / "a [b]" / "deeper" / "1.json").write_text('{"x": 3}')
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(b'{"x": 4}'))
    with monkeypatch.context() as only_tasks:
        only_tasks.setattr(DataFrameReader, "load", refused)
        only_tasks.setattr(DataFrameReader, "text", refused)
        assert sorted(r.x for r in sources.read_json(spark, f"{tmp_path}/*").collect()) == [1, 4]
        assert sources.read_json(spark, f"{tmp_path}/a \\[b\\]/deeper").collect() == [(3,)]
        with pytest.raises(FileNotFoundError):
            sources.read_json(spark, f"{tmp_path}/*.xml")


def test_a_large_tree_of_images_is_listed_by_tasks(spark, benchmark_tree, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from txmetrics.sources import files

    for name in ("void é.bin", "a b.TIF", "_a=b.png", "_hidden.png", ".hidden.png", "half._COPYING_", "sub/deep.png"):
        place = benchmark_tree / "images" / "batch-1" / name
        place.parent.mkdir(exist_ok=True)
        place.write_bytes(b"" if "void" in name else b"x" * 7)
    (benchmark_tree / "images" / "_batch 3").mkdir()
    (benchmark_tree / "images" / "_batch 3" / "x.png").write_bytes(b"xy")
    (benchmark_tree / "images" / "stray.png").write_bytes(b"x")
    monkeypatch.setattr(files, "INDEXED", 14)  # 3 folders, 11 entries directly in them, and 1 deeper
    assert "Scan binaryFile" not in (plan := sources.image_listing(spark, str(benchmark_tree))._jdf.queryExecution().executedPlan().toString()), plan
    monkeypatch.setattr(files, "INDEXED", 15)
    small = sources.image_listing(spark, str(benchmark_tree))
    assert "InMemoryFileIndex(3 paths)" in small._jdf.queryExecution().executedPlan().toString()
    expected = rows(small, "path")
    assert len(expected) == 7
    monkeypatch.setattr(files, "INDEXED", 0)

    def refused(*args, **options):
        raise AssertionError("a file source would keep every path in the driver")

    monkeypatch.setattr(DataFrameReader, "load", refused)
    assert rows(sources.image_listing(spark, str(benchmark_tree)), "path") == expected
    assert rows(sources.image_listing(spark, str(benchmark_tree), "batch-2"), "path") == [r for r in expected if "batch-2" in r]


def test_outputs_are_packed_and_come_back_whole(spark, tmp_path):
    text = 'two\nlines, "quoted" ' * 500
    data = [("m 1", f"i{k}.png", "b", None if k % 7 == 0 else f"{text}é{k}") for k in range(50)]
    frame = spark.createDataFrame(data, "model STRING, image_name STRING, batch_id STRING, inference STRING")
    found = normalise_outputs(spark, write_outputs(frame, str(tmp_path / "out")), str(tmp_path / "again"))
    assert rows(found.drop("_pos").orderBy(F.expr("int(substring(image_name, 2, length(image_name) - 5))"))) == data
    for folder in ("out", "again"):
        parts = list((tmp_path / folder).glob("model=*/part-*"))
        assert parts and all(p.name.endswith(".csv.gz") for p in parts)
        assert sum(p.stat().st_size for p in parts) < 50 * len(text) / 4
    normalise_outputs(spark, str(tmp_path / "out"), str(tmp_path / "plain"), compression=None)
    assert all(p.name.endswith(".csv") for p in (tmp_path / "plain").glob("model=*/part-*"))
