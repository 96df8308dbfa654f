import pytest
from pyspark.sql import functions as F

from txmetrics import sources
from txmetrics.operators import fill_join, ordered_columns, reconcile, rows_per_group, widen_scores
from txmetrics.plans import (
    attach_scores,
    catalog_projection,
    consolidate,
    coverage,
    final_summary,
    generate_reports,
    join_script_metadata,
    normalise_columns,
    union_sheets,
)
from txmetrics.plans.metadata import CATALOG_RENAMES
from txmetrics.plans.report import in_summary_order
from txmetrics.sinks import write_clusters


def frame(spark, columns, data):
    from pyspark.sql import types as T

    return spark.createDataFrame(data, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_column_names(spark):
    sheet = frame(spark, [" File Name ", "Script ID", "Unnamed: 2", "8 cat. x, y", "Note", "", "Popularity on Web"], [tuple("abcdefg")])
    got = normalise_columns(sheet, CATALOG_RENAMES)
    assert got.columns == ["file_name", "script_id", "8 cat. x, y", "notes", "popularity_on_web"]
    assert rows(got) == [("a", "b", "d", "e", "g")]
    with pytest.raises(ValueError, match="notes"):
        normalise_columns(frame(spark, ["note", "Notes"], []), CATALOG_RENAMES)


def test_union_drops_padding_and_tags(spark):
    a = frame(spark, ["File name", "Color"], [("a.png", "bw"), ("", "x"), (None, "y"), ("  ", "z")])
    b = frame(spark, ["file name", "DPI"], [("b.png", "300")])
    got = union_sheets({"modern": a, "metal": b})
    assert got.columns == ["technology", "file_name", "color", "dpi"]
    assert rows(got, "file_name") == [("modern", "a.png", "bw", None), ("metal", "b.png", None, "300")]
    assert rows(rows_per_group(got, "technology"), "technology") == [("metal", 1), ("modern", 1)]
    with pytest.raises(ValueError):
        union_sheets({})
    with pytest.raises(ValueError):
        union_sheets({"t": frame(spark, ["file name", "Technology"], [])})


def test_projection(spark):
    sheets = {"modern": frame(spark, ["File name", "3 types", "zz", "popularity on web"], [("a", "t", "no", "rare")])}
    got = catalog_projection(sheets)
    assert len(got.columns) == 12 and got.columns[:3] == ["technology", "file_name", "script_id"]
    row = got.first()
    assert (row["3_types"], row["popularity_on_web"], row["period"]) == ("t", "rare", None)


def test_fill_join(spark):
    left = frame(spark, ["id", "v"], [("1", "mine"), ("2", None), (None, None)])
    right = frame(spark, ["id", "v", "w"], [("1", "theirs", "w1"), ("2", "theirs", "w2"), (None, "n", "n")])
    assert rows(fill_join(left, right, "id"), "id") == [(None, None, None), ("1", "mine", "w1"), ("2", "theirs", "w2")]
    twice = right.union(right)
    assert fill_join(left, twice, "id").count() == 5
    with pytest.raises(ValueError):
        fill_join(left, twice, "id", unique=True)


def test_script_join_precedence_and_null_keys(spark):
    catalog = frame(spark, ["file_name", "script_id"], [("a", " s1 "), ("b", None), ("c", "s2"), ("d", "none")])
    scripts = frame(spark, ["script_id", "script_name"], [("s1", "one"), (None, "pad 1"), (None, "pad 2")])
    multi = frame(spark, ["script_id", "script_name"], [("s1 ", "other"), ("s2", "two")])
    got = rows(join_script_metadata(catalog, scripts, multi), "file_name")
    assert got == [("a", "s1", "one"), ("b", None, None), ("c", "s2", "two"), ("d", "none", None)]
    parity = rows(join_script_metadata(catalog, scripts, multi, null_key="literal_nan"), "file_name", "script_name")
    assert parity[1:3] == [("b", "nan", "pad 1"), ("b", "nan", "pad 2")] and len(parity) == 5


def test_reconcile(spark):
    bench = frame(spark, ["image_name", "batch_id", "transcript", "source"], [(" a ", "1", "t", "sb"), ("a", "2", "t", "sb"), ("x", "1", "t", "sb"), (None, "1", "t", "sb")])
    cat = frame(spark, ["technology", "file_name", "source"], [("m", "a ", "sc"), ("m", "q", "sc")])
    split = reconcile(bench, cat)
    assert split.merged.columns == ["image_name", "batch_id", "source_x", "technology", "source_y"]
    assert rows(split.merged, "batch_id") == [("a", "1", "sb", "m", "sc"), ("a", "2", "sb", "m", "sc")]
    assert rows(split.only_in_catalog) == [("m", "q", "sc")]
    assert [r.image_name for r in split.only_in_benchmark.orderBy("image_name").collect()] == [None, "x"]


SCORES = "model STRING, image_name STRING, batch_id STRING, cer DOUBLE"


def test_wide_scores(spark):
    data = [("v2.5_x", "a", "1", 0.12345678), ("m", "a", "1", 0.5), ("m", "b", None, 1.0), ("m", None, None, 0.25), ("v2.5_x", None, None, 0.75)]
    scores = spark.createDataFrame(data, SCORES)
    for rule in ("multiply", "forbid"):
        wide = widen_scores(scores, duplicates=rule)
        assert wide.columns == ["image_name", "batch_id", "m_cer", "v2.5_x_cer"]
        assert rows(wide, "image_name") == [(None, None, 0.25, 0.75), ("a", "1", 0.5, 0.123457), ("b", None, 1.0, None)]


def test_wide_scores_with_repeats(spark):
    data = [("m", "a", "1", 0.1), ("m", "a", "1", 0.2), ("n", "a", "1", 0.3), ("n", "a", "1", 0.4), ("n", "b", "1", 0.5), ("o", "c", "1", 0.6), ("o", "c", "1", 0.6)]
    wide = widen_scores(spark.createDataFrame(data, SCORES), duplicates="multiply")
    assert rows(wide, *wide.columns) == [
        ("a", "1", 0.1, 0.3, None), ("a", "1", 0.1, 0.4, None), ("a", "1", 0.2, 0.3, None), ("a", "1", 0.2, 0.4, None),
        ("b", "1", None, 0.5, None), ("c", "1", None, None, 0.6), ("c", "1", None, None, 0.6),
    ]
    with pytest.raises(Exception, match="scored more than once by a model: [ac]"):
        widen_scores(spark.createDataFrame(data, SCORES), duplicates="forbid").collect()


def test_column_order(spark):
    columns = ["zeta", "b_cer", "period", "image_name", "popularity_on_web", "alpha", "a_cer", "technology", "3_types"]
    assert ordered_columns(frame(spark, columns, [])) == [
        "image_name", "technology", "3_types", "popularity_on_web", "period", "alpha", "zeta", "a_cer", "b_cer",
    ]


def test_summary(spark):
    report = spark.createDataFrame(
        [("a", "print", "x", 0.1, None), ("b", "print", " ", 0.3, 0.5), ("c", " odd ", None, None, None)],
        "image_name STRING, technology STRING, `3_types` STRING, `v2.5_cer` DOUBLE, m_cer DOUBLE",
    )
    evaluation = spark.createDataFrame(
        [("a", "1", 0.1, None), ("z", "1", 0.9, 0.7), ("y", "1", 0.2, None)], "image_name STRING, batch_id STRING, `v2.5_cer` DOUBLE, m_cer DOUBLE"
    )
    only = frame(spark, ["image_name"], [("z ",), ("z",), ("never scored",)])
    summary = in_summary_order(final_summary(report, evaluation, only))
    assert summary.columns == ["category", "group", "image_count", "m_avg_cer", "v2.5_avg_cer"]
    assert rows(summary) == [
        ("overall", "whole_benchmark", 3, 0.7, 0.4), ("overall", "in_both", 3, 0.5, 0.2), ("overall", "only_in_benchmark", 1, 0.7, 0.9),
        ("technology", " odd ", 1, None, None), ("technology", "print", 2, 0.5, 0.2), ("main_style", "x", 1, None, 0.1),
    ]
    bare = final_summary(report.where("false"), evaluation.where("false"), only)
    assert rows(in_summary_order(bare)) == [("overall", "whole_benchmark", 0, None, None), ("overall", "in_both", 0, None, None)]
    assert final_summary(report).where("category = 'overall'").count() == 1
    row = coverage(report.withColumn("script_name", F.col("3_types"))).first()
    assert tuple(row) == (3, 2, 1)


def test_clusters(spark, tmp_path):
    report = frame(spark, ["image_name", "group"], [("a", "a b"), ("b", "a_b"), ("c", ""), ("d", None), ("e", "  "), ("f", "x/y")])
    write_clusters(report, "group", str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c")).select("_cluster", "image_name", "group")
    assert rows(got, "image_name") == [
        ("a_b", "a", "a b"), ("a_b", "b", "a_b"), ("_unspecified", "c", ""), ("_unspecified", "d", None), ("_unspecified", "e", "  "),
        ("x_y", "f", "x/y"),
    ]


def test_generate_reports_from_files(spark, tmp_path):
    catalog, scripts, evaluation = (tmp_path / n for n in ("catalog", "script", "evaluation"))
    for folder in (catalog, scripts, evaluation):
        folder.mkdir()
    (catalog / "Benchmark catalog - modern.csv").write_text("File name,Script ID,Note,\na.png,s1,n1,\n,,,\nq.png,s2,,\n")
    (catalog / "Benchmark catalog - manuscripts.csv").write_text("file name,script id,period\nb.png,s9,old\n")
    (scripts / "Script lists - Scripts.csv").write_text("ID,\"Name (phonetics, wylie in parentheses, and English)\",3 types,popularity on web\ns1,One,Big,rare\n")
    (scripts / "Script lists - Multi-scripts.csv").write_text("IDs,names (phonetics),8 cat. combination\ns9,Nine,c8\n")
    (tmp_path / "benchmark.csv").write_text("image_name,batch_id,transcript\na.png,b1,t\nb.png,b1,t\nz.png,b2,t\n")
    (evaluation / "m_cer.csv").write_text("image_name,batch_id,cer\na.png,b1,0.5\nz.png,b2,0.1\n")
    sheets = sources.load_sheets(spark, str(catalog))
    assert sorted(sheets) == ["manuscripts", "modern"]
    bench = sources.scan_csv(spark, str(tmp_path / "benchmark.csv"))
    out = str(tmp_path / "reports")
    report = generate_reports(sheets, *sources.load_script_sheets(spark, str(scripts)), bench, sources.load_scores(spark, str(evaluation)), out)
    assert report.columns == [
        "image_name", "batch_id", "technology", "script_id", "script_name", "notes", "3_types", "8_cat_combination",
        "popularity_on_web", "period", "m_cer",
    ]
    assert rows(report, "image_name") == [
        ("a.png", "b1", "modern", "s1", "One", "n1", "Big", None, "rare", None, 0.5),
        ("b.png", "b1", "manuscripts", "s9", "Nine", None, None, "c8", None, "old", None),
    ]
    assert rows(sources.scan_names(spark, f"{out}/only_in_benchmark.csv")) == [("z.png",)]
    assert rows(sources.scan_names(spark, f"{out}/only_in_consolidated.csv")) == [("q.png",)]
    summary = sources.scan_csv(spark, f"{out}/final_summary.csv")
    assert ("overall", "only_in_benchmark", "1", "0.1") in rows(summary)
    assert spark.read.parquet(f"{out}/by_main_styles").where("_cluster = 'Big'").count() == 1
    assert consolidate(sheets, *sources.load_script_sheets(spark, str(scripts))).count() == 3
    with pytest.raises(FileNotFoundError):
        sources.load_sheets(spark, str(scripts))
    wide = widen_scores(sources.load_scores(spark, str(evaluation)))
    assert attach_scores(bench, wide).count() == 3


@pytest.fixture
def eager_skew(spark):
    """Skew handling that reacts to kilobytes; no side small enough for a broadcast."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_image_with_a_third_of_all_scores(eager_skew):
    scores = eager_skew.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.lit("m")).otherwise(F.lit("n")).alias("model"),
        F.when((F.col("id") % 6 == 0) | (F.col("id") == 1), F.lit("hot")).otherwise(F.concat(F.lit("i"), F.floor(F.col("id") / 4))).alias("image_name"),
        F.lit("1").alias("batch_id"),
        (F.col("id") / 60000).alias("cer"),
    )
    wide = widen_scores(scores, ["m", "n"], duplicates="multiply")
    by_name = wide.groupBy("image_name").count()
    got = {r.image_name: r["count"] for r in by_name.where("image_name = 'hot'").collect()}
    assert got == {"hot": 10000}
    assert len(wide.collect()) == wide.count()
    assert "SortMergeJoin(skew=true)" in final_plan(wide)


def test_script_with_a_third_of_all_rows(eager_skew):
    catalog = eager_skew.range(0, 30000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("file_name"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("script_id"),
    )
    scripts = eager_skew.range(500).select(F.concat(F.lit("s"), "id").alias("script_id"), F.lit("x").alias("script_name"))
    scripts = scripts.unionByName(frame(eager_skew, ["script_id", "script_name"], [("hot", "h")]))
    joined = join_script_metadata(catalog, scripts, scripts)
    names = [r.script_name for r in joined.collect()]
    assert (len(names), names.count("h"), names.count(None)) == (30000, 10000, 10000)
    assert final_plan(joined).count("SortMergeJoin(skew=true)") >= 2


@pytest.mark.parametrize("name", ["evaluated_files", "summary_cells", "summary_file"])
def test_texts_of_the_evaluated_files_are_packed(spark, tmp_path, monkeypatch, name):
    from registry import QUERIES, edge

    text = "t" * 4000
    documents = [(1, text, "src1"), (2, text, "src2"), (3, "x", "src2")]
    spark.createDataFrame(documents, "doc_id BIGINT, text STRING, source STRING").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0, 0), (3, 1, 1)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(edge, "_folder", lambda _, kind: str(tmp_path / kind))
    found = QUERIES[name](spark, str(tmp_path))
    if name == "evaluated_files":
        got = {(r.model, r.image_name): r.cer for r in found.collect()}
        assert len(got) == 11 and got["double", "doc_1.png"] == 1 and got["swap", "doc_3.png"] == 1 and got["exact", "doc_2.png"] == 0
    else:
        got = {(r.model, r.cell): r.value for r in found.collect()}
        assert got["double", "overall_cer"] == 1 and got["exact", "cer_batch-2"] == 0.5 and got["drop_v2.5", "cer_batch-1"] == 0
    for texts in ("outputs/model=*", "truth.csv"):
        parts = list((tmp_path / "evaluation").glob(f"{texts}/part-*"))
        assert parts and all(p.name.endswith(".csv.gz") for p in parts)
        assert sum(p.stat().st_size for p in parts) < 4000
    assert all(p.name.endswith(".csv") for p in (tmp_path / "evaluation" / "result").glob("per_image/*/part-*"))
