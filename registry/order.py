"""Order as data: where rows stand in written files, and columns in written tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import edge, files, report
from registry import tables as t
from registry.files import _folder
from registry.trees import _documents
from txmetrics.functions.columns import col
from txmetrics.plans import write_benchmark
from txmetrics.sources import read_csv, read_json, scan_csv, write_files
from txmetrics.sinks import export_csv


def _numbered(table):
    """Rows of a small scan with their number in the files, from 1."""
    return table.withColumn("line", F.row_number().over(Window.orderBy("_pos"))).drop("_pos")


def _placed(table, keys, columns):
    """One row for each cell: its column's name and place in the table."""
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), col(c).cast("string").alias("value")) for c in columns])
    return table.select(*[col(k) for k in keys], F.posexplode(cells).alias("place", "_c")).select(*[col(k) for k in keys], "place", "_c.*")


def benchmark_file(spark, sf_dir):
    """The benchmark file: the place of each batch, and of each line in its batch."""
    path = write_benchmark(t.truth(spark, sf_dir), _folder(spark, "benchmark"))
    table = scan_csv(spark, path, position=True)
    lines = table.withColumn("line", F.row_number().over(Window.partitionBy("batch_id").orderBy("_pos"))).drop("_pos")
    begun = table.groupBy("batch_id").agg(F.min("_pos").alias("_pos"))
    return lines.join(_numbered(begun).withColumnRenamed("line", "batch_place"), "batch_id")


def summary_cells(spark, sf_dir):
    """The summary file: models in the order of its lines, and batches in that of its columns."""
    table = _numbered(scan_csv(spark, f"{edge._evaluated(spark, sf_dir)}/summary.csv", position=True))
    found = _placed(table, ["line", "model"], [c for c in table.columns if c not in ("line", "model")])
    return found.select("line", "model", "place", "cell", F.col("value").cast("double").alias("value"))


def _reports(spark, sf_dir):
    """A folder with all report files."""
    folder = _folder(spark, "reports")
    scores = files.materialise(files.scored(spark, sf_dir).select("model", "image_name", "batch_id", "cer"), "scores")
    report.generate_reports(t.sheets(spark, sf_dir), *t.script_sheets(spark, sf_dir), t.benchmark_table(spark, sf_dir), scores, folder)
    return folder


def final_summary_file(spark, sf_dir):
    """The final summary as written, line by line."""
    table = _numbered(scan_csv(spark, f"{_reports(spark, sf_dir)}/final_summary.csv", position=True))
    numbers = [c for c in table.columns if c.endswith("_avg_cer")]
    return table.select(
        "line", "category", "group", F.col("image_count").cast("long").alias("image_count"), *[col(c).cast("double").alias(c) for c in numbers]
    )


def report_columns(spark, sf_dir):
    """Every cell of the merged report as written, with the place of its column."""
    table = spark.read.parquet(f"{_reports(spark, sf_dir)}/merged_report")
    return _placed(table, ["image_name"], table.columns).groupBy("place", "cell").agg(F.count("value").alias("filled"))


def only_in_files(spark, sf_dir):
    """The two lists of names that the report job leaves, as files."""
    folder = _reports(spark, sf_dir)
    return scan_csv(spark, f"{folder}/only_in_consolidated.csv").select(F.lit("catalog").alias("part"), "image_name").unionByName(
        scan_csv(spark, f"{folder}/only_in_benchmark.csv").select(F.lit("benchmark").alias("part"), "image_name")
    )


def typed_csv(spark, sf_dir):
    """A file of numbers, text and gaps, read with the types that its cells have."""
    docs = t.read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / 8).alias("eighths"))
    found = read_csv(spark, export_csv(rows, _folder(spark, "typed")))
    types = ",".join(kind for _, kind in found.dtypes)
    return found.select("doc_id", F.length("text").alias("chars"), "eighths", F.lit(types).alias("types"))


def json_documents(spark, sf_dir):
    """Whole-document files, each a nested object over several lines."""
    docs = _documents(spark, sf_dir).where("text <> ''")
    body = F.to_json(F.struct("stem", F.struct("text", F.array("batch_id", "ending").alias("tags")).alias("page")), {"pretty": "true"})
    root = _folder(spark, "json")
    write_files(docs.select(F.concat(F.lit(f"{root}/"), "batch_id", F.lit("/"), "stem", F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content")))
    found = read_json(spark, f"{root}/*")
    return found.select("stem", F.col("page.text").alias("text"), F.array_join("page.tags", "|").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (benchmark_file, summary_cells, final_summary_file, report_columns, only_in_files, typed_csv, json_documents)
}

_SUMMARY_ORDER = """CASE category WHEN 'overall' THEN CASE "group" WHEN 'whole_benchmark' THEN 1 WHEN 'in_both' THEN 2 ELSE 3 END
  WHEN 'technology' THEN 4 WHEN 'main_style' THEN 5 ELSE 6 END"""
_AVERAGES = ", ".join(f'"{m}_avg_cer"' for m in t.MODELS)
#: Leading columns of a report that these sheets have, in their order; all others follow by name, then the scores.
_LEADING = [
    "image_name", "batch_id", "technology", "script_id", "script_name", "legibility", "color", "notes", "exact_font", "3_types",
    "8_cat_combination", "popularity_on_web", "period",
]
_REPORT_COLUMNS = [
    "image_name", "batch_id", "technology", "script_id", "notes", "legibility", "exact_font", "color", "period", "3_types", "script_name",
    "popularity_on_web", "8_cat_combination", *[f"{m}_cer" for m in t.MODELS],
]

ORACLE = {
    "benchmark_file": f"SELECT 'doc_' || doc_id || '.png' AS image_name, {t.BATCH_SQL} AS batch_id, nullif(text, '') AS transcript,"
    f" CAST(row_number() OVER (PARTITION BY {t.BATCH_SQL} ORDER BY 'doc_' || doc_id || '.png') AS INTEGER) AS line,"
    f" CAST(dense_rank() OVER (ORDER BY {t.BATCH_SQL}) AS INTEGER) AS batch_place FROM documents",
    "summary_cells": f"""WITH {t.SCORES_SQL},
batches AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS place FROM (SELECT DISTINCT batch_id FROM scores)),
models AS (SELECT model, row_number() OVER (ORDER BY model) AS line FROM (SELECT DISTINCT model FROM scores))
SELECT CAST(line AS INTEGER) AS line, model, 0 AS place, 'overall_cer' AS cell, round_even(avg(cer), 6) AS value FROM scores JOIN models USING (model) GROUP BY line, model
UNION ALL SELECT CAST(line AS INTEGER), m.model, CAST(b.place AS INTEGER), 'cer_' || b.batch_id, round_even(avg(cer), 6)
FROM models m CROSS JOIN batches b LEFT JOIN scores s ON s.model = m.model AND s.batch_id = b.batch_id GROUP BY line, m.model, b.place, b.batch_id""",
    "final_summary_file": f"""SELECT CAST(row_number() OVER (ORDER BY {_SUMMARY_ORDER}, "group") AS INTEGER) AS line, category, "group", image_count, {_AVERAGES}
FROM ({report.ORACLE["final_summary"]})""",
    "report_columns": f"{report._REPORT} SELECT CAST(row_number() OVER (ORDER BY kind, known, cell) - 1 AS INTEGER) AS place, cell, filled FROM ("
    + " UNION ALL ".join(
        f"SELECT {2 if c.endswith('_cer') else int(c not in _LEADING)} AS kind, {_LEADING.index(c) if c in _LEADING else 0} AS known, '{c}' AS cell,"
        f' count("{c}") AS filled FROM report'
        for c in _REPORT_COLUMNS
    )
    + ")",
    "only_in_files": f"""{report._R} SELECT 'catalog' AS part, trim(file_name) AS image_name FROM consolidated
  WHERE trim(file_name) NOT IN (SELECT image_name FROM bench)
UNION ALL SELECT 'benchmark', image_name FROM bench WHERE image_name NOT IN (SELECT trim(file_name) FROM consolidated)""",
    "typed_csv": "SELECT CAST(doc_id AS INTEGER) AS doc_id, CAST(length(text) AS INTEGER) AS chars, CASE WHEN doc_id % 3 > 0 THEN n_chars / 8 END AS eighths,"
    " 'int,string,double' AS types FROM documents",
    "json_documents": "SELECT 'doc_' || doc_id AS stem, text, replace(source, 'src', 'batch-') || '|' || (['.png', '.tif', '.HEIC', '.bin'])[1 + doc_id % 4] AS tags"
    " FROM documents WHERE substr(md5(doc_id::VARCHAR), 1, 1) <> '0' AND text <> ''",
}
