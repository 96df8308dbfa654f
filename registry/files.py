"""Writers and readers, benchmark tables and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry import tables as t
from registry.evaluation import scored
from txmetrics.functions.text import stem
from txmetrics.plans import batch_stats as count_batches
from txmetrics.plans import build_benchmark, lay_out, normalise_outputs, stats_document, write_outputs
from txmetrics.plans.evaluation import export_scores
from txmetrics.sinks import materialise, shared_folder, write_partitioned
from txmetrics.sources import load_scores, scan_outputs
from txmetrics.sources.files import split_path


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    """Model outputs written as one CSV per model and read back."""
    folder = write_outputs(t.inference(spark, sf_dir), _folder(spark, "outputs"))
    return scan_outputs(spark, folder).drop("_pos")


def csv_one_model(spark, sf_dir):
    folder = write_outputs(t.inference(spark, sf_dir), _folder(spark, "outputs"))
    return scan_outputs(spark, folder, "drop_v2.5").drop("_pos")


def csv_rewritten(spark, sf_dir):
    folder = write_outputs(t.inference(spark, sf_dir), _folder(spark, "outputs"))
    return normalise_outputs(spark, folder, _folder(spark, "rewritten")).drop("_pos")


def outputs_by_model(spark, sf_dir):
    """Model outputs as a table partitioned by model."""
    path = write_partitioned(t.inference(spark, sf_dir), _folder(spark, "outputs"), ["model"], rebalance=False)
    written = spark.read.schema("image_name STRING, batch_id STRING, inference STRING, model STRING").parquet(path)
    return written.groupBy("model").agg(
        F.count("*").alias("count"), F.count("inference").alias("texts"), F.sum(F.length("inference")).alias("chars")
    )


def score_files(spark, sf_dir):
    """Per-model score exports read back as one table."""
    folder = _folder(spark, "scores")
    export_scores(materialise(scored(spark, sf_dir), "scores"), folder)
    return load_scores(spark, folder)


def batch_stats(spark, sf_dir):
    return count_batches(t.truth(spark, sf_dir))


def batch_stats_document(spark, sf_dir):
    document = stats_document(t.truth(spark, sf_dir))
    return document.select("total", F.explode("per_batch").alias("batch_id", "count"))


def benchmark_build(spark, sf_dir):
    """Images in two formats joined with the transcript of their stem, from path names."""
    docs = t.truth(spark, sf_dir)
    name = F.explode(F.array(F.col("image_name"), F.concat(stem(F.col("image_name")), F.lit(".tif"))))
    paths = docs.select("batch_id", name.alias("file")).select(
        F.concat(F.lit("data/images/"), "batch_id", F.lit("/"), "file").alias("path")
    )
    images = paths.select(*split_path("path", "images"))
    texts = docs.select("batch_id", stem(F.col("image_name")).alias("stem"), "transcript")
    return build_benchmark(images, texts)


def benchmark_layout(spark, sf_dir):
    """Annotated images laid out by batch with their bytes."""
    docs = t.truth(spark, sf_dir)
    spelled = (
        F.when(F.col("batch_id") == "batch-1", F.lit("b1"))
        .when(F.col("batch_id") == "batch-5", F.lit("batch-05"))
        .otherwise(F.col("batch_id"))
    )
    tasks = docs.select(
        F.col("image_name").alias("task_name"), spelled.alias("batch_id"), F.col("transcript").alias("task_transcript")
    )
    images = docs.select("batch_id", "image_name", F.encode("transcript", "UTF-8").alias("content"))
    path = lay_out(tasks, images, _folder(spark, "benchmark"))
    written = spark.read.schema("image_name STRING, transcript STRING, content BINARY, batch_id STRING").parquet(path)
    return written.select("image_name", "batch_id", F.length("transcript").alias("chars"), F.length("content").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip, csv_one_model, csv_rewritten, outputs_by_model, score_files, batch_stats, batch_stats_document,
        benchmark_build, benchmark_layout,
    )
}

_INFERENCE = """
readings AS (
  SELECT 'exact' AS model, d.doc_id, d.source, d.text AS inference, l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'swap', d.doc_id, d.source, translate(d.text, 'aou', '418'), l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'drop_v2.5', d.doc_id, d.source, regexp_replace(d.text, '[ei]', '', 'g'), l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'double', d.doc_id, d.source, replace(d.text, 't', 'tt'), l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality <> 0
),
outputs AS (
  SELECT model, 'doc_' || doc_id || '.png' AS image_name, replace(source, 'src', 'batch-') AS batch_id,
         CASE WHEN coalesce(toxic = 1, false) THEN NULL ELSE inference END AS inference
  FROM readings
  UNION ALL SELECT m.model, 'item_' || item_id || '.png', 'batch-extra', text
  FROM benchmark, (VALUES ('exact'), ('swap'), ('drop_v2.5'), ('double')) m(model)
)"""
_READ = "nullif(regexp_replace(inference, '^\\s+|\\s+$', '', 'g'), '')"
_ROWS = f"WITH {_INFERENCE} SELECT model, image_name, batch_id, {_READ} AS inference FROM outputs"

ORACLE = {
    "csv_roundtrip": _ROWS,
    "csv_one_model": _ROWS + " WHERE model = 'drop_v2.5'",
    "csv_rewritten": _ROWS,
    "outputs_by_model": f"WITH {_INFERENCE} SELECT model, count(*) AS count, count(inference) AS texts,"
    " CAST(sum(length(inference)) AS BIGINT) AS chars FROM outputs GROUP BY model",
    "score_files": f"WITH {t.SCORES_SQL} SELECT model, image_name, batch_id, round_even(cer, 6) AS cer FROM scores",
    "batch_stats": f"SELECT {t.BATCH_SQL} AS batch_id, CAST(grouping({t.BATCH_SQL}) AS INTEGER) AS is_total, count(*) AS count"
    f" FROM documents GROUP BY ROLLUP ({t.BATCH_SQL})",
    "batch_stats_document": f"SELECT (SELECT count(*) FROM documents) AS total, {t.BATCH_SQL} AS batch_id, count(*) AS count"
    " FROM documents GROUP BY 2",
    "benchmark_build": f"SELECT 'doc_' || doc_id || e.ending AS image_name, {t.BATCH_SQL} AS batch_id, text AS transcript"
    " FROM documents, (VALUES ('.png'), ('.tif')) e(ending)",
    "benchmark_layout": f"SELECT 'doc_' || doc_id || '.png' AS image_name, {t.BATCH_SQL} AS batch_id,"
    " CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes FROM documents",
}
