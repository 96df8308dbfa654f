"""The file side: what users hand in and get out, laid down from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import evaluation, files, inference, metadata, report
from registry import tables as t
from registry.files import _folder
from txmetrics.functions import unicode_normalise
from txmetrics.functions.columns import col
from txmetrics.functions.text import SHAD, TSHEG, ZERO_WIDTH_SPACE, clean_script
from txmetrics.operators import last_wins
from txmetrics.plans import Provider, batch_infer, consolidate, coverage, evaluate_directory, score_map, stats_document, write_outputs
from txmetrics.plans import catalog_projection as project
from txmetrics.plans.dataset import PACKING
from txmetrics.plans.inference import append_cache
from txmetrics.sinks.csv import WRITE_OPTIONS, export_csv, write_json
from txmetrics.sources import load_scores, load_truth, scan_outputs
from txmetrics.sources.files import images_of
from txmetrics.sources.csv import load_annotations, scan_names, scan_report
from txmetrics.sources.sheets import MULTI_SCRIPTS_SHEET, SCRIPTS_SHEET, load_script_sheets, load_sheets

KEYS = ["image_name", "batch_id"]


def truth_from_parts(spark, sf_dir):
    """Ground truth in parts of very unequal size that correct one another: the last part counts."""
    turns = t.read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("image_name"),
        F.col("role").alias("batch_id"),
        F.repeat("text", F.when(F.col("turn") == 0, F.lit(1)).otherwise(F.lit(3))).alias("transcript"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("part"),
    )
    folder = export_csv(turns, _folder(spark, "truth"), partition_by="part")
    return last_wins(load_truth(spark, folder), KEYS, "_pos").drop("_pos")


def csv_mixed_headers(spark, sf_dir):
    """Parts of models whose columns stand in different orders, one with a column more."""
    rows = t.inference(spark, sf_dir)
    folder = _folder(spark, "mixed")
    orders = {
        "exact": ["image_name", "batch_id", "inference"],
        "swap": ["batch_id", "inference", "image_name"],
        "drop_v2.5": ["inference", "image_name", "note", "batch_id"],
        "double": ["image_name", "batch_id", "inference"],
    }
    for model, columns in orders.items():
        part = rows.where(F.col("model") == model).withColumn("note", F.lit("n"))
        part.select(*columns).write.options(**WRITE_OPTIONS).csv(f"{folder}/model={model}")
    return scan_outputs(spark, folder).drop("_pos")


#: Cells that spell a missing value or wear spaces, by the source of a document.
CELLS = ["NA", "null", "None", "nan", " NA ", " kept\t", "　", "N/A", "", "NaN"]


def csv_na_tokens_and_spaces(spark, sf_dir):
    """Cells that spell a missing value become null; other cells lose white space of any kind at their ends."""
    docs = t.truth(spark, sf_dir)
    number = F.regexp_extract("batch_id", "([0-9]+)$", 1).cast("int")
    odd = F.element_at(F.array(*[F.lit(c) for c in CELLS]), number + 1)
    cell = F.when(number < len(CELLS), odd).otherwise(F.concat(F.lit(" "), "transcript", F.lit("\u0085 ")))
    folder = export_csv(docs.withColumn("transcript", cell), _folder(spark, "cells"))
    return load_truth(spark, folder).drop("_pos")


def outputs_in_order(spark, sf_dir):
    """Where each output stands in its model's files, which are asked to follow batch and image."""
    folder = write_outputs(t.inference(spark, sf_dir), _folder(spark, "ordered"), in_order=True)
    place = F.row_number().over(Window.partitionBy("model").orderBy("_pos"))
    return scan_outputs(spark, folder).select("model", *KEYS, place.alias("place"))


def _sheet_files(spark, sf_dir):
    folder = _folder(spark, "sheets")
    for name, sheet in t.sheets(spark, sf_dir).items():
        export_csv(sheet, f"{folder}/Sheet {name}.csv")
    return folder


_SHEETS = {f"Sheet {lang}": lang for lang in ("en", "de", "es", "fr")}


def catalog_from_files(spark, sf_dir):
    folder = _sheet_files(spark, sf_dir)
    for name, sheet in zip((SCRIPTS_SHEET, MULTI_SCRIPTS_SHEET), t.script_sheets(spark, sf_dir)):
        export_csv(sheet, f"{folder}/{name}.csv")
    return consolidate(load_sheets(spark, folder, _SHEETS), *load_script_sheets(spark, folder))


def projection_from_files(spark, sf_dir):
    return project(load_sheets(spark, _sheet_files(spark, sf_dir), _SHEETS))


def annotations_from_file(spark, sf_dir):
    docs = t.truth(spark, sf_dir).select(
        F.col("image_name").alias("task_name"), "batch_id", F.col("transcript").alias("task_transcript"), F.lit("x").alias("extra")
    )
    found = load_annotations(spark, export_csv(docs, _folder(spark, "annotations")))
    return found.select("task_name", "batch_id", "task_transcript")


def names_from_file(spark, sf_dir):
    return scan_names(spark, export_csv(report.reconcile_right_only(spark, sf_dir), _folder(spark, "names")))


def report_from_file(spark, sf_dir):
    """The merged report as a user opens it: text columns, and scores as numbers."""
    return scan_report(spark, export_csv(report.merged_report(spark, sf_dir), _folder(spark, "report")))


def _evaluated(spark, sf_dir):
    folder = _folder(spark, "evaluation")
    write_outputs(t.inference(spark, sf_dir), f"{folder}/outputs")
    export_csv(t.truth(spark, sf_dir), f"{folder}/truth.csv", compression=PACKING)
    evaluate_directory(spark, f"{folder}/outputs", f"{folder}/truth.csv", f"{folder}/result")
    return f"{folder}/result"


def evaluated_files(spark, sf_dir):
    """From output files and a truth file to the files of scores."""
    return load_scores(spark, f"{_evaluated(spark, sf_dir)}/per_image")


def summary_file(spark, sf_dir):
    """The summary of all models, cell by cell."""
    table = scan_report(spark, f"{_evaluated(spark, sf_dir)}/summary.csv")
    cells = [c for c in table.columns if c != "model"]
    numbers = table.select("model", *[col(c).cast("double").alias(c) for c in cells])
    return numbers.unpivot(["model"], [col(c) for c in cells], "cell", "value").where("value IS NOT NULL")


def stats_file(spark, sf_dir):
    path = write_json(stats_document(t.truth(spark, sf_dir)), _folder(spark, "stats"))
    found = spark.read.schema("per_batch MAP<STRING, BIGINT>, total BIGINT").json(path)
    return found.select("total", F.explode("per_batch").alias("batch_id", "count"))


def result_map_null_batch(spark, sf_dir):
    """Averages by batch where toxic documents have no batch."""
    scores = evaluation.scored(spark, sf_dir)
    lost = t.read(spark, sf_dir, "labels").where("toxic = 1").select(t.image_of("doc_", "doc_id").alias("_image"))
    scores = scores.join(lost, scores["image_name"] == lost["_image"], "left").withColumn(
        "batch_id", F.when(F.col("_image").isNull(), F.col("batch_id"))
    )
    return score_map(scores, no_batch="none").select("model", F.explode("per_batch").alias("batch_id", "_v")).select(
        "model", "batch_id", F.col("_v.cer").alias("cer"), F.col("_v.count").alias("count")
    )


def cache_appended(spark, sf_dir):
    """New responses in the cache table, read as a later run finds them."""
    images, cache = inference._images(spark, sf_dir), inference._cache(spark, sf_dir)
    path = _folder(spark, "cache")
    append_cache(batch_infer(images, inference.MODELS, inference.PROVIDERS, cache).cache_rows, path)
    rows = spark.read.schema("stem STRING, kind STRING, raw STRING, written TIMESTAMP, model STRING, batch_id STRING").parquet(path)
    text = F.when(F.col("kind") == "vision", F.get_json_object("raw", "$.fullTextAnnotation.text")).otherwise(F.col("raw"))
    return rows.select("model", "batch_id", "stem", "kind", text.alias("text"))


def infer_status(spark, sf_dir):
    """What became of each model."""
    images, cache = inference._images(spark, sf_dir), inference._cache(spark, sf_dir)
    return batch_infer(images, inference.MODELS, inference.PROVIDERS, cache).status


def infer_partial_start(spark, sf_dir):
    """A model that starts only at the second attempt loses nothing; one that never starts keeps its stored responses."""
    tried = []

    def flaky(settings):
        tried.append(1)
        if len(tried) % 2:
            raise RuntimeError("busy")
        return settings["new"]

    providers = inference.PROVIDERS | {"plain": Provider(inference._plain, init=flaky)}
    cache = inference._cache(spark, sf_dir)
    stored = cache.where("model = 'seeing'").select(F.lit("no_weights").alias("model"), "batch_id", "stem", F.lit("plain").alias("kind"), F.lit("held").alias("raw"))
    return batch_infer(inference._images(spark, sf_dir), inference.MODELS, providers, cache.unionByName(stored)).outputs


def images_from_manifest(spark, sf_dir):
    """Images of a stored list of paths; what is not two levels below ``images`` is none."""
    docs = t.truth(spark, sf_dir)
    folder = F.when(F.col("batch_id") == "batch-3", F.lit("data/other/")).otherwise(F.lit("data/images/"))
    paths = docs.select(F.concat(folder, "batch_id", F.lit("/"), "image_name").alias("path"), F.length("transcript").cast("long").alias("length"))
    return images_of(paths).select("batch_id", "image_name", "stem", "suffix", "mime_type", "length")


def coverage_of_splits(spark, sf_dir):
    return coverage(report.merged_report(spark, sf_dir), report._split(spark, sf_dir))


def normalise_compatibility(spark, sf_dir):
    """Ligatures and wide letters, which only the compatibility forms take apart."""
    odd = F.translate("text", "bw", "ﬁＡ")
    forms = [unicode_normalise(odd, f).alias(f.lower()) for f in ("NFC", "NFKC")]
    return t.read(spark, sf_dir, "documents").select("doc_id", *forms, F.length(unicode_normalise(odd, "NFKD")).alias("nfkd_chars"))


def script_cleaned(spark, sf_dir):
    """Repeated syllable marks, zero-width spaces and marks before a clause end."""
    odd = F.replace(F.replace(F.replace("text", F.lit(" "), F.lit(TSHEG * 3)), F.lit("."), F.lit(TSHEG + SHAD)), F.lit("e"), F.lit("e" + ZERO_WIDTH_SPACE))
    return t.read(spark, sf_dir, "documents").select("doc_id", clean_script(odd).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        truth_from_parts, csv_mixed_headers, csv_na_tokens_and_spaces, outputs_in_order, catalog_from_files, projection_from_files,
        annotations_from_file, names_from_file, report_from_file, evaluated_files, summary_file, stats_file, result_map_null_batch,
        cache_appended, images_from_manifest, coverage_of_splits, infer_status, infer_partial_start, normalise_compatibility, script_cleaned,
    )
}

_S = f"WITH {t.SCORES_SQL} "
_STRIP = inference._STRIPPED.format("text")
_NUMBER = "CAST(replace(source, 'src', '') AS INTEGER)"

ORACLE = {
    "truth_from_parts": "SELECT 'conv_' || conv_id AS image_name, role AS batch_id,"
    f" arg_max(nullif({inference._STRIPPED.format('repeat(text, CASE WHEN turn = 0 THEN 1 ELSE 3 END)')}, ''), turn) AS transcript"
    " FROM conversations GROUP BY conv_id, role",
    "csv_mixed_headers": files.ORACLE["csv_roundtrip"],
    "csv_na_tokens_and_spaces": f"""
SELECT 'doc_' || doc_id || '.png' AS image_name, {t.BATCH_SQL} AS batch_id,
  CASE WHEN {_NUMBER} >= 10 THEN nullif({_STRIP}, '') WHEN {_NUMBER} = 4 THEN 'NA' WHEN {_NUMBER} = 5 THEN 'kept' WHEN {_NUMBER} = 6 THEN '' END AS transcript
FROM documents""",
    "outputs_in_order": f"WITH {files._INFERENCE} SELECT model, image_name, batch_id,"
    " CAST(row_number() OVER (PARTITION BY model ORDER BY batch_id, image_name) AS INTEGER) AS place FROM outputs",
    "catalog_from_files": metadata.ORACLE["script_enrich"],
    "projection_from_files": metadata.ORACLE["catalog_projection"],
    "annotations_from_file": f"SELECT 'doc_' || doc_id || '.png' AS task_name, {t.BATCH_SQL} AS batch_id, nullif(text, '') AS task_transcript"
    " FROM documents",
    "names_from_file": report.ORACLE["reconcile_right_only"],
    "report_from_file": report.ORACLE["merged_report"],
    "evaluated_files": files.ORACLE["score_files"],
    "summary_file": _S + "SELECT model, 'overall_cer' AS cell, round_even(avg(cer), 6) AS value FROM scores GROUP BY model"
    " UNION ALL SELECT model, 'cer_' || batch_id, round_even(avg(cer), 6) FROM scores GROUP BY model, batch_id",
    "stats_file": files.ORACLE["batch_stats_document"],
    "result_map_null_batch": _S + ", lost AS (SELECT 'doc_' || doc_id || '.png' AS image FROM labels WHERE toxic = 1)"
    " SELECT model, CASE WHEN image IS NULL THEN batch_id ELSE 'none' END AS batch_id, round_even(avg(cer), 6) AS cer, count(*) AS count"
    " FROM scores LEFT JOIN lost ON image_name = image GROUP BY 1, 2",
    "images_from_manifest": f"SELECT {t.BATCH_SQL} AS batch_id, 'doc_' || doc_id || '.png' AS image_name, 'doc_' || doc_id AS stem,"
    " '.png' AS suffix, 'image/png' AS mime_type, length(text) AS length FROM documents WHERE source <> 'src3'",
    "coverage_of_splits": f"""{report._REPORT} SELECT count(*) AS row_count, count(script_name) AS script_matches,
  count("double_cer") AS scored_rows, (SELECT count(*) FROM merged) AS in_both,
  (SELECT count(*) FROM consolidated c ANTI JOIN bench b ON trim(c.file_name) = b.image_name) AS only_in_catalog,
  (SELECT count(*) FROM bench b ANTI JOIN consolidated c ON trim(c.file_name) = b.image_name) AS only_in_benchmark FROM report""",
    "cache_appended": inference.ORACLE["inference_cache_rows"],
    "infer_status": f"""WITH {inference._WORK}
SELECT model, model <> 'no_weights' AS ok, CASE WHEN model = 'no_weights' THEN 'RuntimeError: weights not found' END AS error,
  count(*) FILTER (NOT cached AND model <> 'no_weights') AS answered, count(*) FILTER (NOT cached AND model = 'no_weights') AS unanswered
FROM work GROUP BY model
UNION ALL SELECT 'nobody', false, 'unknown provider ''unheard of''', 0, 0""",
    "infer_partial_start": inference.ORACLE["resumable_infer"]
    + " UNION ALL SELECT 'no_weights', image_name, batch_id, 'held' FROM img WHERE toxic",
    "normalise_compatibility": "SELECT doc_id, nfc_normalize(translate(text, 'bw', 'ﬁＡ')) AS nfc,"
    " nfc_normalize(replace(replace(text, 'b', 'fi'), 'w', 'A')) AS nfkc,"
    " CAST(length(replace(text, 'b', 'fi')) + length(regexp_replace(nfc_normalize(text), '[^À-ÅÇ-ÏÑ-ÖÙ-Ý"
    "à-åç-ïñ-öù-ýÿ]', '', 'g')) AS INTEGER) AS nfkd_chars FROM documents",
    "script_cleaned": "SELECT doc_id, replace(regexp_replace(replace(replace(text, ' ', '་་་'), '.', '་།'),"
    " '་{2,}', '་', 'g'), '་།', '།') AS text FROM documents",
}
