"""Reconciliation, wide scores, merged report, summary and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry import tables as t
from registry.evaluation import scored
from txmetrics.functions.columns import col
from txmetrics.operators import ordered_columns, reconcile, widen_scores
from txmetrics.plans import attach_scores, consolidate, coverage, generate_reports
from txmetrics.plans import final_summary as summarise
from txmetrics.sinks import materialise, shared_folder, write_clusters
from txmetrics.sinks.tables import cluster_key


def _consolidated(spark, sf_dir):
    return consolidate(t.sheets(spark, sf_dir), *t.script_sheets(spark, sf_dir))


def _split(spark, sf_dir):
    return reconcile(t.benchmark_table(spark, sf_dir), _consolidated(spark, sf_dir))


def reconcile_both(spark, sf_dir):
    return _split(spark, sf_dir).merged


def reconcile_left_only(spark, sf_dir):
    return _split(spark, sf_dir).only_in_catalog.select(F.col("file_name").alias("image_name"))


def reconcile_right_only(spark, sf_dir):
    return _split(spark, sf_dir).only_in_benchmark.select("image_name")


def scores_wide(spark, sf_dir):
    return widen_scores(scored(spark, sf_dir), t.MODELS, duplicates="forbid")


def _event_scores(spark, sf_dir):
    """Scores with many repeats: a user's events as an image that models scored again and again."""
    return t.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.concat_ws("_", F.lit("user"), F.col("user_id")).alias("image_name"),
        F.get_json_object("props", "$.k").alias("batch_id"),
        (F.col("value") / 100).alias("cer"),
    )


EVENT_MODELS = ["click", "error", "purchase", "signup", "view"]


def scores_wide_repeats(spark, sf_dir):
    return widen_scores(_event_scores(spark, sf_dir), EVENT_MODELS, duplicates="multiply")


def _wide(spark, sf_dir):
    return materialise(widen_scores(scored(spark, sf_dir), t.MODELS, duplicates="forbid"), "evaluation")


def _report(spark, sf_dir, evaluation):
    report = attach_scores(_split(spark, sf_dir).merged, evaluation)
    return report.select(*[col(c) for c in ordered_columns(report)])


def merged_report(spark, sf_dir):
    return _report(spark, sf_dir, widen_scores(scored(spark, sf_dir), t.MODELS, duplicates="forbid"))


def report_coverage(spark, sf_dir):
    return coverage(merged_report(spark, sf_dir))


def final_summary(spark, sf_dir):
    evaluation = _wide(spark, sf_dir)
    return summarise(_report(spark, sf_dir, evaluation), evaluation, reconcile_right_only(spark, sf_dir))


def generated_reports(spark, sf_dir):
    """The whole report job: writes every table and gives back the merged report."""
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    scores = materialise(scored(spark, sf_dir).select("model", "image_name", "batch_id", "cer"), "scores")
    return generate_reports(
        t.sheets(spark, sf_dir), *t.script_sheets(spark, sf_dir), t.benchmark_table(spark, sf_dir), scores, folder
    )


def cluster_keys(spark, sf_dir):
    split = _split(spark, sf_dir).merged
    return split.select("image_name", cluster_key(split, "3_types").alias("cluster"), cluster_key(split, "period").alias("by_period"))


def cluster_tables(spark, sf_dir):
    """Rows per written report table."""
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    path = write_clusters(_split(spark, sf_dir).merged, "3_types", folder)
    written = spark.read.parquet(path)
    return written.groupBy(F.col("_cluster").cast("string").alias("cluster")).agg(F.count("*").alias("count"))


QUERIES = {
    f.__name__: f
    for f in (
        reconcile_both, reconcile_left_only, reconcile_right_only, scores_wide, scores_wide_repeats, merged_report,
        report_coverage, final_summary, generated_reports, cluster_keys, cluster_tables,
    )
}

_R = f"WITH {t.CATALOG_SQL}, {t.SCRIPTS_SQL}, {t.BENCHMARK_SQL}"
_META = (
    'c.technology, c.script_id, c.notes, c.legibility, c.exact_font, c.color, c.period, c."3_types", c.script_name,'
    ' c.popularity_on_web, c."8_cat_combination"'
)
_MERGED = f"merged AS (SELECT b.image_name, b.batch_id, {_META} FROM bench b JOIN consolidated c ON b.image_name = trim(c.file_name))"
_WIDE = (
    "wide AS (SELECT image_name, batch_id, "
    + ", ".join(f"max(round_even(cer, 6)) FILTER (model = '{m}') AS \"{m}_cer\"" for m in t.MODELS)
    + " FROM scores GROUP BY image_name, batch_id)"
)
_CER = ", ".join(f'w."{m}_cer"' for m in t.MODELS)


def _exact_average(column):
    """Average of six-decimal numbers, half to even, in whole numbers: a sum of doubles depends on the order of rows."""
    total, n = f"sum(CAST(round({column} * 1000000) AS HUGEINT))", f"count({column})"
    up = f"2 * ({total} % {n}) > {n} OR 2 * ({total} % {n}) = {n} AND {total} // {n} % 2 = 1"
    return f"CASE WHEN {n} > 0 THEN ({total} // {n} + CASE WHEN {up} THEN 1 ELSE 0 END)::DOUBLE / 1000000 END"


_AVG = ", ".join(f'{_exact_average(f'"{m}_cer"')} AS "{m}_avg_cer"' for m in t.MODELS)
_REPORT = (
    f"{_R}, {t.SCORES_SQL}, {_MERGED}, {_WIDE}, report AS (SELECT m.*, {_CER} FROM merged m LEFT JOIN wide w"
    " ON m.image_name = w.image_name AND m.batch_id = w.batch_id)"
)
_EVENTS = (
    "ev AS (SELECT event_type AS model, 'user_' || user_id AS image_name,"
    " json_extract_string(props, '$.k') AS batch_id, round_even(value / 100, 6) AS cer FROM events)"
)
_KEYS = "translate(\"3_types\", '/\\ ', '___')"
_CLUSTER = f"CASE WHEN trim(coalesce(\"3_types\", '')) = '' THEN '_unspecified' ELSE {_KEYS} END"

ORACLE = {
    "reconcile_both": f"{_R}, {_MERGED} SELECT * FROM merged",
    "reconcile_left_only": f"{_R} SELECT trim(file_name) AS image_name FROM consolidated c"
    " ANTI JOIN bench b ON trim(c.file_name) = b.image_name",
    "reconcile_right_only": f"{_R} SELECT image_name FROM bench b ANTI JOIN consolidated c ON trim(c.file_name) = b.image_name",
    "scores_wide": f"WITH {t.SCORES_SQL}, {_WIDE} SELECT * FROM wide",
    "scores_wide_repeats": f"WITH {_EVENTS}, " + ", ".join(
        f"{m} AS (SELECT image_name, batch_id, cer AS {m}_cer FROM ev WHERE model = '{m}')" for m in EVENT_MODELS
    ) + " SELECT * FROM click" + "".join(f" FULL JOIN {m} USING (image_name, batch_id)" for m in EVENT_MODELS[1:]),
    "merged_report": f"{_REPORT} SELECT * FROM report",
    "generated_reports": f"{_REPORT} SELECT * FROM report",
    "report_coverage": f'{_REPORT} SELECT count(*) AS row_count, count(script_name) AS script_matches, count("double_cer") AS scored_rows FROM report',
    "final_summary": f"""{_REPORT}
SELECT 'overall' AS category, 'whole_benchmark' AS "group", count(*) AS image_count, {_AVG} FROM wide
UNION ALL SELECT 'overall', 'in_both', count(*), {_AVG} FROM report
UNION ALL SELECT 'overall', 'only_in_benchmark', count(*), {_AVG} FROM wide
  WHERE image_name IN (SELECT image_name FROM bench WHERE image_name NOT IN (SELECT trim(file_name) FROM consolidated))
UNION ALL SELECT 'technology', technology, count(*), {_AVG} FROM report WHERE trim(technology) <> '' GROUP BY technology
UNION ALL SELECT 'main_style', "3_types", count(*), {_AVG} FROM report WHERE trim("3_types") <> '' GROUP BY "3_types"
UNION ALL SELECT 'rarity', popularity_on_web, count(*), {_AVG} FROM report WHERE trim(popularity_on_web) <> '' GROUP BY popularity_on_web""",
    "cluster_keys": f"{_R}, {_MERGED} SELECT image_name, {_CLUSTER} AS cluster, '_unspecified' AS by_period FROM merged",
    "cluster_tables": f"{_R}, {_MERGED} SELECT {_CLUSTER} AS cluster, count(*) AS count FROM merged GROUP BY 1",
}
