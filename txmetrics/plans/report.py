"""Merged report, final summary and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col, model_of, score_columns
from txmetrics.functions.text import is_blank, strip
from txmetrics.operators.aggregates import pairs_by_group
from txmetrics.operators.joins import Reconciled, attach, reconcile
from txmetrics.operators.wide import KEYS, ordered_columns, widen_scores
from txmetrics.plans.metadata import consolidate, rarity_column
from txmetrics.sinks.csv import export_csv
from txmetrics.sinks.tables import write_clusters


def attach_scores(merged: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Left join of the wide scores on image and batch; null keys match."""
    return attach(merged, evaluation, KEYS)


def coverage(report: DataFrame, split: Reconciled | None = None) -> DataFrame:
    """How many report rows have a script name and a score of the first model; with ``split`` also its three sizes."""
    scores = score_columns(report)
    named = F.count_if(F.col("script_name").isNotNull()) if "script_name" in report.columns else F.lit(0)
    scored = F.count_if(col(scores[0]).isNotNull()) if scores else F.lit(0)
    counts = report.agg(F.count("*").alias("row_count"), named.alias("script_matches"), scored.alias("scored_rows"))
    if split is None:
        return counts
    sizes = {"in_both": split.merged, "only_in_catalog": split.only_in_catalog, "only_in_benchmark": split.only_in_benchmark}
    one = None
    for name, part in sizes.items():
        row = part.select(F.lit(name).alias("part"))
        one = row if one is None else one.unionByName(row)
    totals = one.agg(*[F.count_if(F.col("part") == n).alias(n) for n in sizes])
    return counts.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _group_value(report: DataFrame, column: str) -> Column:
    return F.when(~is_blank(col(column)), col(column))


def summary_groups(report: DataFrame) -> list[tuple[str, str]]:
    """Category label and column of the groupings that the report has columns for."""
    wanted = [("technology", "technology"), ("main_style", "3_types"), ("rarity", rarity_column(report.columns))]
    return [(label, column) for label, column in wanted if column in report.columns]


def final_summary(
    report: DataFrame, evaluation: DataFrame | None = None, only_in_benchmark: DataFrame | None = None
) -> DataFrame:
    """Image count and average score per model by technology, main style and rarity.

    With the wide ``evaluation`` two overall rows are added: all evaluated images, and those
    whose names are in ``only_in_benchmark`` (``image_name``), if there are any. Each input is
    read once.
    """
    groups = [("overall", F.lit("in_both"))]
    groups += [(label, _group_value(report, column)) for label, column in summary_groups(report)]
    columns = score_columns(report)
    names = {f"{model_of(c)}_avg_cer": c for c in columns}
    summary = pairs_by_group(report, groups, names, always=(("overall", "in_both"),))
    if evaluation is not None:
        eval_names = {f"{model_of(c)}_avg_cer": c for c in score_columns(evaluation)}
        groups = [("overall", F.lit("whole_benchmark"))]
        if only_in_benchmark is not None:
            listed = only_in_benchmark.select(strip(F.col("image_name")).alias("_only")).distinct()
            evaluation = evaluation.join(listed, F.col("image_name").eqNullSafe(F.col("_only")), "left")
            flag = F.col("_only").isNotNull()
            groups.append(("overall", F.when(flag, F.lit("only_in_benchmark"))))
        extra = pairs_by_group(evaluation, groups, eval_names, always=(("overall", "whole_benchmark"),))
        summary = summary.unionByName(extra, allowMissingColumns=True)
    averages = sorted(c for c in summary.columns if c.endswith("_avg_cer"))
    return summary.select("category", "group", "image_count", *[col(c) for c in averages])


def in_summary_order(summary: DataFrame) -> DataFrame:
    """Overall rows first, then technology, main style and rarity, each by value."""
    place = F.when(
        F.col("category") == "overall",
        F.array_position(F.array(*map(F.lit, ("whole_benchmark", "in_both", "only_in_benchmark"))), F.col("group")),
    ).otherwise(
        3 + F.array_position(F.array(*map(F.lit, ("technology", "main_style", "rarity"))), F.col("category"))
    )
    return summary.orderBy(place, "group")


def generate_reports(
    sheets: dict[str, DataFrame],
    scripts: DataFrame,
    multi_scripts: DataFrame,
    benchmark: DataFrame,
    scores: DataFrame,
    directory: str,
    *,
    duplicates: str = "forbid",
    **options,
) -> DataFrame:
    """All report tables below ``directory``; returns the merged report.

    The consolidated metadata, the wide scores and the merged report are written once as
    Parquet and read back by the outputs that need them. Lists and the summary are CSV.
    """
    spark = benchmark.sparkSession

    def table(df: DataFrame, name: str) -> DataFrame:
        path = f"{directory}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    consolidated = table(consolidate(sheets, scripts, multi_scripts, **options), "consolidated_metadata")
    evaluation = table(widen_scores(scores, duplicates=duplicates), "evaluation")
    split = reconcile(benchmark, consolidated)
    only_catalog = split.only_in_catalog.select(F.col("file_name").alias("image_name"))
    export_csv(only_catalog, f"{directory}/only_in_consolidated.csv")
    only_benchmark = table(split.only_in_benchmark.select("image_name"), "only_in_benchmark")
    export_csv(only_benchmark, f"{directory}/only_in_benchmark.csv")
    merged = attach_scores(split.merged, evaluation)
    report = table(merged.select(*[col(c) for c in ordered_columns(merged)]), "merged_report")
    summary = final_summary(report, evaluation, only_benchmark)
    export_csv(in_summary_order(summary), f"{directory}/final_summary.csv")
    outputs = {"technology": "by_technology", "main_style": "by_main_styles", "rarity": "by_rarity"}
    for label, column in summary_groups(report):
        write_clusters(report, column, f"{directory}/{outputs[label]}")
    return report
