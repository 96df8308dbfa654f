"""Whole jobs: evaluation, metadata, reports, benchmark tables, batch inference."""

from txmetrics.plans.dataset import (
    batch_stats,
    build_benchmark,
    canonical_batch,
    lay_out,
    normalise_outputs,
    stats_document,
    write_benchmark,
    write_outputs,
)
from txmetrics.plans.evaluation import Evaluation, evaluate, evaluate_directory, result_map, score, score_map
from txmetrics.plans.inference import Provider, batch_infer, cached_text, plan_work, split_cached
from txmetrics.plans.metadata import catalog_projection, consolidate, join_script_metadata, normalise_columns, union_sheets
from txmetrics.plans.report import attach_scores, coverage, final_summary, generate_reports

__all__ = [
    "Evaluation",
    "Provider",
    "attach_scores",
    "batch_infer",
    "batch_stats",
    "build_benchmark",
    "cached_text",
    "canonical_batch",
    "catalog_projection",
    "consolidate",
    "coverage",
    "evaluate",
    "evaluate_directory",
    "final_summary",
    "generate_reports",
    "join_script_metadata",
    "lay_out",
    "normalise_columns",
    "normalise_outputs",
    "plan_work",
    "result_map",
    "score",
    "score_map",
    "split_cached",
    "stats_document",
    "union_sheets",
    "write_benchmark",
    "write_outputs",
]
