"""Relational operators: dedup, fill joins, reconciliation, widening, aggregates."""

from txmetrics.operators.aggregates import (
    by_batch,
    grouped_scores,
    micro_average,
    model_summary,
    overall,
    pairs_by_group,
    rows_per_group,
)
from txmetrics.operators.joins import attach, fill_join, last_wins, reconcile
from txmetrics.operators.wide import ordered_columns, widen_scores

__all__ = [
    "attach",
    "by_batch",
    "fill_join",
    "grouped_scores",
    "last_wins",
    "micro_average",
    "model_summary",
    "ordered_columns",
    "overall",
    "pairs_by_group",
    "reconcile",
    "rows_per_group",
    "widen_scores",
]
