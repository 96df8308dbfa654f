"""Helpers for data-dependent column names and for keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_SUFFIX = "_cer"
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def q(name: str) -> str:
    """Quote a column name; model and batch names hold dots, dashes and leading digits."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def score_columns(df: DataFrame) -> list[str]:
    """Score columns of a wide report, sorted."""
    return sorted(c for c in df.columns if c.endswith(SCORE_SUFFIX))


def model_of(column: str) -> str:
    return column.removesuffix(SCORE_SUFFIX)


def to_number(value: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


def same_key(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str] | None = None) -> Column:
    """Join condition in which a null key equals a null key."""
    condition = F.lit(True)
    for i, (a, b) in enumerate(zip(keys, right_keys or keys)):
        part = left[q(a)].eqNullSafe(right[q(b)])
        condition = part if i == 0 else condition & part
    return condition


def distinct_values(df: DataFrame, column: str) -> list[str]:
    """Distinct values that become column names (models, batches).

    A wide table has one column per value, so their number is bounded by the same setting
    that bounds a Spark pivot; going over it is an error, not a cut.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select(col(column).alias("v")).where("v IS NOT NULL").distinct().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"column {column!r} has more than {limit} distinct values")
    return sorted(r.v for r in rows)
