"""Joins. None of them names a physical strategy: Spark broadcasts a side only when its size
statistics allow it, and splits skewed partitions of the others at run time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col, same_key
from txmetrics.functions.text import strip


def last_wins(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key: the one with the highest ``order``. Null keys are a key, null values stay."""
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    winner = F.max_by(F.struct(*[col(c).alias(c) for c in rest]), order).alias("_row")
    return df.groupBy(*[col(k) for k in keys]).agg(winner).select(*[col(k) for k in keys], "_row.*")


def _check_unique(df: DataFrame, keys: list[str], what: str) -> None:
    repeated = df.groupBy(*[col(k) for k in keys]).count().where("count > 1").take(1)
    if repeated:
        raise ValueError(f"{what} has more than one row for key {repeated[0][:-1]}")


SPREAD = "_spread"


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, seed: str, spread_by: list[str] | None = None
) -> DataFrame:
    """Equi-join on ``keys`` that run-time skew handling can always split.

    Spark splits a skewed partition only if both inputs come straight from a shuffle and no
    later step relies on the result's partitioning, which a chain of joins on one key prevents.
    Joining on a hash of the keys and a ``seed`` as well gives every step a partitioning of its
    own. Left rows with a null key match nothing; they are hashed by ``spread_by`` (the whole row
    by default), so they do not gather in one task.
    """
    values = [col(k) for k in keys]
    no_match = F.lit(False)
    for value in values:
        no_match = no_match | value.isNull()
    own = F.xxhash64(*values, F.lit(seed))
    row = F.xxhash64(*[col(c) for c in spread_by or left.columns])
    spread_left = left.withColumn(SPREAD, F.when(no_match, row).otherwise(own))
    return spread_left.join(right.withColumn(SPREAD, own), [*keys, SPREAD], how).drop(SPREAD)


def fill_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    unique: bool = False,
    seed: str = "fill",
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Left join in which ``right`` fills the null cells of shared columns and adds its own.

    Cells of ``left`` win. Several right rows for one key give several result rows, unless
    ``unique`` asks for an error instead. Give joins of a chain different seeds; ``spread_by`` are
    columns that tell left rows without a key apart.
    """
    if unique:
        _check_unique(right, [on], "right side")
    others = [c for c in right.columns if c != on]
    names = {c: f"_r{i}" for i, c in enumerate(others)}
    side = right.select(col(on), *[col(c).alias(n) for c, n in names.items()])
    joined = spread_join(left, side, [on], "left", seed, spread_by)
    filled = [
        F.coalesce(col(c), F.col(names[c])).alias(c) if c in names else col(c) for c in left.columns
    ]
    added = [F.col(names[c]).alias(c) for c in others if c not in left.columns]
    return joined.select(*filled, *added)


class Reconciled(NamedTuple):
    merged: DataFrame
    only_in_catalog: DataFrame
    only_in_benchmark: DataFrame


def reconcile(benchmark: DataFrame, catalog: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> Reconciled:
    """Match benchmark ``image_name`` with catalog ``file_name``; both are stripped.

    Three separate joins rather than one full outer join: the outer join cannot be split when
    one name holds a large share of the rows, inner and anti joins can, and the anti joins read
    no column of their right side but the name.
    """
    bench = benchmark.withColumn("image_name", strip(F.col("image_name")))
    cat = catalog.withColumn("file_name", strip(F.col("file_name")))
    shared = [c for c in cat.columns if c in bench.columns]
    left = bench.select(*[col(c).alias(c + suffixes[0]) if c in shared else col(c) for c in bench.columns])
    right = cat.select(*[col(c).alias(c + suffixes[1]) if c in shared else col(c) for c in cat.columns])
    name = "image_name" + (suffixes[0] if "image_name" in shared else "")
    file = "file_name" + (suffixes[1] if "file_name" in shared else "")
    merged = left.join(right, left[name] == right[file], "inner").drop("file_name", "transcript")
    names = bench.select(F.col("image_name").alias("_name")).distinct()
    files = cat.select(F.col("file_name").alias("_name")).distinct()
    return Reconciled(
        merged,
        cat.join(names, cat.file_name == names["_name"], "left_anti"),
        bench.join(files, bench.image_name == files["_name"], "left_anti"),
    )


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which null keys match; columns of ``right`` are appended."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    side = right.select(*[col(k).alias(n) for k, n in names.items()], *[col(c) for c in right.columns if c not in keys])
    condition = same_key(left, side, keys, list(names.values()))
    return left.join(side, condition, "left").drop(*names.values())
