"""Score aggregates. A score table has one row per model and image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col, distinct_values
from txmetrics.functions.distance import round6


#: Scores below this size are summed exactly, in steps of 10^-18; no real one is as large.
EXACT_BELOW = 2**20
#: The two columns of a sum: the exact part, and the part that is too large or not finite (null if there is none).
SUM_PARTS = ("_exact", "_rest")


def exact_sums(value: Column) -> list[Column]:
    """The sum of ``value`` as SUM_PARTS. The exact part is the same in whatever order rows and tasks come."""
    small = F.abs(value) < EXACT_BELOW
    exact = F.sum(F.when(small, value).cast("decimal(38,18)"))
    rest = F.sum(F.when(small, F.lit(None)).otherwise(value))
    return [c.alias(n) for c, n in zip((exact, rest), SUM_PARTS)]


def add_sums(prefix: str = "") -> list[Column]:
    """Sums of sums."""
    return [F.sum(prefix + n).alias(n) for n in SUM_PARTS]


def mean6(exact: Column, rest: Column, count: Column) -> Column:
    """Average of a sum's parts to six decimals, half to even on the exact quotient."""
    count = F.nullif(count, F.lit(0))
    whole = (F.coalesce(exact.cast("double"), F.lit(0.0)) + rest) / count
    return F.when(rest.isNull(), F.bround(exact / count, 6).cast("double")).otherwise(round6(whole))


def average6(value: Column) -> Column:
    """Average of ``value`` to six decimals that does not depend on the order of rows; null without values."""
    exact, rest = exact_sums(value)
    return mean6(exact, rest, F.count(value))


def overall(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Macro average per model, of unrounded scores. Listed models without rows get 0."""
    spark = scores.sparkSession
    result = scores.groupBy("model").agg(average6(F.col("cer")).alias("cer"), F.count("*").alias("count"))
    if models is not None:
        listed = spark.createDataFrame([(m,) for m in models], "model STRING")
        result = listed.join(result, "model", "left")
    return result.select(
        "model",
        F.coalesce("cer", F.lit(0.0)).alias("overall_cer"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def by_batch(scores: DataFrame) -> DataFrame:
    """Macro average and number of images per model and batch."""
    return scores.groupBy("model", "batch_id").agg(
        average6(F.col("cer")).alias("cer"), F.count("*").alias("count")
    )


def grouped_scores(scores: DataFrame) -> DataFrame:
    """Per-batch and overall rows in one pass; ``is_overall`` tells them apart (1 or 0)."""
    return (
        scores.groupingSets([["model", "batch_id"], ["model"]], "model", "batch_id")
        .agg(
            F.grouping("batch_id").cast("int").alias("is_overall"),
            average6(F.col("cer")).alias("cer"),
            F.count("*").alias("count"),
        )
    )


def model_summary(scores: DataFrame, batches: list[str] | None = None) -> DataFrame:
    """One row per model: ``overall_cer`` and a sorted ``cer_<batch>`` column per batch.

    The scores are reduced to one row per model and batch first, so the wide step moves a
    handful of rows. Pass ``batches`` to save the job that looks them up.
    """
    if batches is None:
        batches = distinct_values(scores, "batch_id")
    parts = scores.groupBy("model", "batch_id").agg(*exact_sums(F.col("cer")), F.count("cer").alias("_count"))
    parts = parts.withColumn("_mean", mean6(*map(F.col, SUM_PARTS), F.col("_count")))
    cells = [F.max(F.when(F.col("batch_id") == b, F.col("_mean"))).alias(f"cer_{b}") for b in sorted(batches)]
    return parts.groupBy("model").agg(mean6(*add_sums(), F.sum("_count")).alias("overall_cer"), *cells)


def micro_average(scores: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Edits over reference characters, both summed; null where no reference has text."""
    return scores.groupBy(*by).agg(
        F.sum("distance").alias("distance"),
        F.sum("ref_len").alias("ref_len"),
        round6(F.sum("distance") / F.nullif(F.sum("ref_len"), F.lit(0))).alias("micro_cer"),
    )


def rows_per_group(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Row count per value of ``column``."""
    kept = df if keep_null else df.where(col(column).isNotNull())
    return kept.groupBy(col(column).alias(column)).agg(F.count("*").alias("count"))


def pairs_by_group(
    df: DataFrame,
    groups: list[tuple[str, Column]],
    averages: dict[str, str],
    always: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """Row count and averages for several groupings in one pass.

    ``groups`` lists a category label with the expression of its group value; a null value
    leaves the row out of that category. Every row is expanded to its (category, group) pairs
    and reduced on the map side, so the shuffle carries one row per group and task. Pairs in
    ``always`` are in the result even when no row belongs to them.
    """
    pairs = [
        F.when(value.isNotNull(), F.struct(F.lit(label).alias("category"), value.cast("string").alias("group")))
        for label, value in groups
    ]
    numbers = [col(c).cast("double").alias(name) for name, c in averages.items()]
    wide = df.select(
        F.explode(F.array_compact(F.array(*pairs))).alias("_pair"), F.lit(1).alias("_weight"), *numbers
    ).select("_pair.*", "_weight", *[col(name) for name in averages])
    if always:
        empty = df.sparkSession.createDataFrame(
            [(c, g, 0) for c, g in always], "category STRING, `group` STRING, _weight INT"
        )
        wide = wide.unionByName(empty, allowMissingColumns=True)
    return wide.groupBy("category", "group").agg(
        F.sum("_weight").alias("image_count"), *[average6(col(n)).alias(n) for n in averages]
    )
