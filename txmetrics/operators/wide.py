"""Wide score tables and column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import SCORE_SUFFIX, col, distinct_values, same_key, score_columns
from txmetrics.functions.distance import round6

KEYS = ["image_name", "batch_id"]

# Report columns that come first. A trailing * stands for any ending.
LEADING_COLUMNS = (
    "image_name",
    "batch_id",
    "technology",
    "script_id",
    "script_name",
    "format",
    "legibility",
    "color",
    "interlinear",
    "source",
    "notes",
    "exact_font",
    "font_ps_name",
    "font_other_names",
    "font_path",
    "ttc_face_index",
    "font_size_pt",
    "dpi",
    "skt_ok",
    "3_types",
    "8_categories",
    "3_type_combination",
    "8_cat_combination",
    "number_of_scripts",
    "descenders_length_ratio",
    "gigu_angle_for_cursives",
    "popularity_on_*",
    "period",
)


def widen_scores(
    scores: DataFrame, models: list[str] | None = None, *, duplicates: str = "forbid"
) -> DataFrame:
    """One row per image with a ``<model>_cer`` column per model, scores rounded to 6 decimals.

    The long table is folded with one shuffle, however many models there are. An image that a
    model scored more than once cannot be folded: with ``forbid`` it raises an error, with
    ``multiply`` it gets one row per combination, as a chain of joins would give: their number is
    the product of the repeats, so ask for it only where repeats are few. Only the images in
    question take the join route. ``scores`` is read once per model for them, so pass a written
    table with ``multiply``.
    """
    if duplicates not in ("multiply", "forbid"):
        raise ValueError(f"unknown rule for duplicates {duplicates!r}")
    if models is None:
        models = distinct_values(scores, "model")
    models = sorted(models)
    slim = scores.select(*KEYS, "model", round6(F.col("cer")).alias("cer"))
    folded = slim.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("model") == m, F.col("cer"))).alias(m + SCORE_SUFFIX) for m in models],
        F.array(F.lit(0), *[F.count_if(F.col("model") == m) for m in models]).alias("_counts"),
    )
    repeats = F.array_max("_counts") > 1
    columns = KEYS + [m + SCORE_SUFFIX for m in models]
    if duplicates == "forbid":
        error = F.raise_error(
            F.concat(F.lit("scored more than once by a model: "), F.coalesce("image_name", F.lit("null")))
        )
        checked = F.when(repeats, error.cast("string")).otherwise(F.col("image_name"))
        return folded.withColumn("image_name", checked).select(*[col(c) for c in columns])
    single = folded.where(~repeats).select(*[col(c) for c in columns])
    return single.unionByName(_combinations(slim, folded.where(repeats).select(*KEYS, "_counts"), models))


def _combinations(slim: DataFrame, repeated: DataFrame, models: list[str]) -> DataFrame:
    """Every combination of the scores of each repeated image, a missing model counting as one null.

    Models without a score get a null row, so that all joins are inner joins: those can be split
    on either side at run time when one image has very many scores. The seeded hash gives each
    step a shuffle of its own, without which a chain on the same keys could not be split.
    """
    result = repeated.select(*KEYS)
    for i, m in enumerate(models):
        name = m + SCORE_SUFFIX
        some = slim.where(F.col("model") == m).select(*KEYS, F.col("cer").alias(name))
        none = repeated.where(F.col("_counts")[i + 1] == 0).select(*KEYS, F.lit(None).cast("double").alias(name))
        seeded = F.xxhash64(*KEYS, F.lit(m))
        side = some.unionByName(none).select(
            *[col(k).alias(f"_side_{k}") for k in KEYS], col(name), seeded.alias("_side_hash")
        )
        result = result.withColumn("_hash", seeded)
        condition = same_key(result, side, ["_hash", *KEYS], ["_side_hash", *[f"_side_{k}" for k in KEYS]])
        result = result.join(side, condition, "inner").drop("_hash", "_side_hash", *[f"_side_{k}" for k in KEYS])
    return result


def ordered_columns(df: DataFrame) -> list[str]:
    """Leading columns, then the others A-Z, then score columns A-Z."""
    scores = score_columns(df)
    rest = sorted(c for c in df.columns if c not in scores)
    first = []
    for name in LEADING_COLUMNS:
        prefix = name.removesuffix("*")
        first += [c for c in rest if c == name or (prefix != name and c.startswith(prefix))]
    return first + [c for c in rest if c not in first] + scores
