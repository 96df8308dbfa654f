"""Catalog sheets and script dimensions to one metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.functions.text import is_blank, strip
from txmetrics.operators.joins import fill_join

# Sheet headers (lower case) and the column names they get.
CATALOG_RENAMES = {
    "file name": "file_name",
    "script id": "script_id",
    "exact font": "exact_font",
    "font ps_name": "font_ps_name",
    "font other_names": "font_other_names",
    "note": "notes",
}
SCRIPT_RENAMES = {
    "id": "script_id",
    "name (phonetics, wylie in parentheses, and english)": "script_name",
    "3 types": "3_types",
    "8 categories": "8_categories",
    "descenders length ratio": "descenders_length_ratio",
    "gigu angle for cursives": "gigu_angle_for_cursives",
}
MULTI_SCRIPT_RENAMES = {
    "ids": "script_id",
    "names (phonetics)": "script_name",
    "3 type combination": "3_type_combination",
    "8 cat. combination": "8_cat_combination",
    "number of scripts": "number_of_scripts",
}
PROJECTION_RENAMES = {
    "file name": "file_name",
    "script id": "script_id",
    "descenders length ratio": "descenders_length_ratio",
    "3 types": "3_types",
    "8 categories": "8_categories",
}
# Columns of the projection, in order. A trailing * stands for any ending.
PROJECTION_COLUMNS = (
    "technology",
    "file_name",
    "script_id",
    "format",
    "legibility",
    "color",
    "interlinear",
    "3_types",
    "8_categories",
    "descenders_length_ratio",
    "popularity_on_*",
    "period",
)
RARITY_HEADER, RARITY_COLUMN = "popularity on ", "popularity_on_"


def rarity_column(columns: list[str]) -> str | None:
    """The popularity column; its ending names the collection it was counted on."""
    return next((c for c in columns if c.startswith(RARITY_COLUMN)), None)


def normalise_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Lower-case and strip headers, drop unnamed columns, rename known ones."""
    names = []
    for name in (c.lower().strip() for c in df.columns):
        if name in renames:
            name = renames[name]
        elif name.startswith(RARITY_HEADER):
            name = name.replace(" ", "_")
        names.append(name)
    kept = [(i, n) for i, n in enumerate(names) if n and not n.startswith("unnamed")]
    repeated = sorted({n for _, n in kept if [m for _, m in kept].count(n) > 1})
    if repeated:
        raise ValueError(f"column name(s) {repeated} appear more than once after renaming")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in kept])


def union_sheets(sheets: dict[str, DataFrame], renames: dict[str, str] = CATALOG_RENAMES) -> DataFrame:
    """Stack catalog sheets by column name, tag rows with their technology, drop padding rows."""
    if not sheets:
        raise ValueError("no catalog sheets")
    combined = None
    for technology, sheet in sheets.items():
        table = normalise_columns(sheet, renames)
        if "technology" in table.columns:
            raise ValueError(f"sheet {technology!r} already has a technology column")
        table = table.select(F.lit(technology).alias("technology"), *[col(c) for c in table.columns])
        combined = table if combined is None else combined.unionByName(table, allowMissingColumns=True)
    return combined.where(~is_blank(F.col("file_name")))


def clean_key(df: DataFrame, key: str, null_key: str) -> DataFrame:
    """Strip a join key; with ``literal_nan`` a null key becomes the text ``nan``."""
    if null_key not in ("no_match", "literal_nan"):
        raise ValueError(f"unknown null key rule {null_key!r}")
    if key not in df.columns:
        return df
    value = strip(col(key).cast("string"))
    if null_key == "literal_nan":
        value = F.coalesce(value, F.lit("nan"))
    return df.withColumn(key, value)


def join_script_metadata(
    catalog: DataFrame,
    scripts: DataFrame,
    multi_scripts: DataFrame,
    *,
    null_key: str = "no_match",
    unique: bool = False,
) -> DataFrame:
    """Fill catalog rows from the script table, then from the multi-script table.

    Catalog cells win over scripts, scripts over multi-scripts. Null ids match nothing by
    default. ``literal_nan`` is the rule of the original job: there a null id turns into the
    text ``nan``, so rows without id match padding rows of the script sheets and multiply.
    """
    catalog, scripts, multi_scripts = (
        clean_key(df, "script_id", null_key) for df in (catalog, scripts, multi_scripts)
    )
    options = {"unique": unique, "spread_by": ["file_name"] if "file_name" in catalog.columns else None}
    result = fill_join(catalog, scripts, "script_id", seed="scripts", **options)
    return fill_join(result, multi_scripts, "script_id", seed="multi", **options)


def consolidate(
    sheets: dict[str, DataFrame], scripts: DataFrame, multi_scripts: DataFrame, **options
) -> DataFrame:
    """Every catalog image with all catalog and script columns, from raw sheets."""
    return join_script_metadata(
        union_sheets(sheets),
        normalise_columns(scripts, SCRIPT_RENAMES),
        normalise_columns(multi_scripts, MULTI_SCRIPT_RENAMES),
        **options,
    )


def catalog_projection(sheets: dict[str, DataFrame]) -> DataFrame:
    """The twelve report columns of all sheets in fixed order; absent ones are null."""
    combined = union_sheets(sheets, PROJECTION_RENAMES)
    columns = []
    for name in PROJECTION_COLUMNS:
        if name.endswith("*"):
            name = rarity_column(combined.columns) or name.removesuffix("_on_*")
        known = name in combined.columns
        columns.append((col(name) if known else F.lit(None)).cast("string").alias(name))
    return combined.select(*columns)
