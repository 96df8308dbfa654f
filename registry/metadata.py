"""Catalog sheets and script dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import tables as t
from txmetrics.operators import rows_per_group
from txmetrics.plans import catalog_projection as project
from txmetrics.plans import consolidate, join_script_metadata, union_sheets


def catalog_union(spark, sf_dir):
    return union_sheets(t.sheets(spark, sf_dir))


def catalog_projection(spark, sf_dir):
    return project(t.sheets(spark, sf_dir))


def script_enrich(spark, sf_dir):
    return consolidate(t.sheets(spark, sf_dir), *t.script_sheets(spark, sf_dir))


def script_enrich_literal_nan(spark, sf_dir):
    """Null ids as the text ``nan`` on both sides: they meet the padding rows of the dimension."""
    catalog = union_sheets(t.sheets(spark, sf_dir)).select("technology", "file_name", "script_id")
    nations = t.read(spark, sf_dir, "nation")
    code = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("src"), F.col("n_nationkey").cast("string")))
    scripts = nations.select(code.alias("script_id"), F.col("n_name").alias("script_name"))
    multi = nations.select(code.alias("script_id"), F.lower("n_name").alias("script_name"))
    return join_script_metadata(catalog, scripts, multi, null_key="literal_nan")


def technology_counts(spark, sf_dir):
    return rows_per_group(union_sheets(t.sheets(spark, sf_dir)), "technology")


def technology_distinct(spark, sf_dir):
    return union_sheets(t.sheets(spark, sf_dir)).agg(
        F.count_distinct("technology").alias("technologies"), F.count_distinct("script_id").alias("script_ids")
    )


QUERIES = {
    f.__name__: f
    for f in (
        catalog_union, catalog_projection, script_enrich, script_enrich_literal_nan, technology_counts, technology_distinct,
    )
}

_C = f"WITH {t.CATALOG_SQL} "
_COLUMNS = 'technology, file_name, script_id, notes, legibility, exact_font, color, period, "3_types"'

ORACLE = {
    "catalog_union": _C + f"SELECT {_COLUMNS} FROM raw_catalog",
    "catalog_projection": _C
    + 'SELECT technology, file_name, script_id, NULL::VARCHAR AS format, legibility, color, NULL::VARCHAR AS interlinear, "3_types",'
    ' NULL::VARCHAR AS "8_categories", NULL::VARCHAR AS descenders_length_ratio, NULL::VARCHAR AS popularity, period FROM raw_catalog',
    "script_enrich": f"WITH {t.CATALOG_SQL}, {t.SCRIPTS_SQL} SELECT * FROM consolidated",
    "script_enrich_literal_nan": _C
    + ", dim AS (SELECT CASE WHEN n_regionkey > 0 THEN 'src' || n_nationkey END AS id, n_name FROM nation)"
    " SELECT c.technology, c.file_name, coalesce(trim(c.script_id), 'nan') AS script_id, coalesce(s.n_name, lower(m.n_name)) AS script_name"
    " FROM raw_catalog c LEFT JOIN dim s ON coalesce(trim(c.script_id), 'nan') = coalesce(s.id, 'nan')"
    " LEFT JOIN dim m ON coalesce(trim(c.script_id), 'nan') = coalesce(m.id, 'nan')",
    "technology_counts": _C + "SELECT technology, count(*) AS count FROM raw_catalog GROUP BY technology",
    "technology_distinct": _C
    + "SELECT count(DISTINCT technology) AS technologies, count(DISTINCT script_id) AS script_ids FROM raw_catalog",
}
