"""Catalog and script sheets."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from txmetrics.sources.csv import path_exists, require_path, scan_csv

logger = logging.getLogger(__name__)

# Sheet file stems and the technology each one describes.
REPORT_SHEETS = {
    "Benchmark catalog - blockprints": "blockprints",
    "Benchmark catalog - digital_fonts": "digital_fonts",
    "Benchmark catalog - manuscripts": "manuscripts",
    "Benchmark catalog - metal_types": "metal_types",
    "Benchmark catalog - modern": "modern",
    "Benchmark catalog - typewriters": "typewriters",
}
# The projection job reads one sheet more.
PROJECTION_SHEETS = {
    "Benchmark catalog - blockprints": "blockprints",
    "Benchmark catalog - digital_fonts": "digital_fonts",
    "Benchmark catalog - manuscripts": "manuscripts",
    "Benchmark catalog - metal_types": "metal_types",
    "Benchmark catalog - modern": "modern",
    "Benchmark catalog - printeries_woodblocks": "printeries_woodblocks",
    "Benchmark catalog - typewriters": "typewriters",
}
SCRIPTS_SHEET = "Script lists - Scripts"
MULTI_SCRIPTS_SHEET = "Script lists - Multi-scripts"


def load_sheets(
    spark: SparkSession, directory: str, sheets: dict[str, str] = REPORT_SHEETS
) -> dict[str, DataFrame]:
    """Raw sheets by technology; an absent sheet is skipped with a warning, none at all is an error."""
    found = {}
    for name, technology in sheets.items():
        path = f"{directory}/{name}.csv"
        if path_exists(spark, path):
            found[technology] = scan_csv(spark, path)
        else:
            logger.warning("no sheet at %s", path)
    if not found:
        raise FileNotFoundError(f"no catalog sheet in {directory}")
    return found


def load_script_sheets(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Raw scripts and multi-scripts sheets."""
    paths = [f"{directory}/{name}.csv" for name in (SCRIPTS_SHEET, MULTI_SCRIPTS_SHEET)]
    scripts, multi = (scan_csv(spark, require_path(spark, path)) for path in paths)
    return scripts, multi
