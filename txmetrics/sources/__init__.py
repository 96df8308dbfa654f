"""Scans of CSV tables, catalog sheets, image trees and stored responses."""

from txmetrics.sources.csv import (
    load_annotations,
    load_scores,
    load_truth,
    path_exists,
    read_csv,
    read_json,
    scan_csv,
    scan_names,
    scan_outputs,
    scan_report,
)
from txmetrics.sources.files import (
    image_bytes,
    image_listing,
    images_of,
    plain_cache,
    structured_cache,
    transcript_files,
    vision_cache,
)
from txmetrics.sources.storage import list_tree, read_files, read_manifest, refresh_manifest, write_files
from txmetrics.sources.sheets import load_script_sheets, load_sheets

__all__ = [
    "image_bytes",
    "image_listing",
    "images_of",
    "list_tree",
    "load_annotations",
    "load_scores",
    "load_script_sheets",
    "load_sheets",
    "load_truth",
    "path_exists",
    "plain_cache",
    "read_csv",
    "read_files",
    "read_json",
    "read_manifest",
    "refresh_manifest",
    "scan_csv",
    "scan_names",
    "scan_outputs",
    "scan_report",
    "structured_cache",
    "transcript_files",
    "vision_cache",
    "write_files",
]
