"""Scans of image trees, transcript trees and stored recogniser responses."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.text import is_native, mime_type, stem, suffix
from txmetrics.sources.csv import _glob_literal as glob_literal
from txmetrics.sources.storage import VISIBLE, count_entries, file_system, list_files, list_folders, read_files


#: Files and folders of a tree that Spark's file index may keep in the driver.
INDEXED = 10_000


def split_path(path: str, tree: str, names: tuple[str, str] = ("batch_id", "image_name")) -> list:
    """Batch and file name of a path exactly two levels below ``tree``; both empty for others."""
    pattern = rf"(?s)/{tree}/([^/]+)/([^/]+)\z"
    return [F.regexp_extract(path, pattern, i + 1).alias(name) for i, name in enumerate(names)]


def _tree(spark: SparkSession, root: str, columns: list[str], folder: str | None = None, ending: str = "") -> DataFrame:
    """Files at ``<root>/<folder>/<file>`` whose names end with ``ending``; an absent tree is an empty table.

    Tasks list the folders and read the files, so no path passes through the driver. Stores that only Spark
    can reach are scanned by its own file source.
    """
    files = _listed(spark, root, folder, ending)
    if files is None:
        return _spark_tree(spark, root, columns, folder, ending)
    if "content" in columns:
        # A folder is listed by one task; its files are read by all.
        files = read_files(files.repartition(4 * spark.sparkContext.defaultParallelism))
    return files.select(*columns)


def _folders(spark: SparkSession, root: str) -> DataFrame | None:
    """The folders below ``root``; None if only Spark can reach the store."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    try:
        file_system(root)
    except (ValueError, OSError):  # a scheme that pyarrow does not know, or a store whose client is missing
        return None
    return list_folders(spark, root)


def _batches(spark: SparkSession, root: str, folder: str | None) -> DataFrame | None:
    """The folders below ``root``, or the one; None if only Spark can reach the store."""
    folders = _folders(spark, root)
    return folders if folders is None or folder is None else folders.where(F.col("batch_id") == folder)


def _located(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_replace("path", "^(file:)?/+", "file:/").alias("path"), "length")


def _listed(spark: SparkSession, root: str, folder: str | None, ending: str) -> DataFrame | None:
    """``path`` and ``length`` as listed by tasks; None if only Spark can reach the store."""
    folders = _batches(spark, root, folder)
    return None if folders is None else _located(list_files(folders, ending))


def _spark_tree(spark: SparkSession, root: str, columns: list[str], folder: str | None = None, ending: str = "") -> DataFrame:
    """The same by Spark's file source, which holds all paths in the driver. Deeper files may be among them.

    It is given the folders, not their files: a glob of many files is listed by a job that sends every one of them to the driver.
    A Spark scan leaves out files of zero bytes, which are an image or a transcript like any other
    here; tasks list them, or their names are taken from the index that the driver holds anyway.
    """
    schema = {"path": "path STRING", "length": "length BIGINT", "content": "content BINARY"}
    paths = [f"{root}/{folder or '*'}"]
    if folder is None and (folders := _folders(spark, root)) is not None:
        # A glob would take files that lie beside the folders for folders as well.
        paths = [glob_literal(f"{root}/{row.batch_id}") for row in folders.select("batch_id").collect()]
    try:
        files = spark.read.format("binaryFile").load(paths) if paths else None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = None
    if files is None:
        return spark.createDataFrame([], ", ".join(schema[c] for c in columns))
    listed = _listed(spark, root, folder, ending)
    if listed is None:
        names = [(re.sub("^file:/+", "file:/", unquote(uri)),) for uri in files.inputFiles()]
        empty = spark.createDataFrame(names, "path STRING").join(files.select("path"), "path", "left_anti")
    else:
        empty = listed.where("length = 0")
    nothing = {"path": F.col("path"), "length": F.lit(0).cast("long"), "content": F.lit(b"")}
    found = files.select(*columns).unionByName(empty.select(*[nothing[c].alias(c) for c in columns]))
    return found.where(F.endswith("path", F.lit(ending))) if ending else found


def _large_tree(spark: SparkSession, root: str, folder: str | None) -> DataFrame | None:
    """The rows of ``_spark_tree`` as listed by tasks; None for a tree that the driver can index, or that only Spark can reach."""
    folders = _batches(spark, root, folder)
    if folders is None or count_entries(folders, INDEXED) <= INDEXED:
        return None
    # Spark reads a name like _a=b, and the names of empty files are taken from list_files
    shown = f"CASE WHEN length > 0 THEN {VISIBLE} ELSE substring(name, 1, 1) NOT IN ('_', '.') END"
    return _located(list_files(folders, hidden=True).where(shown))


def image_listing(
    spark: SparkSession, root: str, batch_id: str | None = None, content: bool = False
) -> DataFrame:
    """Images at ``<root>/images/<batch>/<file>``, any extension.

    Without ``content`` the bytes are never read, and the listing is that of Spark's file source, which keeps it in the driver; a tree of
    more than ``INDEXED`` entries is listed by tasks instead, with the same rows. Files at the root of ``images`` and files in
    deeper directories are not images. Spark leaves out names that start with ``_`` or ``.``.
    """
    tree, columns = f"{root}/images", ["path", "length"] + (["content"] if content else [])
    if content:
        return _images(_tree(spark, tree, columns, batch_id), columns)
    files = _large_tree(spark, tree, batch_id)
    return _images(_spark_tree(spark, tree, columns, batch_id) if files is None else files, columns)


def images_of(manifest: DataFrame) -> DataFrame:
    """The same from a table of ``path`` and ``length``, without listing a tree: for trees too large for one driver."""
    return _images(manifest, ["path", "length"])


def _images(files: DataFrame, columns: list[str]) -> DataFrame:
    name = F.col("image_name")
    return (
        files.select(*split_path("path", "images"), *columns)
        .where("batch_id != ''")
        .withColumns({"stem": stem(name), "suffix": suffix(name), "mime_type": mime_type(name)})
    )


def image_bytes(
    spark: SparkSession, root: str, service: str, batch_id: str | None = None, manifest: DataFrame | None = None
) -> DataFrame:
    """Listing with file content, MIME type and ``native``: whether the service takes the format.

    With a ``manifest`` of the tree nothing is listed, and each file is read by the task of its row.
    """
    if manifest is None:
        listing = image_listing(spark, root, batch_id, content=True)
    else:
        listing = images_of(manifest)
        listing = read_files(listing if batch_id is None else listing.where(F.col("batch_id") == batch_id))
    return listing.withColumn("native", is_native(F.col("image_name"), service))


def _contents(spark: SparkSession, root: str, ending: str, manifest: DataFrame | None) -> DataFrame:
    """``path`` and ``content`` of the files of a tree, or of a manifest."""
    if manifest is None:
        return _tree(spark, root, ["path", "content"], ending=ending)
    return read_files(manifest.select("path"))


def transcript_files(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Whole-file transcripts at ``<root>/transcripts/<batch>/<stem>.txt``, or those of a manifest of that tree."""
    files = _contents(spark, f"{root}/transcripts", ".txt", manifest)
    return (
        files.select(*split_path("path", "transcripts", ("batch_id", "_file")), F.decode("content", "UTF-8").alias("transcript"))
        .where("batch_id != ''")
        .select("batch_id", stem(F.col("_file")).alias("stem"), "transcript")
    )


CACHE_SCHEMA = "model STRING, batch_id STRING, stem STRING, kind STRING, raw STRING"


def _cache(files: DataFrame, raw, model: str, kind: str, ending: str) -> DataFrame:
    batch = F.element_at(F.split("path", "/"), -2)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.lit(model).alias("model"),
        batch.alias("batch_id"),
        F.regexp_replace(name, ending, "").alias("stem"),
        F.lit(kind).alias("kind"),
        raw.alias("raw"),
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([gzip.decompress(content)], pa.binary())})


def vision_cache(spark: SparkSession, root: str, model: str) -> DataFrame:
    """Stored vision responses ``<root>/<batch>/<stem>.json.gz``, unpacked by the tasks that read them; files of no bytes are none."""
    files = _tree(spark, root, ["path", "content"], ending=".json.gz").where(F.length("content") > 0)
    files = files.mapInArrow(_unpacked, "path STRING, content BINARY")
    return _cache(files, F.decode("content", "UTF-8"), model, "vision", r"\.json\.gz$")


def structured_cache(spark: SparkSession, root: str, model: str, manifest: DataFrame | None = None) -> DataFrame:
    """Stored structured responses ``<root>/<model>/<batch>/<stem>.json``, or those of a manifest of ``<root>/<model>``."""
    files = _contents(spark, f"{root}/{model}", ".json", manifest)
    return _cache(files, F.decode("content", "UTF-8"), model, "structured", r"\.json$")


def plain_cache(spark: SparkSession, root: str, model: str, manifest: DataFrame | None = None) -> DataFrame:
    """Stored plain responses ``<root>/<model>/<batch>/<stem>.txt``, taken verbatim, or those of a manifest of ``<root>/<model>``."""
    files = _contents(spark, f"{root}/{model}", ".txt", manifest)
    return _cache(files, F.decode("content", "UTF-8"), model, "plain", r"\.txt$")


__all__ = [
    "CACHE_SCHEMA",
    "image_bytes",
    "image_listing",
    "images_of",
    "plain_cache",
    "split_path",
    "structured_cache",
    "transcript_files",
    "vision_cache",
]
