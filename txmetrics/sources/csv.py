"""CSV scans. Every cell is read as text; types are given late and explicitly.

A CSV with newlines inside quotes cannot be split, so CSV is meant for the edge; between jobs
use Parquet tables with the same columns.
"""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.columns import SCORE_SUFFIX, col, score_columns, to_number
from txmetrics.functions.text import NULL_TOKENS, decode_uri, null_tokens, strip
from txmetrics.sources.storage import list_matches, read_files, unpacked

POSITION = "_pos"
CSV_OPTIONS = {"multiLine": True, "quote": '"', "escape": '"'}


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def require_path(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


def header_names(cells: list[str | None]) -> list[str]:
    """Unique column names for a header row: blanks are numbered, repeats get ``.1``, ``.2``."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        base = (cell or "").lstrip("\ufeff") or f"Unnamed: {i}"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def _header(line: str) -> tuple[str, ...]:
    cells = next(csv.reader(io.StringIO(line)), [])
    return tuple(header_names([c.lstrip("\ufeff").strip() for c in cells]))


def _first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The first line of every file that has one."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(paths).select(decode_uri(F.col("_metadata.file_path")).alias("path"), "value", place.alias("place"))
    return lines.groupBy("path").agg(F.min_by("value", "place").alias("line"))


def headers(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], int]:
    """The different headers of all files under ``paths``, and how many files have each.

    One pass in which every file gives its first line; a header is one line. Only the headers reach
    the driver.
    """
    lines = _first_lines(spark, paths)
    found: dict[tuple[str, ...], int] = {}
    for row in lines.groupBy("line").count().collect():
        found[_header(row["line"])] = found.get(_header(row["line"]), 0) + row["count"]
    return found


def _files_by_header(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files under ``paths`` by header; asked for only where headers differ."""
    lines = _first_lines(spark, paths)
    found: dict[tuple[str, ...], list[str]] = {}
    for row in lines.collect():
        found.setdefault(_header(row["line"]), []).append(_glob_literal(row["path"]))
    return {names: sorted(files) for names, files in sorted(found.items())}


def _scan(spark: SparkSession, paths: list[str], names: list[str], tokens: tuple[str, ...]) -> DataFrame:
    """Scan files that share a header; columns are bound by position, then named.

    A row with fewer cells than the header ends in nulls; one with more is an error, since a cell
    would be lost. The position follows file names, then rows, however files are packed into tasks.
    """
    guard = f"c{len(names)}"
    schema = ", ".join(f"c{i} STRING" for i in range(len(names) + 1))
    raw = spark.read.schema(schema).csv(paths, header=True, **CSV_OPTIONS)
    cells = [null_tokens(F.col(f"c{i}"), tokens).alias(name) for i, name in enumerate(names)]
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    message = F.concat(F.lit("a row has more cells than the header in "), F.col("_metadata.file_path"))
    fits = F.when(F.col(guard).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return raw.select("*", position.alias(POSITION), "_metadata").where(fits).select(*cells, POSITION, "_metadata")


def scan_csv(
    spark: SparkSession,
    path: str,
    *,
    strip_cells: bool = False,
    position: bool = False,
    tokens: tuple[str, ...] = NULL_TOKENS,
) -> DataFrame:
    """All-string scan of one CSV table with stripped header names and missing-value tokens as null."""
    require_path(spark, path)
    result = None
    for names, files in _by_header(spark, path).items():
        table = _scan(spark, files, list(names), tokens)
        cells = [strip(col(n)).alias(n) if strip_cells else col(n) for n in names]
        table = table.select(*cells, *([POSITION] if position else []))
        result = table if result is None else result.unionByName(table, allowMissingColumns=True)
    if result is None:
        raise ValueError(f"no header in {path}")
    return result


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The path itself if all its files share a header, else its files by header."""
    found = headers(spark, path)
    return {names: [path] for names in found} if len(found) < 2 else _files_by_header(spark, path)


def _file_table(ending: str) -> str:
    """Pattern for the model of ``<model><ending>.csv``, a file or a directory of parts."""
    return rf"/([^/]+){ending}\.csv(/[^/]+)?$"


PARTITION_TABLE = r"/model=([^/]+)/[^/]+$"


def _glob_literal(name: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def _model_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files of the tables that match ``pattern``: one for each model, or the parts of a directory.

    A table of no bytes is an error: it has no header, and leaving it out would lose a model.
    """
    if not path_exists(spark, pattern):
        return []
    files = spark.read.format("binaryFile").load(pattern)
    held = {row.path for row in files.select("path").toLocalIterator()}
    listed = {re.sub("^file:/+", "file:/", unquote(uri)) for uri in files.inputFiles()}
    if void := sorted(p for p in listed - held if re.search(r"\.csv$", p) and not re.search(r"\.csv/", p)):
        raise ValueError(f"no header in {void}")
    return sorted(held)


def scan_tables(
    spark: SparkSession,
    directory: str,
    model: str | None = None,
    *,
    ending: str = "",
    required: tuple[str, ...] = (),
    tokens: tuple[str, ...] = NULL_TOKENS,
) -> DataFrame:
    """One frame over the CSV tables of all models, or of one, with its name in ``model``.

    A directory may hold ``<model><ending>.csv`` files, or be partitioned as ``model=<model>``.
    Files are grouped by header, so each distinct header costs one scan of all its files. Every
    header must name the columns of ``required``.
    """
    name = "*" if model is None else _glob_literal(model)
    groups: list[tuple[tuple[str, ...], str, list[str]]] = []
    files = [_glob_literal(p) for p in _model_files(spark, f"{directory}/{name}{ending}.csv")]
    if files:
        groups += [(names, _file_table(ending), paths) for names, paths in _files_by_header(spark, files).items()]
    parts = f"{directory}/model={name}"
    if path_exists(spark, parts):
        groups += [(names, PARTITION_TABLE, paths) for names, paths in _by_header(spark, parts).items()]
    if not groups:
        raise FileNotFoundError(f"{directory}/{name}{ending}.csv")
    for names, _, paths in groups:
        if missing := [c for c in required if c not in names]:
            raise ValueError(f"missing column(s) {missing}, found {list(names)} in {paths[:3]}")
    result = None
    for names, pattern, paths in groups:
        model_name = F.regexp_extract(decode_uri(F.col("_metadata.file_path")), pattern, 1)
        if pattern == PARTITION_TABLE:
            model_name = decode_uri(model_name)
        frame = _scan(spark, paths, list(names), tokens).select(
            model_name.alias("model"), *[strip(col(n)).alias(n) for n in names], POSITION
        )
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return result


def _require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}, found {df.columns}")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: ``image_name, batch_id, transcript`` and the row position."""
    table = scan_csv(spark, path, strip_cells=True, position=True)
    _require_columns(table, ("image_name", "batch_id"))
    text = F.col("transcript") if "transcript" in table.columns else F.lit("")
    return table.select("image_name", "batch_id", text.alias("transcript"), POSITION)


def scan_outputs(spark: SparkSession, directory: str, model: str | None = None) -> DataFrame:
    """Outputs of all models below a directory, or of one; duplicate rows are kept."""
    table = scan_tables(spark, directory, model, required=("image_name", "batch_id"))
    text = F.col("inference") if "inference" in table.columns else F.lit("")
    return table.select("model", "image_name", "batch_id", text.alias("inference"), POSITION)


def load_scores(spark: SparkSession, directory: str, model: str | None = None) -> DataFrame:
    """Per-image scores of ``<model>_cer.csv`` files as one long table."""
    table = scan_tables(spark, directory, model, ending=SCORE_SUFFIX, required=("image_name", "batch_id", "cer"))
    return table.select("model", "image_name", "batch_id", to_number(F.col("cer")).alias("cer"))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report: text columns, and score columns as numbers."""
    table = scan_csv(spark, path)
    scores = set(score_columns(table))
    return table.select(*[to_number(col(c)).alias(c) if c in scores else col(c) for c in table.columns])


def scan_names(spark: SparkSession, path: str) -> DataFrame:
    """Image names of a list file; no file gives no names."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "image_name STRING")
    return scan_csv(spark, path).select(strip(F.col("image_name")).alias("image_name"))


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation export with at least ``task_name, batch_id, task_transcript``."""
    table = scan_csv(spark, path)
    _require_columns(table, ("task_name", "batch_id", "task_transcript"))
    return table


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generic typed CSV reader; a missing path raises."""
    require_path(spark, path)
    return spark.read.csv(path, header=True, inferSchema=True, **CSV_OPTIONS)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Generic JSON reader for whole-document files, in UTF-8; a missing path raises.

    Tasks list the files and read them as whole texts, which are parsed as strings: the multi-line source prepares every file on
    its own, and any file source keeps all paths in the driver. Stores and packings that only Spark knows are left to its file
    sources, and so are folders named ``key=value``, which add columns.
    """
    matches = list_matches(spark, path)
    if matches is not None and not matches.any:
        raise FileNotFoundError(path)
    if matches is not None and not matches.partitions and not matches.foreign:
        files = read_files(matches.found.select("path").repartition(4 * spark.sparkContext.defaultParallelism))
        return spark.read.json(files.rdd.map(lambda row: unpacked(row.path, bytes(row.content)).decode("utf-8", "replace").removeprefix("\ufeff")))
    require_path(spark, path)
    texts = spark.read.text(path, wholetext=True)
    if texts.columns != ["value"]:
        return spark.read.json(path, multiLine=True)
    return spark.read.json(texts.rdd.map(lambda row: row.value.removeprefix("\ufeff")))
