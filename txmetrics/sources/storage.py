"""Trees of many small files, listed, read and written by tasks.

Spark's file sources keep the path of every file in the driver. Here a tree is listed by one task
for each of its folders, the listing is a table like any other (a manifest), and bytes are
read by the task that needs them. Paths are those of the local file system or of a store that
``pyarrow.fs`` knows by its scheme.
"""

from __future__ import annotations

import bz2
import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = "batch_id STRING, folder STRING, folder_modified TIMESTAMP"
FILES = "batch_id STRING, name STRING, path STRING, length BIGINT, modified TIMESTAMP"
MANIFEST = f"{FILES}, folder_modified TIMESTAMP, listed_at TIMESTAMP"
#: Bytes of files that a task holds before it passes them on (one larger file is a step of its own).
STEP_BYTES = 64 << 20
#: A folder that changed so shortly before it was listed may have changed again since, unseen.
CLOCK_TICK = timedelta(seconds=2)
_TIME = pa.timestamp("us", "UTC")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(//[^/]*)?(/.*)?", path, re.DOTALL)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    system, top = fs.FileSystem.from_uri(f"{found[1]}:{quote(found[2] or '//')}/")
    return system, top.rstrip("/") + (found[3] or "")


def _entries(folder: str, hidden: bool, folders: bool) -> list[fs.FileInfo]:
    """What is directly below a folder, by name; nothing if there is no such folder."""
    system, inner = file_system(folder)
    kind = fs.FileType.Directory if folders else fs.FileType.File
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((e for e in found if e.type == kind and (hidden or e.base_name[0] not in "_.")), key=lambda e: e.base_name)


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """The folders below ``root`` with the time of their last change, listed by one task; none if it does not exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found = _entries(top, True, folders=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "batch_id": pa.array([e.base_name for e in found], pa.string()),
                        "folder": pa.array([f"{top}/{e.base_name}" for e in found], pa.string()),
                        "folder_modified": pa.array([e.mtime for e in found], _TIME),
                    }
                )

    return spark.createDataFrame([(root.rstrip("/"),)], "root STRING").coalesce(1).mapInArrow(run, FOLDERS)


def list_files(folders: DataFrame, ending: str = "", hidden: bool = False, tasks: int | None = None) -> DataFrame:
    """The files of each folder (``batch_id``, ``folder``, ``folder_modified``) whose names end with ``ending``.

    Each folder is listed by one task; ``tasks`` of them at a time, four a core by default. Files of
    zero bytes are files. What lies deeper is not listed.
    """
    spark = folders.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch_id, folder, changed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                now = datetime.now(timezone.utc)
                found = [e for e in _entries(folder, hidden, folders=False) if e.base_name.endswith(ending)]
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "batch_id": pa.array([batch_id] * len(part), pa.string()),
                            "name": pa.array([e.base_name for e in part], pa.string()),
                            "path": pa.array([f"{folder}/{e.base_name}" for e in part], pa.string()),
                            "length": pa.array([e.size for e in part], pa.int64()),
                            "modified": pa.array([e.mtime for e in part], _TIME),
                            "folder_modified": pa.array([changed] * len(part), _TIME),
                            "listed_at": pa.array([now] * len(part), _TIME),
                        }
                    )

    spread = folders.select("batch_id", "folder", "folder_modified").repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "folder")
    return spread.mapInArrow(run, MANIFEST)


def list_tree(spark: SparkSession, root: str, ending: str = "", hidden: bool = False, tasks: int | None = None) -> DataFrame:
    """Manifest of the files at ``<root>/<batch>/<file>``.

    ``batch_id, name, path, length, modified, folder_modified, listed_at``. Files at the root and in
    deeper folders are left out, and files whose names start with ``_`` or ``.`` unless ``hidden``, as
    Spark's file sources do. A root that does not exist has no files.
    """
    return list_files(list_folders(spark, root), ending, hidden, tasks)


def count_entries(folders: DataFrame, most: int) -> int:
    """The folders and all that lies below them, at any depth; beyond ``most`` only a number above it. Tasks count, the driver gets a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found, waiting = found + 1, [top]
                while waiting and found <= most:
                    system, inner = file_system(folder := waiting.pop())
                    entries = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
                    found += len(entries)
                    waiting += [f"{folder}/{e.base_name}" for e in entries if e.type == fs.FileType.Directory]
        yield pa.RecordBatch.from_pydict({"entries": pa.array([found], pa.int64())})

    spread = folders.select("folder").repartition(4 * folders.sparkSession.sparkContext.defaultParallelism, "folder")
    return spread.mapInArrow(run, "entries BIGINT").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]


GLOB = "{}[]*?\\"
#: Endings by which Spark's file sources unpack a file, and those that tasks unpack as well.
PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")
_UNPACK = {".bz2": bz2.decompress, ".deflate": zlib.decompress, ".gz": gzip.decompress}


#: Of a listing's rows those whose files Spark's file sources read.
VISIBLE = "NOT (startswith(name, '.') OR (startswith(name, '_') AND NOT contains(name, '=')) OR endswith(name, '._COPYING_'))"


class Matches(NamedTuple):
    found: DataFrame
    #: Whether there is any match, a folder named ``key=value`` below one, a file that only Spark unpacks.
    any: bool
    partitions: bool
    foreign: bool


def _visible(name: str) -> bool:
    """Whether Spark's file sources read a file of this name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _tops(spark: SparkSession, path: str) -> list[tuple[str, str | None]] | None:
    """Folders with the pattern that names in them must match, or paths with none; None if tasks cannot tell.

    Only what stands before the last part of a pattern is looked up by the driver.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def whole(name: str) -> str:
        top = hadoop.Path(name)
        return top.getFileSystem(conf).makeQualified(top).toString()

    if not any(c in GLOB for c in path):
        return [(whole(path), None)]
    parent, slash, last = path.rstrip("/").rpartition("/")
    if not slash or not parent or re.search(r"\{[^}]*/", path) or parent.endswith("\\"):
        return None
    if any(c in GLOB for c in parent):
        top = hadoop.Path(parent)
        # a pattern whose folders do not exist gives null
        parents = [e.getPath().toString() for e in top.getFileSystem(conf).globStatus(top) or [] if e.isDirectory()]
    else:
        parents = [whole(parent)]
    try:
        pattern = hadoop.GlobPattern(last).compiled().pattern()
        re.compile(pattern)
    except (Py4JJavaError, re.error):
        return None
    return [(p.rstrip("/"), pattern) for p in parents]


def list_matches(spark: SparkSession, path: str) -> Matches | None:
    """The files that a path or a pattern of Spark's file sources stands for, listed by tasks; None if only Spark can tell.

    A file that matches, and the files directly in a folder that does. ``found`` has ``path`` and ``length``; files of zero bytes
    and hidden names are left out, as Spark does.
    """
    try:
        tops = _tops(spark, path)
        for top in tops or []:
            file_system(top[0])
    except (ValueError, OSError):  # a store that pyarrow does not know, or whose client is missing
        return None
    if tops is None:
        return None

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = file_system(top)
                if pattern is None:
                    entries = [(top, system.get_file_info(inner))]
                else:
                    listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
                    entries = [(f"{top}/{e.base_name}", e) for e in listed if re.fullmatch(pattern, e.base_name, re.DOTALL)]
                entries = [(p, e) for p, e in entries if e.type in (fs.FileType.File, fs.FileType.Directory)]
                for lo in range(0, len(entries), 10_000):
                    part = entries[lo : lo + 10_000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "name": pa.array([e.base_name for _, e in part], pa.string()),
                            "path": pa.array([p for p, _ in part], pa.string()),
                            "length": pa.array([e.size for _, e in part], pa.int64()),
                            "inside": pa.array([e.type == fs.FileType.Directory for _, e in part], pa.bool_()),
                        }
                    )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partitions = foreign = False
            for name, top, inside in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                foreign |= not inside and _visible(name) and _foreign(name)
                waiting, direct = [top] if inside else [], True
                while waiting and not partitions:
                    system, inner = file_system(folder := waiting.pop())
                    for e in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                        if e.type == fs.FileType.Directory and _visible(e.base_name):
                            partitions |= "=" in e.base_name
                            waiting.append(f"{folder}/{e.base_name}")
                        foreign |= direct and e.type == fs.FileType.File and _visible(e.base_name) and _foreign(e.base_name)
                    direct = False
            flags = [pa.array([batch.num_rows > 0]), pa.array([partitions]), pa.array([foreign])]
            yield pa.RecordBatch.from_arrays(flags, ["any", "partitions", "foreign"])

    some = spark.createDataFrame(tops, "top STRING, pattern STRING")
    matched = some.mapInArrow(matching, "name STRING, path STRING, length BIGINT, inside BOOLEAN")
    flags = matched.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(seen, "any BOOLEAN, partitions BOOLEAN, foreign BOOLEAN")
    known = flags.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in flags.columns]).first()
    folders = matched.where("inside").select(F.col("name").alias("batch_id"), F.col("path").alias("folder"), F.lit(None).cast("timestamp").alias("folder_modified"))
    files = matched.where("NOT inside").unionByName(list_files(folders, hidden=True), allowMissingColumns=True)
    return Matches(files.where(VISIBLE).where("length > 0").select("path", "length"), *known)


def _foreign(name: str) -> bool:
    return name.endswith(PACKED) and not name.endswith(tuple(_UNPACK))


def unpacked(path: str, content: bytes) -> bytes:
    """Content of a file, unpacked as its ending says."""
    for ending, unpack in _UNPACK.items():
        if path.endswith(ending):
            return unpack(content)
    return content


def read_manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """The newest complete manifest of a store, None if there is none."""
    try:
        # a snapshot that is still being written, or whose job failed, has no files yet
        held = spark.read.schema(f"{MANIFEST}, snapshot BIGINT").parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = held.agg(F.max("snapshot")).first()[0]
    return None if newest is None else _files_of(held.where(F.col("snapshot") == newest).drop("snapshot"))


def _files_of(snapshot: DataFrame) -> DataFrame:
    """A snapshot without the row that tells one of an empty tree from none."""
    return snapshot.where("path IS NOT NULL")


def refresh_manifest(
    spark: SparkSession, root: str, store: str, ending: str = "", *, hidden: bool = False, full: bool = False, tasks: int | None = None
) -> DataFrame:
    """Bring the stored manifest of a tree up to date and return it.

    Only folders that changed since they were listed, and new ones, are listed again; the rows of all
    others are carried over, and those of vanished folders go. A folder changes when a file in it is
    added, removed or renamed, but not when one is overwritten in place, and some stores give folders
    no time at all: such folders are always listed, and ``full`` lists every folder. A folder that had
    changed within two seconds before its listing is listed again. The old manifest stays readable until
    the new one is complete, and after it.
    """
    held = None if full else read_manifest(spark, store)
    folders = list_folders(spark, root)
    if held is None:
        fresh = list_files(folders, ending, hidden, tasks)
    else:
        known = held.groupBy("batch_id").agg(
            F.min("folder_modified").alias("was"), F.min("listed_at").alias("listed")
        ).select(F.col("batch_id").alias("known"), "was", "listed")
        joined = folders.join(known, F.col("batch_id") == F.col("known"), "left")
        tick = F.expr(f"INTERVAL {int(CLOCK_TICK.total_seconds())} SECONDS")
        same = F.coalesce((F.col("folder_modified") == F.col("was")) & (F.col("folder_modified") < F.col("listed") - tick), F.lit(False))
        joined = joined.withColumn("same", same)
        kept = joined.where("same").select(F.col("batch_id").alias("known"))
        carried = held.join(kept, F.col("batch_id") == F.col("known"), "left_semi")
        fresh = list_files(joined.where("NOT same"), ending, hidden, tasks).unionByName(carried)
    path = f"{store}/snapshot={int(datetime.now(timezone.utc).timestamp() * 1e6)}"
    fresh.unionByName(spark.createDataFrame([(None,) * len(fresh.columns)], MANIFEST)).write.parquet(path)
    return _files_of(spark.read.schema(MANIFEST).parquet(path))


def read_files(rows: DataFrame, path_column: str = "path", into: str = "content") -> DataFrame:
    """``rows`` with the bytes of the file at ``path_column``, null for a null path.

    Each file is read by the task that holds its row, so put this after all joins and shuffles.
    Rows are passed on a few files at a time. A file that does not exist is an error.
    """
    columns = rows.columns
    schema = rows.drop(into).schema.add(into, "binary")
    place = columns.index(path_column)
    kept = [k for k, c in enumerate(columns) if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, content = 0, 0, []
            for k, path in enumerate(batch.column(place).to_pylist()):
                content.append(None if path is None else _bytes(path))
                held += len(content[-1] or b"")
                if held >= STEP_BYTES:
                    yield part(batch, start, content)
                    start, held, content = k + 1, 0, []
            if content:
                yield part(batch, start, content)

    def part(batch: pa.RecordBatch, start: int, content: list) -> pa.RecordBatch:
        some = batch.slice(start, len(content))
        return pa.RecordBatch.from_arrays([*(some.column(k) for k in kept), pa.array(content, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _bytes(path: str) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        return file.read()


def write_files(rows: DataFrame, path_column: str = "path", content_column: str = "content") -> int:
    """Write each row's bytes as the file at its path, made whole before it gets its name; the number of files.

    Rows that repeat a path leave one of them. A null path is left out, null content is an empty file.
    """
    text = rows.select(F.col(path_column).alias("path"), F.coalesce(F.col(content_column).cast("binary"), F.lit(b"")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = file_system(path)
                folder, _, name = inner.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                waiting = f"{folder}/.{uuid.uuid4().hex}.{name[:100]}"
                with system.open_output_stream(waiting, compression=None) as file:
                    file.write(content)
                system.move(waiting, inner)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    return text.where("path IS NOT NULL").mapInArrow(run, "files BIGINT").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


__all__ = [
    "file_system",
    "list_files",
    "list_folders",
    "list_matches",
    "list_tree",
    "read_files",
    "read_manifest",
    "refresh_manifest",
    "write_files",
]
