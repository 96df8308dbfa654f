"""Benchmark tables from image and transcript files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.columns import same_key
from txmetrics.functions.text import file_name, stem
from txmetrics.operators.joins import attach
from txmetrics.sinks.csv import export_csv
from txmetrics.sinks.tables import materialise, write_partitioned
from txmetrics.sources.csv import scan_outputs
from txmetrics.sources.storage import read_files

# Batch names that were written in two ways.
BATCH_NAMES = {"b1": "batch-1", "batch-05": "batch-5"}


def canonical_batch(batch: Column) -> Column:
    """One spelling per batch."""
    table = F.create_map(*[F.lit(part) for pair in BATCH_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(table, batch), batch)


def build_benchmark(images: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``image_name, batch_id, transcript`` for every image of a listing.

    An image takes the transcript of its batch and file stem, so two images with the same stem
    share one. An image without transcript is an error, raised when its row is read.
    """
    texts = transcripts.select(
        F.col("batch_id").alias("_batch"), F.col("stem").alias("_stem"), F.col("transcript").alias("_text")
    )
    keyed = images.select("image_name", "batch_id", stem(F.col("image_name")).alias("stem"))
    joined = keyed.join(texts, same_key(keyed, texts, ["batch_id", "stem"], ["_batch", "_stem"]), "left")
    missing = F.raise_error(F.concat(F.lit("no transcript for "), "batch_id", F.lit("/"), "image_name"))
    return joined.select(
        "image_name", "batch_id", F.coalesce("_text", missing.cast("string")).alias("transcript")
    )


def write_benchmark(benchmark: DataFrame, path: str) -> str:
    """CSV export sorted by batch and image."""
    return export_csv(benchmark, path, order_by=["batch_id", "image_name"])


def batch_stats(images: DataFrame) -> DataFrame:
    """Images per batch and in total (``batch_id`` null, ``is_total`` 1)."""
    return images.rollup("batch_id").agg(
        F.grouping("batch_id").cast("int").alias("is_total"), F.count("*").alias("count")
    )


def stats_document(images: DataFrame) -> DataFrame:
    """One row ``per_batch`` (map of batch to count) and ``total``; empty map and 0 without images."""
    counts = images.groupBy("batch_id").agg(F.count("*").alias("count"))
    entries = F.sort_array(F.collect_list(F.struct("batch_id", "count")))
    return counts.agg(
        F.map_from_entries(entries).alias("per_batch"), F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    )


#: Bytes of images and transcripts that one file of a laid-out benchmark should hold.
TARGET_BYTES = 256 << 20


def lay_out(annotations: DataFrame, images: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> str:
    """Benchmark table with image bytes, partitioned by batch.

    ``annotations`` holds ``task_name, batch_id, task_transcript``. An annotated image without file is an error.

    ``images`` is a listing with ``path`` and ``length``, whose bytes never go through a shuffle: rows
    are dealt to writers first, and each reads the files that it writes. A batch gets one writer for
    every ``target_bytes`` of images, so the number of files follows from the bytes and not
    from the number of tasks. A listing with ``content`` instead has its bytes joined as they are.
    """
    tasks = annotations.select(
        F.col("task_name").alias("image_name"),
        canonical_batch(F.col("batch_id")).alias("batch_id"),
        F.col("task_transcript").alias("transcript"),
    )
    late = "content" not in images.columns
    held = ["path", "length"] if late else ["content"]
    files = images.select(
        F.col("batch_id").alias("_batch"), F.col("image_name").alias("_image"), *[F.col(c).alias(f"_{c}") for c in held]
    )
    joined = tasks.join(files, same_key(tasks, files, ["batch_id", "image_name"], ["_batch", "_image"]), "left")
    missing = F.raise_error(F.concat(F.lit("no image "), "batch_id", F.lit("/"), "image_name"))
    found = F.col(f"_{held[0]}")
    rows = joined.select(
        "image_name", "batch_id", "transcript", *[F.col(f"_{c}").alias(c) for c in held[1:]],
        F.coalesce(found, missing.cast("string" if late else "binary")).alias(held[0]),
    )
    if not late:
        # the join has just dealt the bytes out; a rebalance would move them all once more
        return write_partitioned(rows, path, ["batch_id"], rebalance=False)
    writers = F.ceil((F.sum("length") + 1) / target_bytes).cast("int").alias("_writers")
    slots = materialise(rows.groupBy("batch_id").agg(writers), "benchmark-writers")
    total = slots.agg(F.coalesce(F.sum("_writers"), F.lit(1))).first()[0]
    slot = F.pmod(F.xxhash64("image_name"), F.col("_writers"))
    dealt = attach(rows, slots, ["batch_id"]).repartition(int(total), "batch_id", slot)
    whole = read_files(dealt.drop("_writers", "length")).select("image_name", "batch_id", "transcript", "content")
    return write_partitioned(whole, path, ["batch_id"], rebalance=False)


def source_images(spark: SparkSession, root: str) -> DataFrame:
    """Images with bytes from ``<root>/<batch>/images/<file>``."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").load(f"{root}/*/images/*").select(
        F.element_at(parts, -3).alias("batch_id"), file_name(F.col("path")).alias("image_name"), "content"
    )


#: Files of whole texts are packed: a CSV with newlines in quotes cannot be split, so a packed one is read by as many tasks.
PACKING = "gzip"


def write_outputs(outputs: DataFrame, directory: str, *, in_order: bool = False, compression: str | None = PACKING) -> str:
    """CSV export ``image_name, batch_id, inference`` in one pass, below ``model=<model>``.

    Null text becomes empty. With ``in_order`` the rows of a model follow batch and image. The parts are ``.csv.gz`` unless
    ``compression`` is None. For tables that other jobs read,
    ``write_partitioned(outputs, path, ["model"], rebalance=False)`` is the better form.
    """
    rows = outputs.select("model", "image_name", "batch_id", F.coalesce("inference", F.lit("")).alias("inference"))
    order = ["model", "batch_id", "image_name"] if in_order else None
    return export_csv(rows, directory, order_by=order, partition_by="model", compression=compression)


def normalise_outputs(spark: SparkSession, source: str, target: str, *, compression: str | None = PACKING) -> DataFrame:
    """Rewrite model CSVs with the three columns and uniform quoting, packed as by :func:`write_outputs`.

    The result goes to a new place; files that are being read are never overwritten.
    """
    return scan_outputs(spark, write_outputs(scan_outputs(spark, source), target, compression=compression))
