"""Parquet tables: intermediate results, partitioned outputs, one partition per report group."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.columns import col, q
from txmetrics.functions.text import is_blank, safe_name

UNSPECIFIED = "_unspecified"
CLUSTER = "_cluster"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder of the context.

    A local session that names none gets a temporary folder, which goes with the process. On a
    cluster a folder of one machine would lose rows, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return _own_folder()


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="txmetrics-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives lost executors; unlike a cached frame it is still pruned by
    column. Used where a result feeds several outputs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_partitioned(
    df: DataFrame, path: str, by: list[str], mode: str = "errorifexists", rebalance: bool = True
) -> str:
    """Parquet table partitioned by ``by``.

    The rebalance hint packs small partitions and splits large ones, so a value that holds a
    third of the rows is written by many tasks and rare values do not make tiny files. It is
    one shuffle of the rows; turn it off for wide rows with few values of ``by``, where every
    task fills decent files anyway.
    """
    if rebalance:
        df = df.hint("rebalance", *[col(c) for c in by])
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return path


def cluster_key(df: DataFrame, column: str):
    """Partition name of a row: the group value as a file name, or ``_unspecified``."""
    value = col(column)
    return F.when(is_blank(value), F.lit(UNSPECIFIED)).otherwise(safe_name(value))


def write_clusters(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> str:
    """One partition per value of ``column``, all columns kept.

    Two values that give the same file name share a partition; no row replaces another.
    """
    if CLUSTER in df.columns:
        raise ValueError(f"column {q(CLUSTER)} is already in use")
    return write_partitioned(df.withColumn(CLUSTER, cluster_key(df, column)), path, [CLUSTER], mode)
