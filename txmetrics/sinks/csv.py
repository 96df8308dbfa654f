"""CSV and JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col

# Cells as they are: no trimming, quotes doubled, null and empty both written as nothing.
WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(
    df: DataFrame,
    path: str,
    order_by: list[str] | None = None,
    partition_by: str | None = None,
    mode: str = "errorifexists",
    compression: str | None = None,
) -> str:
    """Write ``df`` as a directory of CSV parts, each with a header.

    With ``order_by`` the parts are range-partitioned and sorted, so their names follow the
    order. With ``partition_by`` one pass writes a sub-directory per value. Nothing is squeezed
    through a single task; small results come out as one part. ``compression`` is a codec of Spark's CSV writer, whose
    ending the parts get (``gzip``: ``.csv.gz``); scans unpack them.
    """
    if order_by:
        # The row position as last key keeps the order of ties and lets a value that fills a
        # large share of the rows be cut over several parts.
        df = df.withColumn("_row", F.monotonically_increasing_id())
        df = df.orderBy(*[col(c) for c in order_by], "_row").drop("_row")
    writer = df.write.mode(mode).options(**WRITE_OPTIONS)
    if compression:
        writer = writer.options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED"})
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write ``df`` as JSON lines; text is UTF-8, not escaped."""
    df.write.mode(mode).json(path)
    return path
