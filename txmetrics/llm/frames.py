"""Helpers shared by the operators: column picking, batches of bounded size, folds, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col

#: Characters of text that one step inside a task holds at a time (one longer text is a step of its own).
STEP_CHARS = 1 << 20


def pick(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; every other column stays behind."""
    return docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text"))


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A null id falls in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts, F.lit(0))


def steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame, schema: str, each: Callable[[list, list[str | None]], dict[str, object]], setup: Callable | None = None
) -> DataFrame:
    """``each(ids, texts)`` over steps of the (doc_id, text) rows; it returns the columns of ``schema``.

    ``setup`` is called once in each task and its result goes to ``each`` as third argument.
    ``schema`` may name ``doc_id`` without a type, which takes that of the input.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = schema.replace("doc_id,", f"doc_id {kind},", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (setup(),) if setup else ()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                out = each(ids.slice(lo, hi - lo), texts[lo:hi], *more)
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
