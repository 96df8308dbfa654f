"""Text out of stored recogniser responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.text import strip

TEXT_FIELDS = ("raw_transcription", "normalized_text", "orientation")
LINE_SCHEMA = (
    "lines ARRAY<STRUCT<raw_transcription: VARIANT, normalized_text: VARIANT, "
    "confidence_score: VARIANT, orientation: VARIANT, bounding_box: VARIANT>>"
)


def vision_text(response: Column) -> Column:
    """Full page text of a vision response, empty when it has none."""
    return strip(F.coalesce(F.get_json_object(response, "$.fullTextAnnotation.text"), F.lit("")))


def _typed_line(line: Column) -> Column:
    """Line fields by type; a value that does not fit its type is null."""
    texts = [
        F.when(F.schema_of_variant(line[n]) == "STRING", F.try_variant_get(line[n], "$", "string")).alias(n)
        for n in TEXT_FIELDS
    ]
    numbers = F.try_variant_get(line["bounding_box"], "$", "array<decimal(38,6)>")
    box = F.transform(numbers, lambda v: F.when(v == F.floor(v), v.cast("bigint")))
    return F.struct(
        *texts[:2],
        F.try_variant_get(line["confidence_score"], "$", "double").alias("confidence_score"),
        texts[2],
        box.alias("bounding_box"),
    )


def _complete(line: Column) -> Column:
    """All fields present, confidence in [0, 1], whole numbers in the box."""
    present = line["bounding_box"].isNotNull() & F.forall(line["bounding_box"], lambda v: v.isNotNull())
    for name in TEXT_FIELDS:
        present = present & line[name].isNotNull()
    return present & F.coalesce(line["confidence_score"].between(0.0, 1.0), F.lit(False))


def parse_page(response: Column) -> Column:
    """Lines of a structured page, or null unless it is one JSON object and every line is complete.

    A text field must be a JSON string; a number written as a string counts as a number.
    """
    lines = F.from_json(response, LINE_SCHEMA, {"allowSingleQuotes": "false"})["lines"]
    alone = F.json_array_length(F.concat(F.lit("["), response, F.lit("]"))) == 1
    typed = F.transform(lines, _typed_line)
    return F.when(alone & F.forall(typed, _complete), typed)


def structured_text(response: Column) -> Column:
    """Line texts joined by newlines; a response that is not a valid page is returned as it is."""
    lines = parse_page(response)
    joined = F.array_join(F.transform(lines, lambda line: line["raw_transcription"]), "\n")
    return F.when(lines.isNotNull(), joined).otherwise(response)


def explode_lines(pages: DataFrame, response: str = "response") -> DataFrame:
    """One row per line of every valid page, numbered from 0, with confidence and box."""
    others = [c for c in pages.columns if c != response]
    lines = pages.select(*[F.col(f"`{c}`") for c in others], parse_page(F.col(response)).alias("_lines"))
    return lines.select(
        *[F.col(f"`{c}`") for c in others], F.posexplode("_lines").alias("line_no", "_line")
    ).select(*[F.col(f"`{c}`") for c in others], "line_no", "_line.*")
