"""Scoring model outputs against ground truth."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.columns import same_key
from txmetrics.functions.distance import cer, edit_distance, round6
from txmetrics.functions.text import normalise
from txmetrics.operators.aggregates import SUM_PARTS, add_sums, by_batch, exact_sums, mean6, model_summary, overall
from txmetrics.operators.joins import last_wins
from txmetrics.sinks.csv import export_csv
from txmetrics.sinks.tables import write_partitioned
from txmetrics.sources.csv import POSITION, load_truth, scan_outputs

KEYS = ["image_name", "batch_id"]


class Evaluation(NamedTuple):
    scores: DataFrame
    per_batch: DataFrame
    overall: DataFrame


def truth_table(truth: DataFrame, order: Column | str | None = POSITION) -> DataFrame:
    """Ground truth with one transcript per image: the last one by ``order``.

    ``None`` states that the keys are unique, which saves the aggregation. A table without the
    position column of a scan has no order of its own: name one, or say that there is none to keep.
    """
    if order is None:
        return truth.select(*KEYS, "transcript")
    if order == POSITION and POSITION not in truth.columns:
        raise ValueError("the truth has no position column: pass the order of its rows, or None if its keys are unique")
    elif isinstance(order, str):
        order = F.col(order)
    return last_wins(truth.select(*KEYS, "transcript", order.alias(POSITION)), KEYS, POSITION).drop(POSITION)


def score(
    inference: DataFrame,
    truth: DataFrame,
    *,
    whitespace: bool = False,
    unicode_form: str | None = None,
    script: bool = False,
    truth_order: Column | str | None = POSITION,
    method: str = "auto",
) -> DataFrame:
    """One row per model output: ``distance, ref_len, inf_len, cer`` (unrounded).

    An output for an image without ground truth is scored against empty text; an image without
    output has no row. Ground truth is normalised once, before it meets the models.

    The join is asked to be a sort-merge join. The outputs of M models are M times the truth,
    so where the truth would fit a broadcast both sides are small anyway, and the shuffle by
    image spreads the distance work, which outweighs the data movement by far, over all cores.
    Both inputs come straight from a shuffle, so an image with very many outputs is split over
    several tasks at run time.
    """
    clean = {"whitespace": whitespace, "unicode_form": unicode_form, "script": script}
    texts = truth.withColumn("transcript", normalise(F.col("transcript"), **clean))
    reference = truth_table(texts, truth_order).select(
        F.col("image_name").alias("_image"), F.col("batch_id").alias("_batch"), F.col("transcript").alias("_reference")
    )
    outputs = inference.select("model", *KEYS, normalise(F.col("inference"), **clean).alias("_inference"))
    condition = same_key(outputs, reference, KEYS, ["_image", "_batch"])
    pairs = outputs.join(reference.hint("merge"), condition, "left").select(
        "model", *KEYS, "_inference", F.coalesce("_reference", F.lit("")).alias("_reference")
    )
    measured = pairs.select(
        "model",
        *KEYS,
        edit_distance(F.col("_inference"), F.col("_reference"), method).alias("distance"),
        F.length("_reference").alias("ref_len"),
        F.length("_inference").alias("inf_len"),
    )
    return measured.withColumn("cer", cer(F.col("distance"), F.col("inf_len"), F.col("ref_len")))


def evaluate(inference: DataFrame, truth: DataFrame, **options) -> Evaluation:
    """Scores with their per-batch and overall averages, all lazy.

    Each of the three computes the distances anew; write the scores first when more than one
    is needed, as :func:`evaluate_directory` does.
    """
    scores = score(inference, truth, **options)
    return Evaluation(scores, by_batch(scores), overall(scores))


NO_BATCH = ""


def result_map(per_batch: DataFrame, totals: DataFrame, no_batch: str = NO_BATCH) -> DataFrame:
    """One row per model with its batches as a map of ``batch_id`` to ``(cer, count)``.

    A map has no null key, so rows without a batch are under ``no_batch``; scans give no empty
    batch that it could be mistaken for.
    """
    entry = F.struct(F.coalesce("batch_id", F.lit(no_batch)), F.struct("cer", "count"))
    maps = per_batch.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("per_batch"))
    return totals.select("model", "overall_cer").join(maps, "model", "left")


def score_map(scores: DataFrame, no_batch: str = NO_BATCH) -> DataFrame:
    """The same straight from the scores, in one pass over them: what is kept of them is a sum per model and batch."""
    parts = scores.groupBy("model", "batch_id").agg(*exact_sums(F.col("cer")), F.count("*").alias("count"))
    value = F.struct(mean6(*map(F.col, SUM_PARTS), F.col("count")).alias("cer"), "count")
    entries = F.collect_list(F.struct(F.coalesce("batch_id", F.lit(no_batch)), value))
    return parts.groupBy("model").agg(
        mean6(*add_sums(), F.sum("count")).alias("overall_cer"), F.map_from_entries(F.sort_array(entries)).alias("per_batch")
    )


def export_scores(scores: DataFrame, directory: str) -> str:
    """CSV export ``image_name, batch_id, cer`` in one pass, below ``model=<model>``."""
    rows = scores.select("model", *KEYS, round6(F.col("cer")).alias("cer"))
    return export_csv(rows, directory, order_by=["model", "batch_id", "image_name"], partition_by="model")


def evaluate_directory(
    spark: SparkSession,
    outputs: str,
    truth: str,
    directory: str,
    *,
    model: str | None = None,
    **options,
) -> Evaluation:
    """Score every ``<model>.csv`` of a directory, or one of them, in one plan.

    Writes ``scores`` (Parquet by model), ``per_image`` (CSV by model), and ``summary.csv`` when
    there is more than one model. A missing output file raises ``FileNotFoundError``.

    The keys of the truth are counted first: where none is repeated there is no last row to look for, and its texts are
    shuffled once instead of twice.
    """
    texts, table = scan_outputs(spark, outputs, model), load_truth(spark, truth)
    if "truth_order" not in options and table.groupBy(*KEYS).count().where("count > 1").isEmpty():
        options["truth_order"] = None
    scores = score(texts, table, **options)
    path = write_partitioned(scores, f"{directory}/scores", ["model"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema)
    written = spark.read.schema(schema).parquet(path)
    export_scores(written, f"{directory}/per_image")
    if len(written.select("model").distinct().limit(2).collect()) > 1:
        export_csv(model_summary(written), f"{directory}/summary.csv", order_by=["model"])
    return Evaluation(written, by_batch(written), overall(written))
