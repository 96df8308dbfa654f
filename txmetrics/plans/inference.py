"""Resumable batch inference: what is stored is reused, what is missing runs on executors."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.functions.columns import same_key
from txmetrics.functions.responses import structured_text, vision_text
from txmetrics.functions.text import stem
from txmetrics.operators.joins import attach, last_wins, spread_join
from txmetrics.sinks.tables import materialise, shared_folder

CACHE_KEYS = ["model", "batch_id", "stem", "kind"]
DEFAULT_PROVIDER = "local"


@dataclass(frozen=True)
class Provider:
    """A user-supplied recogniser.

    ``run(image, settings, state)`` gets the image row as a dict (``image_name, batch_id, path``
    and ``content`` if the listing has it) and returns text, or text and raw response.
    ``init(settings)`` runs once per task and model, again if it fails; what it returns is ``state``.
    ``kind`` is the form of the raw response: ``plain``, ``vision``, ``structured``, or None
    for models that are run every time.
    """

    run: Callable[[dict, dict, Any], Any]
    init: Callable[[dict], Any] | None = None
    kind: str | None = "plain"


class Inference(NamedTuple):
    outputs: DataFrame
    cache_rows: DataFrame
    status: DataFrame


def plan_work(
    images: DataFrame, models: dict[str, dict], providers: dict[str, Provider]
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One row per model and image, and the models whose provider is unknown.

    The models are settings of the job, so each image row is expanded over a literal list of
    them; there is no join.
    """
    known, skipped = [], []
    for model, settings in models.items():
        provider = settings.get("provider", DEFAULT_PROVIDER)
        if provider in providers:
            known.append(F.struct(F.lit(model).alias("model"), F.lit(providers[provider].kind).cast("string").alias("kind")))
        else:
            skipped.append((model, f"unknown provider {provider!r}"))
    if not known:
        work = images.select(F.lit("").alias("model"), F.lit("").alias("kind"), "*").where("false")
    else:
        work = images.select(F.explode(F.array(*known)).alias("_m"), "*").select("_m.*", "*").drop("_m")
    return work.withColumn("stem", stem(F.col("image_name"))), skipped


def cached_text(raw: Column, kind: Column) -> Column:
    """Text of a stored response by its kind; plain text is taken verbatim."""
    return F.when(kind == "vision", vision_text(raw)).when(kind == "structured", structured_text(raw)).otherwise(raw)


def _latest(cache: DataFrame) -> DataFrame:
    if "written" not in cache.columns:
        cache = cache.withColumn("written", F.lit(None).cast("timestamp"))
    stored = cache.select(*CACHE_KEYS, "raw", F.coalesce("written", F.timestamp_seconds(F.lit(0))).alias("written"))
    return last_wins(stored, CACHE_KEYS, "written").select(*CACHE_KEYS, "raw")


def split_cached(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work rows that have a stored response (with its text), and those still to be run.

    Both sides are shuffled as they are: leave image bytes out of ``work`` and fetch them for the
    pending rows afterwards, as :func:`batch_infer` does.
    """
    done = spread_join(work, _latest(cache), CACHE_KEYS, "inner", "done", spread_by=CACHE_KEYS + ["image_name"]).withColumn(
        "text", cached_text(F.col("raw"), F.col("kind"))
    )
    return done, work.join(cache.select(*CACHE_KEYS), CACHE_KEYS, "left_anti")


def with_content(pending: DataFrame, images: DataFrame) -> DataFrame:
    """Pending rows with the columns of their images; the bytes of an image are moved once, for all its models.

    The rows of an image are its models, so their list is as short as the list of models. The join is
    asked to be a sort-merge join: a broadcast of few keys would leave all calls in as many tasks as
    the images have files, and calls cost far more than moving bytes.
    """
    return _by_model(_wanted(pending, images))


def _image_keys(images: DataFrame) -> list[str]:
    return [c for c in ("batch_id", "image_name", "path") if c in images.columns]


def _wanted(pending: DataFrame, images: DataFrame) -> DataFrame:
    """The images that have pending rows, these as a list."""
    keys = _image_keys(images)
    wanted = pending.groupBy(*keys).agg(F.collect_list(F.struct("model", "kind", "stem")).alias("_models"))
    names = {k: f"_key_{k}" for k in keys}
    side = wanted.select(*[F.col(k).alias(n) for k, n in names.items()], "_models")
    return images.join(side.hint("merge"), same_key(images, side, keys, list(names.values())), "inner").drop(*names.values())


def _by_model(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("_m", F.explode(F.array_distinct("_models"))).drop("_models").select("_m.*", "*").drop("_m")


#: Column of the chunk, by which the images of all chunks are laid out.
CHUNK = "_chunk"


def _lay_out_chunks(pending: DataFrame, images: DataFrame, chunks: int, tasks: int) -> DataFrame:
    """The images of all chunks as one table with a partition for each, of about ``tasks`` files.

    However many chunks there are, the bytes of an image are joined and written once; a chunk reads its own folder.
    """
    spark = images.sparkSession
    place = F.xxhash64(*[F.col(k) for k in _image_keys(images)])
    rows = _wanted(pending, images).withColumn(CHUNK, F.pmod(place, F.lit(chunks)).cast("int"))
    # The files of a chunk are read by a task each, as Spark packs small files up to the number of cores.
    rows = rows.repartition(chunks * tasks, CHUNK, F.pmod(F.floor(place / chunks), F.lit(tasks)))
    path = f"{shared_folder(spark)}/inference-chunks-{uuid.uuid4().hex}"
    rows.write.partitionBy(CHUNK).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


RESULT_SCHEMA = (
    "model STRING, batch_id STRING, image_name STRING, stem STRING, kind STRING, "
    "text STRING, raw STRING, error STRING, model_error STRING"
)


def _start(provider: Provider, settings: dict, attempts: int) -> tuple[Any, str | None]:
    """The state of a model, or why it could not start after so many attempts."""
    if provider.init is None:
        return None, None
    message = None
    for _ in range(attempts):
        try:
            return provider.init(settings), None
        except Exception as error:
            message = f"{type(error).__name__}: {error}"
    return None, message


def _runner(models: dict[str, dict], providers: dict[str, Provider], attempts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, model_error = None, None, None  # one model at a time: rows come sorted by model
        for batch in batches:
            rows = []
            for image in batch.to_dict("records"):
                model = image["model"]
                settings = models[model]
                provider = providers[settings.get("provider", DEFAULT_PROVIDER)]
                if model != current:
                    state = None  # let the last one go before the next is loaded
                    state, model_error = _start(provider, settings, attempts)
                    current = model
                text, raw, error = "", None, None
                if model_error is None:
                    try:
                        answer = provider.run(image, settings, state)
                        text, raw = answer if isinstance(answer, tuple) else (answer, None)
                        text = (text or "").strip()
                    except Exception as failure:
                        text, error = "", f"{type(failure).__name__}: {failure}"
                rows.append(
                    (model, image["batch_id"], image["image_name"], image["stem"], image["kind"], text, raw, error, model_error)
                )
            yield pd.DataFrame(
                rows, columns=["model", "batch_id", "image_name", "stem", "kind", "text", "raw", "error", "model_error"]
            )

    return run


#: What tells one call from another.
CALL = ["model", "batch_id", "image_name"]
#: Calls in a task, where rows have no bytes by which Spark could size tasks.
CALLS_PER_TASK = 64


def read_journal(spark: SparkSession, journal: str) -> DataFrame | None:
    """Answers that are committed in a journal, and the run that made them; None if there are none yet."""
    try:
        return spark.read.schema(f"{RESULT_SCHEMA}, run STRING").parquet(journal)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _only(rows: DataFrame, calls: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on CALL in which null keys match."""
    side = calls.select(*[F.col(c).alias(f"_call_{c}") for c in CALL])
    return rows.join(side, same_key(rows, side, CALL, [f"_call_{c}" for c in CALL]), how)


def answer(
    pending: DataFrame,
    images: DataFrame | None,
    models: dict[str, dict],
    providers: dict[str, Provider],
    journal: str,
    chunk_rows: int,
    max_parallel: int | None,
    attempts: int,
) -> DataFrame:
    """Run ``pending`` in chunks of about ``chunk_rows`` calls, each committed to ``journal`` before the next begins.

    Calls that the journal has an answer for are not made. ``images`` has the bytes, if any. Returns
    the answers of all pending calls, and for those without one why their model did not start.
    """
    spark, run = pending.sparkSession, uuid.uuid4().hex
    asked = materialise(pending, "inference-pending")
    held = read_journal(spark, journal)
    left = asked if held is None else _only(asked, held.where("model_error IS NULL"), "left_anti")
    rows = left.count()
    chunks = math.ceil(rows / chunk_rows)
    of_chunk = F.pmod(F.xxhash64(*CALL), F.lit(max(chunks, 1)))
    tasks = max_parallel or max(1, min(math.ceil(rows / max(chunks, 1) / CALLS_PER_TASK), 4 * spark.sparkContext.defaultParallelism))
    laid = None
    if images is not None and chunks > 1:
        laid = _lay_out_chunks(left, images, chunks, min(tasks, spark.sparkContext.defaultParallelism))
    for k in range(chunks):
        if laid is not None:
            part = _by_model(laid.where(F.col(CHUNK) == k).drop(CHUNK))
        else:
            part = left.where(of_chunk == k) if chunks > 1 else left
            if images is not None:
                part = with_content(part, images)
        if images is None or max_parallel is not None:
            part = part.repartition(tasks)
        answers = part.sortWithinPartitions("model").mapInPandas(_runner(models, providers, attempts), RESULT_SCHEMA)
        try:
            answers.withColumn("run", F.lit(run)).write.mode("append").parquet(journal)
        except Exception as error:
            error.add_note(f"{k} of {chunks} chunks of calls are committed: pass journal={journal!r} to go on from there")
            raise
    answered = read_journal(spark, journal)
    if answered is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    answered = answered.where((F.col("run") == run) | F.col("model_error").isNull()).drop("run")
    return answered if held is None else _only(answered, asked, "left_semi")


def batch_infer(
    images: DataFrame,
    models: dict[str, dict],
    providers: dict[str, Provider],
    cache: DataFrame | None = None,
    *,
    cache_failures: bool = False,
    max_parallel: int | None = None,
    start_attempts: int = 3,
    journal: str | None = None,
    chunk_rows: int = 100_000,
) -> Inference:
    """Run every model on every image that has no stored response.

    A call that fails gives empty text and its error. A model is started anew in each task, at
    most ``start_attempts`` times; where it cannot start, the rows of that task have no output and
    are pending again in the next run. Stored responses and the answers of other tasks stay. A
    model is not ok only if it started nowhere and nothing is stored for it. Each task holds one
    model at a time. ``max_parallel`` bounds concurrent tasks for rate-limited services.

    Calls are made in chunks of about ``chunk_rows``, one job each, and the answers of a chunk are
    committed to ``journal`` before the next chunk begins; outputs are read from there, so no
    call is repeated for a second output. A run that fails or is killed is started again with the same
    ``journal`` and repeats only calls of the chunk it was in; failed calls that are committed count as made.
    The journal is a folder that all machines share, for one run at a time; by default it is a new
    one in the shared folder, which the error of a failed run names. Where there are several chunks, images with
    bytes are joined to their calls once and written by chunk to the shared folder; an image is in one chunk with all its models.

    ``status`` has a row per model: ``ok``, its ``error`` (also of a partial failure), and how many
    rows were ``answered`` and ``unanswered`` in this run. ``cache_rows`` are the new responses to
    append to the cache. Failed plain and vision calls are among them only with
    ``cache_failures``; failed structured calls are always retried.
    """
    spark = images.sparkSession
    content = "content" in images.columns
    work, skipped = plan_work(images.drop("content"), models, providers)
    done = None
    pending = work
    if cache is not None:
        done, pending = split_cached(work, cache)
    journal = journal or f"{shared_folder(spark)}/inference-{uuid.uuid4().hex}"
    fresh = answer(pending, images if content else None, models, providers, journal, chunk_rows, max_parallel, start_attempts)
    columns = ["model", "image_name", "batch_id", F.col("text").alias("inference")]
    outputs = fresh.where("model_error IS NULL").select(*columns)
    if done is not None:
        outputs = done.select(*columns).unionByName(outputs)

    answered = F.col("error").isNull() if not cache_failures else F.lit(True)
    stored = (
        F.when(F.col("kind") == "plain", F.coalesce("text", F.lit("")))
        .when(F.col("kind") == "vision", F.coalesce("raw", F.lit("{}")))
        .otherwise(F.nullif("raw", F.lit("")))
    )
    cache_rows = (
        fresh.where(answered & F.col("model_error").isNull() & F.col("kind").isNotNull())
        .select(*CACHE_KEYS, stored.alias("raw"), F.current_timestamp().alias("written"))
        .where("raw IS NOT NULL")
    )

    listed = [(m, None) for m in models if m not in dict(skipped)] + skipped
    status = spark.createDataFrame(listed, "model STRING, message STRING")
    counts = fresh.groupBy("model").agg(
        F.count_if(F.col("model_error").isNull()).alias("answered"),
        F.count("model_error").alias("unanswered"),
        F.max("model_error").alias("_broken"),
    )
    held = done.groupBy("model").agg(F.count("*").alias("_held")) if done is not None else None
    status = attach(status, counts, ["model"])
    status = attach(status, held, ["model"]) if held is not None else status.withColumn("_held", F.lit(0))
    some = (F.coalesce("answered", F.lit(0)) + F.coalesce("_held", F.lit(0))) > 0
    status = status.select(
        "model",
        (F.col("message").isNull() & (some | F.col("_broken").isNull())).alias("ok"),
        F.coalesce("message", "_broken").alias("error"),
        F.coalesce("answered", F.lit(0)).alias("answered"),
        F.coalesce("unanswered", F.lit(0)).alias("unanswered"),
    )
    return Inference(outputs, cache_rows, status)


def append_cache(cache_rows: DataFrame, path: str) -> None:
    """Append new responses to the cache table, partitioned by model and batch."""
    cache_rows.write.mode("append").partitionBy("model", "batch_id").parquet(path)
