"""The corpus pipeline: documents in, clean tokenised documents out.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``; columns beyond those pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.llm import decontamination, language_id, near_dedup, pii, sentencepieces
from txmetrics.sinks.tables import materialise

#: A language is taken as known from this calibrated score on.
LEAST_LANGUAGE_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose language cannot be told: null texts, texts without a letter, low scores.

    A null ``lang`` is filled with the prediction. An empty table, or one without a labelled text,
    has no language to learn, so nothing can be told and nothing is kept.
    """
    model = language_id.train(docs)
    found = language_id.language(model)
    return (
        docs.withColumn("__language", found)
        .where(F.col("__language.score") >= LEAST_LANGUAGE_SCORE)
        .withColumn("lang", F.coalesce("lang", "__language.lang_pred"))
        .drop("__language")
    )


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group with a similarity of 0.8 or more.

    Rows that repeat an id are one document: it stays if none of them is a near-copy of a smaller id,
    and then as one row, one with words if there is any, of those the first by text and then by the other columns.
    Documents without words are no one's duplicates. A row with a null id cannot be told from others and stays.
    """
    found = near_dedup.near_duplicates(docs).where(F.col("doc_id").isNotNull())
    kept = materialise(found.groupBy("doc_id").agg(F.every("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "corpus-kept")
    stay = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    repeated = kept.where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return stay
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = F.struct(wordless, F.col("text").isNull(), F.col("text"), F.to_json(row))
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row"))
    return stay.unionByName(first.select("row.*"))


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that contain a benchmark item. Null and empty texts contain none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.uncontaminated(docs, items)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in every text; ``n_chars`` follows. A null text stays null."""
    masked = docs.withColumn("text", pii.redact(pii.train(docs)))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, byte spans and decoded text of every document. A null or empty text has no pieces."""
    import public_tokenizers

    encoded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", "decoded")


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark_items),
    ("pii", without_personal_data),
    ("sentencepiece", in_pieces),
]

#: The language model and the learnt spans cannot be written in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
