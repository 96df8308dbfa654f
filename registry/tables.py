"""The domain tables as derived from the given ones, in Spark and as SQL.

documents become ground truth, and four imaginary models read them:

* ``exact`` gives the text back;
* ``swap`` writes other characters for ``a``, ``o`` and ``u``;
* ``drop_v2.5`` leaves out ``e`` and ``i`` (a dot in the name on purpose);
* ``double`` writes ``t`` twice, and has no output for images labelled low quality.

Images labelled toxic have a null output. Every model also reads the ``benchmark`` items, which
are not in the ground truth.

The distances of these models are known without computing one. A model that leaves no ``a``,
``o`` or ``u`` cannot match any of those in the reference, so each costs at least one edit, and
one is enough. The same holds for left-out characters; added ones cost the length difference.
The SQL twins use that count, so they check the Spark distances on whole texts independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["exact", "swap", "drop_v2.5", "double"]
BATCH_SQL = "replace(source, 'src', 'batch-')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_of(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".png"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        image_of("doc_", "doc_id").alias("image_name"),
        F.replace("source", F.lit("src"), F.lit("batch-")).alias("batch_id"),
        F.col("text").alias("transcript"),
    )


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    readings = {
        "exact": text,
        "swap": F.translate(text, "aou", "418"),
        "drop_v2.5": F.translate(text, "ei", ""),
        "double": F.replace(text, F.lit("t"), F.lit("tt")),
    }
    labelled = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    shown = F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.lit(None)).otherwise
    outputs = [F.struct(F.lit(m).alias("model"), shown(t).alias("inference")) for m, t in readings.items()]
    documents = labelled.select(
        F.explode(F.array(*outputs)).alias("_o"),
        image_of("doc_", "doc_id").alias("image_name"),
        F.replace("source", F.lit("src"), F.lit("batch-")).alias("batch_id"),
        "quality",
    )
    kept = (F.col("_o.model") != "double") | F.coalesce(F.col("quality") != 0, F.lit(True))
    items = read(spark, sf_dir, "benchmark").select(
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"),
        image_of("item_", "item_id").alias("image_name"),
        F.lit("batch-extra").alias("batch_id"),
        F.col("text").alias("inference"),
    )
    return (
        documents.where(kept)
        .select("_o.model", "image_name", "batch_id", "_o.inference")
        .unionByName(items)
    )


# model, image_name, batch_id, distance, ref_len, inf_len, cer
SCORES_SQL = """
labelled AS (
  SELECT 'doc_' || d.doc_id || '.png' AS image_name, replace(d.source, 'src', 'batch-') AS batch_id, d.text,
         coalesce(l.toxic = 1, false) AS hidden, coalesce(l.quality = 0, false) AS low
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
counted AS (
  SELECT *, length(text) AS n,
         length(text) - length(regexp_replace(text, '[aou]', '', 'g')) AS n_swap,
         length(text) - length(regexp_replace(text, '[ei]', '', 'g')) AS n_drop,
         length(text) - length(replace(text, 't', '')) AS n_double
  FROM labelled
),
doc_scores AS (
  SELECT 'exact' AS model, image_name, batch_id, hidden, 0 AS edits, n, n AS inf_len FROM counted
  UNION ALL SELECT 'swap', image_name, batch_id, hidden, n_swap, n, n FROM counted
  UNION ALL SELECT 'drop_v2.5', image_name, batch_id, hidden, n_drop, n, n - n_drop FROM counted
  UNION ALL SELECT 'double', image_name, batch_id, hidden, n_double, n, n + n_double FROM counted WHERE NOT low
),
item_scores AS (
  SELECT m.model, 'item_' || b.item_id || '.png' AS image_name, 'batch-extra' AS batch_id, length(b.text) AS n
  FROM benchmark b, (VALUES ('exact'), ('swap'), ('drop_v2.5'), ('double')) m(model)
),
measured AS (
  SELECT model, image_name, batch_id, CASE WHEN hidden THEN n ELSE edits END AS distance, n AS ref_len,
         CASE WHEN hidden THEN 0 ELSE inf_len END AS inf_len
  FROM doc_scores
  UNION ALL SELECT model, image_name, batch_id, n, 0, n FROM item_scores
),
scores AS (
  SELECT model, image_name, batch_id, CAST(distance AS INTEGER) AS distance, CAST(ref_len AS INTEGER) AS ref_len,
         CAST(inf_len AS INTEGER) AS inf_len,
         CASE WHEN ref_len = 0 THEN CASE WHEN inf_len = 0 THEN 0.0 ELSE 1.0 END
              ELSE CAST(distance AS DOUBLE) / ref_len END::DOUBLE AS cer
  FROM measured
)
"""


def _digit(place: int):
    """A hexadecimal digit of a hash of the document's id, the same in SQL."""
    return F.substring(F.md5(F.col("doc_id").cast("string")), place, 1)


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw catalog sheets: one per language, untidy headers, different columns, padding rows."""
    docs = read(spark, sf_dir, "documents")
    script = F.when(_digit(1) >= "4", F.col("source"))
    image = image_of("doc_", "doc_id")

    def sheet(lang: str, columns: dict) -> DataFrame:
        return docs.where(F.col("lang") == lang).select(*[c.alias(n) for n, c in columns.items()])

    padding = read(spark, sf_dir, "nation").select(
        F.lit("  ").alias("File Name"), F.lit(None).cast("string").alias(" Script ID "), F.col("n_name").alias("Note")
    )
    english = sheet(
        "en",
        {
            "File Name": F.concat(F.lit(" "), image, F.lit(" ")),
            " Script ID ": F.concat(script, F.lit(" ")),
            "Note": F.concat(F.lit("n"), F.col("n_chars").cast("string")),
            "Unnamed: 3": F.lit("x"),
            "Legibility": F.when(_digit(2) < "8", F.lit("good")),
        },
    ).unionByName(padding, allowMissingColumns=True)
    return {
        "en": english,
        "de": sheet(
            "de",
            {"file name": image, "script id": script, "notes": F.lit(None).cast("string"), "Exact Font": F.upper("source")},
        ),
        "es": sheet("es", {"FILE NAME": image, "Script ID": script, "Color": F.lit("bw"), "Period": F.lit("  ")}),
        "fr": sheet(
            "fr",
            {"File name": image, "Script id": script, "3_types": F.when(_digit(3) < "8", F.lit("display"))},
        ),
    }


CATALOG_SQL = """
doc AS (
  SELECT 'doc_' || doc_id || '.png' AS image, lang, n_chars, source, md5(doc_id::VARCHAR) AS hash,
         CASE WHEN substr(hash, 1, 1) >= '4' THEN source END AS script
  FROM documents
),
raw_catalog AS (
  SELECT lang AS technology, CASE WHEN lang = 'en' THEN ' ' || image || ' ' ELSE image END AS file_name,
         CASE WHEN lang = 'en' THEN script || ' ' ELSE script END AS script_id,
         CASE WHEN lang = 'en' THEN 'n' || n_chars END AS notes,
         CASE WHEN lang = 'en' AND substr(hash, 2, 1) < '8' THEN 'good' END AS legibility,
         CASE WHEN lang = 'de' THEN upper(source) END AS exact_font,
         CASE WHEN lang = 'es' THEN 'bw' END AS color,
         CASE WHEN lang = 'es' THEN '  ' END AS period,
         CASE WHEN lang = 'fr' AND substr(hash, 3, 1) < '8' THEN 'display' END AS "3_types"
  FROM doc WHERE lang IN ('en', 'de', 'es', 'fr')
)
"""


def script_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw script sheets; the regions overlap in ASIA, so scripts must win over multi-scripts."""
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    code = F.concat(F.lit("src"), F.col("n_nationkey").cast("string"))
    scripts = nations.where(F.col("r_name").isin("AFRICA", "AMERICA", "ASIA")).select(
        F.concat(F.lit(" "), code).alias("ID"),
        F.col("n_name").alias("Name (phonetics, wylie in parentheses, and english)"),
        F.col("r_name").alias("3 Types"),
        F.concat(F.lit("popular "), F.substring("n_name", 1, 1)).alias("Popularity on web"),
    )
    multi = nations.where(F.col("r_name").isin("ASIA", "EUROPE", "MIDDLE EAST")).select(
        code.alias("IDs"),
        F.lower("n_name").alias("Names (phonetics)"),
        F.col("r_name").alias("8 cat. combination"),
        F.concat(F.lit("many "), F.substring("n_name", 1, 1)).alias("Popularity on web"),
    )
    return scripts, multi


SCRIPTS_SQL = """
nations AS (
  SELECT 'src' || n_nationkey AS script_id, n_name, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
scripts AS (
  SELECT script_id, n_name AS script_name, r_name AS "3_types", 'popular ' || substr(n_name, 1, 1) AS popularity_on_web
  FROM nations WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')
),
multi AS (
  SELECT script_id, lower(n_name) AS script_name, r_name AS "8_cat_combination",
         'many ' || substr(n_name, 1, 1) AS popularity_on_web
  FROM nations WHERE r_name IN ('ASIA', 'EUROPE', 'MIDDLE EAST')
),
consolidated AS (
  SELECT c.technology, c.file_name, trim(c.script_id) AS script_id, c.notes, c.legibility, c.exact_font, c.color, c.period,
         coalesce(c."3_types", s."3_types") AS "3_types", coalesce(s.script_name, m.script_name) AS script_name,
         coalesce(s.popularity_on_web, m.popularity_on_web) AS popularity_on_web, m."8_cat_combination"
  FROM raw_catalog c
  LEFT JOIN scripts s ON trim(c.script_id) = s.script_id
  LEFT JOIN multi m ON trim(c.script_id) = m.script_id
)
"""


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows: the labelled documents, and the items that no catalog lists."""
    labelled = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(
        F.concat(image_of("doc_", "doc_id"), F.lit(" ")).alias("image_name"),
        F.replace("source", F.lit("src"), F.lit("batch-")).alias("batch_id"),
        F.col("text").alias("transcript"),
    )
    items = read(spark, sf_dir, "benchmark").select(
        image_of("item_", "item_id").alias("image_name"), F.lit("batch-extra").alias("batch_id"), F.col("text").alias("transcript")
    )
    return labelled.unionByName(items)


BENCHMARK_SQL = """
bench AS (
  SELECT 'doc_' || l.doc_id || '.png' AS image_name, replace(d.source, 'src', 'batch-') AS batch_id, d.text AS transcript
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL SELECT 'item_' || item_id || '.png', 'batch-extra', text FROM benchmark
)
"""
