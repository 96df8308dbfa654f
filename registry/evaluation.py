"""Scoring, averages and text normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from registry import tables as t
from txmetrics.functions import collapse_whitespace, distinct_values, round6, to_number, unicode_normalise
from txmetrics.functions.text import file_name, is_native, mime_type, stem, suffix
from txmetrics.operators import by_batch, grouped_scores, last_wins, micro_average, model_summary, overall
from txmetrics.plans import canonical_batch, score, score_map


def scored(spark, sf_dir, **options):
    """Scores of all models; a document is one image, so the keys of the truth are unique."""
    return score(t.inference(spark, sf_dir), t.truth(spark, sf_dir), truth_order=None, **options)


def cer_per_image(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("cer", round6(F.col("cer")))


def cer_by_batch(spark, sf_dir):
    return by_batch(scored(spark, sf_dir))


def cer_overall(spark, sf_dir):
    return overall(scored(spark, sf_dir), t.MODELS + ["never_ran"])


def cer_grouping_sets(spark, sf_dir):
    return grouped_scores(scored(spark, sf_dir))


def cer_model_summary(spark, sf_dir):
    batches = distinct_values(t.inference(spark, sf_dir), "batch_id")
    return model_summary(scored(spark, sf_dir), batches)


def cer_micro(spark, sf_dir):
    return micro_average(scored(spark, sf_dir), ("model", "batch_id"))


def cer_result_map(spark, sf_dir):
    nested = score_map(scored(spark, sf_dir))
    return nested.select("model", "overall_cer", F.explode("per_batch").alias("batch_id", "_v")).select(
        "model", "overall_cer", "batch_id", F.col("_v.cer").alias("cer"), F.col("_v.count").alias("count")
    )


def _turns(spark, sf_dir):
    """Every turn of a conversation as truth, the turn before it as what a model made of it."""
    turns = t.read(spark, sf_dir, "conversations")
    name = F.concat_ws("_", F.lit("conv"), F.col("conv_id"), F.col("turn"))
    truth = turns.select(name.alias("image_name"), F.col("role").alias("batch_id"), F.col("text").alias("transcript"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("inference"))
    heard = turns.select("conv_id", "turn", "role").join(before, ["conv_id", "turn"])
    outputs = heard.select(
        F.lit("echo").alias("model"), name.alias("image_name"), F.col("role").alias("batch_id"), "inference"
    )
    return outputs, truth


def cer_turns(spark, sf_dir):
    return score(*_turns(spark, sf_dir), truth_order=None).withColumn("cer", round6(F.col("cer")))


def cer_turns_whitespace(spark, sf_dir):
    return score(*_turns(spark, sf_dir), whitespace=True, truth_order=None).withColumn("cer", round6(F.col("cer")))


def cer_unicode_form(spark, sf_dir):
    """Decomposed model output against composed truth: equal once both are in NFC."""
    truth = t.truth(spark, sf_dir)
    outputs = truth.select(
        F.lit("decomposed").alias("model"), "image_name", "batch_id", unicode_normalise(F.col("transcript"), "NFD").alias("inference")
    )
    return score(outputs, truth, unicode_form="NFC", truth_order=None)


def normalise_whitespace(spark, sf_dir):
    docs = t.read(spark, sf_dir, "documents")
    return docs.select("doc_id", collapse_whitespace(F.col("text")).alias("text"))


def normalise_nfc(spark, sf_dir):
    docs = t.read(spark, sf_dir, "documents")
    return docs.select("doc_id", unicode_normalise(F.col("text"), "NFC").alias("text"))


def _decomposed(spark, sf_dir, form):
    """Base characters and length of the decomposed text."""
    text = unicode_normalise(F.col("text"), form)
    return t.read(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace(text, r"\p{M}", "").alias("base"), F.length(text).alias("length")
    )


def normalise_nfd(spark, sf_dir):
    return _decomposed(spark, sf_dir, "NFD")


def normalise_nfkd(spark, sf_dir):
    return _decomposed(spark, sf_dir, "NFKD")


def normalise_nfkc(spark, sf_dir):
    docs = t.read(spark, sf_dir, "documents")
    return docs.select("doc_id", unicode_normalise(F.col("text"), "NFKC").alias("text"))


def truth_last_wins(spark, sf_dir):
    turns = t.read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("image_name"),
        F.col("role").alias("batch_id"),
        F.col("text").alias("transcript"),
        "turn",
    )
    return last_wins(turns, ["image_name", "batch_id"], "turn").drop("turn")


def numeric_coerce(spark, sf_dir):
    events = t.read(spark, sf_dir, "events")
    cell = F.concat(F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "error", F.lit("d")).otherwise(F.lit("")))
    return events.select("event_id", to_number(cell).alias("number"))


def batch_canonical(spark, sf_dir):
    docs = t.read(spark, sf_dir, "documents")
    raw = (
        F.when(F.col("source") == "src1", F.lit("b1"))
        .when(F.col("source") == "src5", F.lit("batch-05"))
        .otherwise(F.replace("source", F.lit("src"), F.lit("batch-")))
    )
    return docs.groupBy(canonical_batch(raw).alias("batch_id")).agg(F.count("*").alias("count"))


def image_types(spark, sf_dir):
    events = t.read(spark, sf_dir, "events")
    kinds = {"click": ".JPG", "view": ".a.tif", "error": ".xyz"}
    ending = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit(""))
    path = F.concat(F.lit("images/batch-1/page_"), F.col("event_id").cast("string"), ending)
    name = file_name(path)
    return events.select(
        "event_id", stem(name).alias("stem"), suffix(name).alias("suffix"), mime_type(name).alias("mime_type"),
        is_native(name, "vision").alias("vision_native"), is_native(name, "language").alias("language_native"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        cer_per_image, cer_by_batch, cer_overall, cer_grouping_sets, cer_model_summary, cer_micro, cer_result_map,
        cer_turns, cer_turns_whitespace, cer_unicode_form, normalise_whitespace, normalise_nfc, normalise_nfd,
        normalise_nfkc, normalise_nfkd, truth_last_wins, numeric_coerce, batch_canonical, image_types,
    )
}

WS = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"



# levenshtein() counts bytes here, so every longer character is first given a byte of its own.
_WIDE = "ÄÖÜßäöüÇÈÉÊçèéêÍÑÓíñó"
_BYTES = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 14 + len(_WIDE) - 8)])


def _turns_sql(clean: Callable[[str], str]) -> str:
    return f"""
WITH pairs AS (
  SELECT b.conv_id, b.turn, b.role, {clean('a.text')} AS inf, {clean('b.text')} AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
),
measured AS (
  SELECT *, levenshtein(translate(inf, '{_WIDE}', {_BYTES}), translate(ref, '{_WIDE}', {_BYTES})) AS d FROM pairs
)
SELECT 'echo' AS model, 'conv_' || conv_id || '_' || turn AS image_name, role AS batch_id, CAST(d AS INTEGER) AS distance,
       CAST(length(ref) AS INTEGER) AS ref_len, CAST(length(inf) AS INTEGER) AS inf_len,
       round_even(CASE WHEN length(ref) = 0 THEN CASE WHEN length(inf) = 0 THEN 0.0 ELSE 1.0 END
                       ELSE CAST(d AS DOUBLE) / length(ref) END, 6) AS cer
FROM measured"""


_DECOMPOSED = (
    "SELECT doc_id, strip_accents(text) AS base, CAST(2 * length(text) - length(regexp_replace(text,"
    f" '[{_WIDE.replace('ß', '')}]', '', 'g')) AS INTEGER) AS length FROM documents"
)

_S = f"WITH {t.SCORES_SQL} "
_BATCHES = [f"batch-{i}" for i in range(20)] + ["batch-extra"]

ORACLE = {
    "cer_per_image": _S
    + "SELECT model, image_name, batch_id, distance, ref_len, inf_len, round_even(cer, 6) AS cer FROM scores",
    "cer_by_batch": _S
    + "SELECT model, batch_id, round_even(avg(cer), 6) AS cer, count(*) AS count FROM scores GROUP BY model, batch_id",
    "cer_overall": _S
    + "SELECT m.model, round_even(coalesce(avg(cer), 0), 6) AS overall_cer, count(s.model) AS count"
    " FROM (VALUES ('exact'), ('swap'), ('drop_v2.5'), ('double'), ('never_ran')) m(model)"
    " LEFT JOIN scores s ON m.model = s.model GROUP BY m.model",
    "cer_grouping_sets": _S
    + "SELECT model, batch_id, CAST(grouping(batch_id) AS INTEGER) AS is_overall, round_even(avg(cer), 6) AS cer,"
    " count(*) AS count FROM scores GROUP BY GROUPING SETS ((model, batch_id), (model))",
    "cer_model_summary": _S
    + "SELECT model, round_even(avg(cer), 6) AS overall_cer, "
    + ", ".join(f"round_even(avg(cer) FILTER (batch_id = '{b}'), 6) AS \"cer_{b}\"" for b in _BATCHES)
    + " FROM scores GROUP BY model",
    "cer_micro": _S
    + "SELECT model, batch_id, CAST(sum(distance) AS BIGINT) AS distance, CAST(sum(ref_len) AS BIGINT) AS ref_len,"
    " round_even(sum(distance) / CAST(nullif(sum(ref_len), 0) AS DOUBLE), 6) AS micro_cer FROM scores GROUP BY model, batch_id",
    "cer_result_map": _S
    + ", totals AS (SELECT model, round_even(avg(cer), 6) AS overall_cer FROM scores GROUP BY model)"
    " SELECT s.model, t.overall_cer, s.batch_id, round_even(avg(s.cer), 6) AS cer, count(*) AS count"
    " FROM scores s JOIN totals t ON s.model = t.model GROUP BY s.model, t.overall_cer, s.batch_id",
    "cer_turns": _turns_sql(str),
    "cer_turns_whitespace": _turns_sql(_squeeze),
    "cer_unicode_form": "SELECT 'decomposed' AS model, 'doc_' || doc_id || '.png' AS image_name,"
    " replace(source, 'src', 'batch-') AS batch_id, CAST(0 AS INTEGER) AS distance,"
    " CAST(length(nfc_normalize(text)) AS INTEGER) AS ref_len, CAST(length(nfc_normalize(text)) AS INTEGER) AS inf_len,"
    " CAST(0 AS DOUBLE) AS cer FROM documents",
    "normalise_whitespace": f"SELECT doc_id, {_squeeze('text')} AS text FROM documents",
    "normalise_nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    # The documents hold accented letters but no compatibility characters, so both compositions
    # agree, and an accented letter is two code points when decomposed.
    "normalise_nfkc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "normalise_nfd": _DECOMPOSED,
    "normalise_nfkd": _DECOMPOSED,
    "truth_last_wins": "SELECT 'conv_' || conv_id AS image_name, role AS batch_id, arg_max(text, turn) AS transcript"
    " FROM conversations GROUP BY conv_id, role",
    "numeric_coerce": "SELECT event_id, CASE WHEN event_type <> 'error' THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END AS number"
    " FROM events",
    "batch_canonical": f"SELECT {t.BATCH_SQL} AS batch_id, count(*) AS count FROM documents GROUP BY 1",
    "image_types": """
SELECT event_id, 'page_' || event_id || CASE WHEN event_type = 'view' THEN '.a' ELSE '' END AS stem,
       CASE event_type WHEN 'click' THEN '.jpg' WHEN 'view' THEN '.tif' WHEN 'error' THEN '.xyz' ELSE '' END AS suffix,
       CASE event_type WHEN 'click' THEN 'image/jpeg' WHEN 'view' THEN 'image/tiff' ELSE 'application/octet-stream' END AS mime_type,
       event_type IN ('click', 'view') AS vision_native, event_type = 'click' AS language_native
FROM events""",
}
