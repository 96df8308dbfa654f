"""Stored responses and resumable inference."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from registry import tables as t
from txmetrics.functions import explode_lines, structured_text as page_text, vision_text as full_text
from txmetrics.plans import Provider, batch_infer, plan_work, split_cached

def digit(*key):
    """A hexadecimal digit that depends on a key only, the same in Spark and in SQL."""
    return F.substring(F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key])), 1, 1)


def vision_text(spark, sf_dir):
    turns = t.read(spark, sf_dir, "conversations")
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit(" \n"))
    full = F.to_json(F.struct(F.struct(padded.alias("text")).alias("fullTextAnnotation")))
    other = F.to_json(F.struct(F.array(padded).alias("responses")))
    response = F.when(F.col("role") == "assistant", full).otherwise(other)
    return turns.select("conv_id", "turn", full_text(response).alias("text"))


def _pages(spark, sf_dir):
    """A structured response per turn, one line per text line; some are broken in different ways."""
    turns = t.read(spark, sf_dir, "conversations")
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            line.alias("raw_transcription"),
            F.upper(line).alias("normalized_text"),
            (F.lit(1.0) / (i + 1)).alias("confidence_score"),
            F.lit("horizontal").alias("orientation"),
            F.array(i, F.lit(0), i + 1, F.lit(1000)).alias("bounding_box"),
        ),
    )
    page = F.to_json(F.struct(lines.alias("lines")))
    raw = F.col("text").alias("raw_transcription")
    incomplete = F.to_json(F.struct(F.array(F.struct(raw, F.lit(0.5).alias("confidence_score"))).alias("lines")))
    too_sure = F.struct(
        raw,
        F.col("text").alias("normalized_text"),
        F.lit(2).alias("confidence_score"),
        F.lit("horizontal").alias("orientation"),
        F.array(*map(F.lit, (0, 0, 1, 1))).alias("bounding_box"),
    )
    out_of_range = F.to_json(F.struct(F.array(too_sure).alias("lines")))
    first = (F.col("role") == "user") & (F.col("turn") == 0)
    response = (
        F.when(first & (digit("conv_id") < "8"), incomplete)
        .when(first, out_of_range)
        .when(digit("conv_id", "turn") < "4", F.col("text"))
        .otherwise(page)
    )
    return turns.select("conv_id", "turn", response.alias("response"))


def structured_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("conv_id", "turn", page_text(F.col("response")).alias("text"))


def structured_lines(spark, sf_dir):
    return explode_lines(_pages(spark, sf_dir)).select(
        "conv_id", "turn", "line_no", "raw_transcription", F.bround("confidence_score", 6).alias("confidence_score"),
        "orientation", F.array_join("bounding_box", ",").alias("bounding_box"),
    )


def line_quality(spark, sf_dir):
    """Lines and characters by band of confidence."""
    lines = structured_lines(spark, sf_dir)
    band = F.floor(F.col("confidence_score") * 10).cast("int")
    return lines.groupBy(band.alias("band")).agg(
        F.count("*").alias("lines"), F.sum(F.length("raw_transcription")).alias("chars")
    )


def _plain(image, settings, state):
    if len(image["content"]) < int(settings["least"]):
        raise ValueError("too little text")
    return image["content"].replace(settings["old"], state)


def _vision(image, settings, state):
    text = image["content"].replace("e", "3")
    return text, json.dumps({"fullTextAnnotation": {"text": text}}, ensure_ascii=False)


def _no_start(settings):
    raise RuntimeError("weights not found")


PROVIDERS = {
    "plain": Provider(_plain, init=lambda settings: settings["new"]),
    "vision": Provider(_vision, kind="vision"),
    "broken": Provider(_plain, init=_no_start),
}
MODELS = {
    "plain_v1.0": {"provider": "plain", "old": "a", "new": "4", "least": "150"},
    "seeing": {"provider": "vision"},
    "no_weights": {"provider": "broken"},
    "nobody": {"provider": "unheard of"},
}


def _images(spark, sf_dir):
    return t.truth(spark, sf_dir).withColumnRenamed("transcript", "content")


def _cache(spark, sf_dir):
    """Stored responses: good images for the plain model, toxic ones for the vision model."""
    docs = t.read(spark, sf_dir, "labels").join(t.read(spark, sf_dir, "documents"), "doc_id")
    keys = [
        F.replace("source", F.lit("src"), F.lit("batch-")).alias("batch_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"),
    ]
    plain = docs.where("quality = 1").select(
        F.lit("plain_v1.0").alias("model"), *keys, F.lit("plain").alias("kind"), F.col("lang").alias("raw")
    )
    raw = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.col("text")).alias("text")).alias("fullTextAnnotation")))
    vision = docs.where("toxic = 1").select(F.lit("seeing").alias("model"), *keys, F.lit("vision").alias("kind"), raw.alias("raw"))
    return plain.unionByName(vision)


def pending_images(spark, sf_dir):
    work, _ = plan_work(_images(spark, sf_dir).drop("content"), MODELS, PROVIDERS)
    _, pending = split_cached(work, _cache(spark, sf_dir))
    return pending.select("model", "image_name", "batch_id", "kind")


def cached_images(spark, sf_dir):
    work, _ = plan_work(_images(spark, sf_dir).drop("content"), MODELS, PROVIDERS)
    done, _ = split_cached(work, _cache(spark, sf_dir))
    return done.select("model", "image_name", "text")


def resumable_infer(spark, sf_dir):
    return batch_infer(_images(spark, sf_dir), MODELS, PROVIDERS, _cache(spark, sf_dir)).outputs


def inference_cache_rows(spark, sf_dir):
    rows = batch_infer(_images(spark, sf_dir), MODELS, PROVIDERS, _cache(spark, sf_dir)).cache_rows
    text = F.when(F.col("kind") == "vision", F.get_json_object("raw", "$.fullTextAnnotation.text")).otherwise(F.col("raw"))
    return rows.select("model", "batch_id", "stem", "kind", text.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        vision_text, structured_text, structured_lines, line_quality, pending_images, cached_images, resumable_infer,
        inference_cache_rows,
    )
}

_FIRST = "role = 'user' AND turn = 0"
_VALID = f"NOT ({_FIRST}) AND substr(md5(conv_id || '-' || turn), 1, 1) >= '4'"
_LINES = f"""
numbered AS (
  SELECT conv_id, turn, string_split(text, chr(10)) AS parts, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM conversations WHERE {_VALID}
),
lines AS (
  SELECT conv_id, turn, CAST(i AS INTEGER) AS line_no, parts[i + 1] AS raw_transcription,
         round_even(1.0::DOUBLE / (i + 1), 6) AS confidence_score, 'horizontal' AS orientation,
         i || ',0,' || (i + 1) || ',1000' AS bounding_box
  FROM numbered
)"""
_WORK = """
img AS (
  SELECT d.doc_id, 'doc_' || d.doc_id || '.png' AS image_name, replace(d.source, 'src', 'batch-') AS batch_id, d.text, d.lang,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
work AS (
  SELECT m.model, m.kind, img.*,
         (m.model = 'plain_v1.0' AND good) OR (m.model = 'seeing' AND toxic) AS cached
  FROM img, (VALUES ('plain_v1.0', 'plain'), ('seeing', 'vision'), ('no_weights', 'plain')) m(model, kind)
)"""

_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

ORACLE = {
    "vision_text": f"SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {_STRIPPED.format('text')} ELSE '' END AS text FROM conversations",
    "structured_text": f"""
SELECT conv_id, turn, CASE WHEN NOT ({_FIRST}) THEN text
  WHEN substr(md5(conv_id::VARCHAR), 1, 1) < '8' THEN '{{"lines":[{{"raw_transcription":' || to_json(text) || ',"confidence_score":0.5}}]}}'
  ELSE '{{"lines":[{{"raw_transcription":' || to_json(text) || ',"normalized_text":' || to_json(text)
    || ',"confidence_score":2,"orientation":"horizontal","bounding_box":[0,0,1,1]}}]}}' END AS text FROM conversations""",
    "structured_lines": f"WITH {_LINES} SELECT * FROM lines",
    "line_quality": f"WITH {_LINES} SELECT CAST(floor(confidence_score * 10) AS INTEGER) AS band, count(*) AS lines,"
    " CAST(sum(length(raw_transcription)) AS BIGINT) AS chars FROM lines GROUP BY 1",
    "pending_images": f"WITH {_WORK} SELECT model, image_name, batch_id, kind FROM work WHERE NOT cached",
    "cached_images": f"WITH {_WORK} SELECT model, image_name, CASE WHEN kind = 'plain' THEN lang ELSE {_STRIPPED.format('text')} END AS text"
    " FROM work WHERE cached",
    "resumable_infer": f"""WITH {_WORK}
SELECT model, image_name, batch_id,
       CASE WHEN cached AND kind = 'plain' THEN lang WHEN cached THEN {_STRIPPED.format('text')}
            WHEN kind = 'plain' THEN CASE WHEN length(text) < 150 THEN '' ELSE {_STRIPPED.format("replace(text, 'a', '4')")} END
            ELSE {_STRIPPED.format("replace(text, 'e', '3')")} END AS inference
FROM work WHERE model <> 'no_weights'""",
    "inference_cache_rows": f"""WITH {_WORK}
SELECT model, batch_id, 'doc_' || doc_id AS stem, kind,
       CASE WHEN kind = 'plain' THEN {_STRIPPED.format("replace(text, 'a', '4')")} ELSE replace(text, 'e', '3') END AS text
FROM work WHERE NOT cached AND model <> 'no_weights' AND (kind = 'vision' OR length(text) >= 150)""",
}
