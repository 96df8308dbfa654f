"""Trees of real files: images, transcripts and stored responses laid down from the given tables, then listed and read."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from registry import tables as t
from registry.files import _folder
from txmetrics.functions import structured_text as page_text
from txmetrics.functions import vision_text as full_text
from txmetrics.plans import batch_stats, lay_out
from txmetrics.sources.files import (
    image_bytes,
    image_listing,
    images_of,
    plain_cache,
    structured_cache,
    transcript_files,
    vision_cache,
)
from txmetrics.sources.storage import list_tree, refresh_manifest, write_files

#: Every sixteenth file is empty, by a hash of its id.
EMPTY_SQL = "substr(md5(doc_id::VARCHAR), 1, 1) = '0'"
ENDINGS = (".png", ".tif", ".HEIC", ".bin")
ENDING_SQL = "(['.png', '.tif', '.HEIC', '.bin'])[1 + doc_id % 4]"


def _digit(place=1):
    return F.substring(F.md5(F.col("doc_id").cast("string")), place, 1)


def _documents(spark, sf_dir):
    """Documents with their batch, file stem, and what their files hold."""
    docs = t.read(spark, sf_dir, "documents")
    text = F.when(_digit() == "0", F.lit("")).otherwise(F.col("text"))
    return docs.select(
        "doc_id",
        F.replace("source", F.lit("src"), F.lit("batch-")).alias("batch_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"),
        F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("ending"),
        text.alias("text"),
    )


def _lay_images(docs, root):
    """Image files two levels down, and others at the root and deeper that are none."""
    name = F.concat("stem", "ending")
    inside = F.concat(F.lit(f"{root}/images/"), "batch_id", F.lit("/"), name)
    deeper = F.when(_digit(2) == "0", F.concat(F.lit(f"{root}/images/"), "batch_id", F.lit("/deeper/"), name))
    stray = F.when(_digit(3) == "0", F.concat(F.lit(f"{root}/images/"), name))
    rows = docs.select(F.explode(F.array(inside, deeper, stray)).alias("path"), F.encode("text", "UTF-8").alias("content"))
    write_files(rows)
    return root


_IMAGE = ["batch_id", "image_name", "stem", "suffix", "mime_type", "length"]


def images_in_tree(spark, sf_dir):
    """Images of a tree, listed by one task for each batch."""
    root = _lay_images(_documents(spark, sf_dir), _folder(spark, "tree"))
    return images_of(list_tree(spark, f"{root}/images")).select(*_IMAGE)


def images_scanned(spark, sf_dir):
    """The same by `image_listing`: Spark's own file source, or tasks where the tree is too large for its index in the driver."""
    root = _lay_images(_documents(spark, sf_dir), _folder(spark, "tree"))
    return image_listing(spark, root).select(*_IMAGE)


def images_refreshed(spark, sf_dir):
    """A stored manifest after the tree has grown: some batches are new, some have more files."""
    docs, root = _documents(spark, sf_dir), _folder(spark, "tree")
    first = (_digit(4) < "8") & (F.col("batch_id") < "batch-5")
    _lay_images(docs.where(first), root)
    refresh_manifest(spark, f"{root}/images", f"{root}/manifest")
    _lay_images(docs.where(~first), root)
    return images_of(refresh_manifest(spark, f"{root}/images", f"{root}/manifest")).select(*_IMAGE)


def tree_stats(spark, sf_dir):
    """Images for each batch of a tree, and all."""
    root = _lay_images(_documents(spark, sf_dir), _folder(spark, "tree"))
    return batch_stats(images_of(list_tree(spark, f"{root}/images")))


def image_contents(spark, sf_dir):
    """Bytes of the images of a manifest, read by the tasks that use them."""
    root = _lay_images(_documents(spark, sf_dir), _folder(spark, "tree"))
    found = image_bytes(spark, root, "language", manifest=list_tree(spark, f"{root}/images"))
    return found.select("batch_id", "image_name", "native", F.sha2("content", 256).alias("sha256"))


def _transcripts(spark, sf_dir):
    root = _folder(spark, "tree")
    path = F.concat(F.lit(f"{root}/transcripts/"), "batch_id", F.lit("/"), "stem", F.lit(".txt"))
    other = F.concat(F.lit(f"{root}/transcripts/"), "batch_id", F.lit("/"), "stem", F.lit(".md"))
    docs = _documents(spark, sf_dir)
    write_files(docs.select(F.explode(F.array(path, other)).alias("path"), F.encode("text", "UTF-8").alias("content")))
    return root


def transcripts_in_tree(spark, sf_dir):
    root = _transcripts(spark, sf_dir)
    return transcript_files(spark, root, manifest=list_tree(spark, f"{root}/transcripts", ".txt"))


def transcripts_scanned(spark, sf_dir):
    return transcript_files(spark, _transcripts(spark, sf_dir))


def _responses(spark, sf_dir, folder, ending, response):
    path = F.concat(F.lit(f"{folder}/"), "batch_id", F.lit("/"), "stem", F.lit(ending))
    return _documents(spark, sf_dir).select(path.alias("path"), F.encode(response, "UTF-8").alias("content"))


def _read_back(cache, text):
    return cache.select("model", "batch_id", "stem", "kind", text.alias("text"))


def plain_cache_in_tree(spark, sf_dir):
    """Plain responses as files, taken verbatim, empty ones too."""
    root = _folder(spark, "plain")
    write_files(_responses(spark, sf_dir, f"{root}/m.1", ".txt", F.concat(F.lit(" "), "text", F.lit("\n"))))
    return _read_back(plain_cache(spark, root, "m.1", manifest=list_tree(spark, f"{root}/m.1", ".txt")), F.col("raw"))


def structured_cache_in_tree(spark, sf_dir):
    """Structured responses as files."""
    root = _folder(spark, "structured")
    line = F.struct(
        F.col("text").alias("raw_transcription"), F.lit("").alias("normalized_text"), F.lit(1.0).alias("confidence_score"),
        F.lit("horizontal").alias("orientation"), F.array(F.lit(0)).alias("bounding_box"),
    )
    page = F.to_json(F.struct(F.array(line, line).alias("lines")))
    write_files(_responses(spark, sf_dir, f"{root}/m.1", ".json", page))
    return _read_back(structured_cache(spark, root, "m.1", manifest=list_tree(spark, f"{root}/m.1", ".json")), page_text(F.col("raw")))


def _packed(batches):
    for batch in batches:
        content = [gzip.compress(c, 1, mtime=0) for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["path", "content"])


def vision_cache_in_tree(spark, sf_dir):
    """Vision responses as packed files."""
    root = _folder(spark, "vision")
    response = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), "text").alias("text")).alias("fullTextAnnotation")))
    rows = _responses(spark, sf_dir, root, ".json.gz", response)
    write_files(rows.mapInArrow(_packed, rows.schema))
    return _read_back(vision_cache(spark, root, "v"), full_text(F.col("raw")))


def benchmark_from_tree(spark, sf_dir):
    """Annotated images laid out by batch, their bytes read from the files by the tasks that write them."""
    docs, root = _documents(spark, sf_dir), _folder(spark, "tree")
    _lay_images(docs, root)
    tasks = docs.select(F.concat("stem", "ending").alias("task_name"), "batch_id", F.col("text").alias("task_transcript"))
    path = lay_out(tasks, images_of(list_tree(spark, f"{root}/images")), f"{root}/benchmark", target_bytes=1 << 20)
    written = spark.read.schema("image_name STRING, transcript STRING, content BINARY, batch_id STRING").parquet(path)
    return written.select(
        "image_name", "batch_id", F.length("transcript").alias("chars"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        images_in_tree, images_scanned, images_refreshed, tree_stats, image_contents, transcripts_in_tree, transcripts_scanned,
        plain_cache_in_tree, structured_cache_in_tree, vision_cache_in_tree, benchmark_from_tree,
    )
}

_DOC = f"""doc AS (
  SELECT {t.BATCH_SQL} AS batch_id, 'doc_' || doc_id AS stem, {ENDING_SQL} AS ending, CASE WHEN {EMPTY_SQL} THEN '' ELSE text END AS text
  FROM documents
)"""
_IMAGES = f"""WITH {_DOC} SELECT batch_id, stem || ending AS image_name, stem, lower(ending) AS suffix,
  CASE ending WHEN '.png' THEN 'image/png' WHEN '.tif' THEN 'image/tiff' WHEN '.HEIC' THEN 'image/heic' ELSE 'application/octet-stream' END AS mime_type,
  strlen(text)::BIGINT AS length FROM doc"""
_TEXTS = f"WITH {_DOC} SELECT batch_id, stem, text AS transcript FROM doc"
_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

ORACLE = {
    "images_in_tree": _IMAGES,
    "images_scanned": _IMAGES,
    "images_refreshed": _IMAGES,
    "tree_stats": f"SELECT {t.BATCH_SQL} AS batch_id, CAST(grouping({t.BATCH_SQL}) AS INTEGER) AS is_total, count(*) AS count"
    f" FROM documents GROUP BY ROLLUP ({t.BATCH_SQL})",
    "image_contents": f"WITH {_DOC} SELECT batch_id, stem || ending AS image_name, ending IN ('.png', '.HEIC') AS native, sha256(text) AS sha256 FROM doc",
    "transcripts_in_tree": _TEXTS,
    "transcripts_scanned": _TEXTS,
    "plain_cache_in_tree": f"WITH {_DOC} SELECT 'm.1' AS model, batch_id, stem, 'plain' AS kind, ' ' || text || chr(10) AS text FROM doc",
    "structured_cache_in_tree": f"WITH {_DOC} SELECT 'm.1' AS model, batch_id, stem, 'structured' AS kind, text || chr(10) || text AS text FROM doc",
    "vision_cache_in_tree": f"WITH {_DOC} SELECT 'v' AS model, batch_id, stem, 'vision' AS kind, {_STRIPPED} AS text FROM doc",
    "benchmark_from_tree": f"WITH {_DOC} SELECT stem || ending AS image_name, batch_id, CAST(length(text) AS INTEGER) AS chars,"
    " CAST(strlen(text) AS INTEGER) AS bytes, sha256(text) AS sha256 FROM doc",
}
