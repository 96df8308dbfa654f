"""Token counts through a cache of content digests.

The cache is a table of ``tokenizer`` (digest of the tokenizer's file and of the library that runs
it), ``digest`` (of the content as the tokenizer normalises it) and ``n_tokens``. A run joins the
digests of its texts to the cache, encodes each distinct text that is not there once, and appends
the new counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from importlib import metadata

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.llm.frames import STEP_CHARS, map_texts, pick, steps
from txmetrics.sinks.tables import materialise

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Missing digests of 32 bytes up to which they go to every task, so that only their texts are moved.
BROADCAST_DIGESTS = 200_000
#: A place where the byte-level pattern always ends one word and begins the next with the space.
_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Counter:
    """A tokenizer file and the library that runs it: ``.json`` or ``.model``."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            normaliser, before = self.library.normalizer, self.library.pre_tokenizer
            self.raw = [t.content for t in self.library.get_added_tokens_decoder().values() if not t.normalized]
            self.normaliser = normaliser.normalize_str if normaliser else None
            #: Long texts can be encoded in parts if only the byte-level pattern decides where words end.
            self.by_part = normaliser is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
            self.by_part = self.by_part and not any(" " in t for t in self.raw)
            self.count = self._count_json
        elif path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.raw, self.normaliser, self.by_part = [], self.library.normalize, False
            self.count = lambda texts: [len(x) for x in self.library.encode(texts)]
        else:
            raise ValueError(f"{path}: only .json and .model files of tokenizers are known")

    def content(self, text: str) -> bytes:
        """What decides the number of tokens: the normalised text, or the text itself if it holds special strings."""
        if any(t in text for t in self.raw):
            return b"raw\0" + text.encode()
        return b"normal\0" + self.normaliser(text).encode()

    def _count_json(self, texts: list[str]) -> list[int]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            for part in self._parts(text):
                parts.append(part)
                owner.append(k)
        out = [0] * len(texts)
        for lo, hi in steps(parts):
            for k, encoding in zip(owner[lo:hi], self.library.encode_batch_fast(parts[lo:hi], add_special_tokens=False), strict=True):
                out[k] += len(encoding)
        return out

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while self.by_part and len(text) - start > STEP_CHARS and (cut := _CUT.search(text, start + STEP_CHARS)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]


@cache
def _counter(path: str) -> Counter:
    """One tokenizer for all tasks of a Python worker."""
    return Counter(path)


def version(path: str) -> str:
    """Digest of a tokenizer: its file, and name and version of the library."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    digest = hashlib.sha256(f"{library} {metadata.version(library)}\0".encode())
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, none if the cache does not exist yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(f"{cache_path}/tokenizer={tokenizer}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _keyed(texts: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` and ``digest``. Without a normaliser the digest never leaves the JVM."""
    if _counter(path).normaliser is None:
        return texts.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def each(ids, texts, counter: Counter):
        digests = [hashlib.sha256(counter.content(t)).digest() for t in texts]
        return {"doc_id": ids, "text": pa.array(texts, pa.string()), "digest": pa.array(digests, pa.binary())}

    return map_texts(texts, "doc_id, text string, digest binary", each, lambda: _counter(path))


def _encode(texts: DataFrame, path: str) -> DataFrame:
    """``digest`` and ``n_tokens`` of each distinct content in (digest, text)."""

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            digests, found = batch.column("digest"), []
            texts = batch.column("text").to_pylist()
            for lo, hi in steps(texts):
                found += counter.count(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    # copies meet in their own task first, so one content with a third of all rows is sent once a task
    return texts.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs``.

    Counts are those of the tokenizer's own library on the whole text, without begin, end or added
    special tokens; special strings inside a text count as the library's default has it. Nothing is
    truncated or padded. A null text counts as the empty one, of 0 bytes. One row per input row:
    repeated rows and null ids stay, and an empty table gives no rows. Columns other than id and
    text are not read, so their names and nulls do not matter. Very long texts are encoded in parts
    where the tokenizer's pattern allows a cut that cannot change its words, and whole otherwise.

    ``cache_path`` is a folder that all executors share; it is made if it does not exist. A text is
    encoded only if no text with the same normalised content has been counted by the same version of
    the tokenizer. Counts are written as a table before they are appended, and read from there, so
    a lost executor repeats no more than its own part, and another run that appends the same digests
    at the same time does no harm. The tokenizer file must be readable on every executor.
    """
    spark, tokenizer = docs.sparkSession, version(tokenizer_path)
    texts = pick(docs, id_column, text_column).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = _keyed(texts, tokenizer_path)
    known = read_cache(spark, cache_path, tokenizer)
    misses, counts = keyed, None
    if not known.isEmpty():
        stored = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        looked = materialise(keyed.select("digest").distinct().join(stored, "digest", "left"), "token-lookup")
        counts, absent = looked.where("n_tokens IS NOT NULL"), looked.where("n_tokens IS NULL").select("digest")
        if (n := absent.count()) <= BROADCAST_DIGESTS:
            misses = keyed.join(F.broadcast(absent), "digest", "left_semi") if n else None
        else:
            misses = keyed.dropDuplicates(["digest"]).join(absent, "digest", "left_semi")
    if misses is not None:
        fresh = materialise(_encode(misses, tokenizer_path), "token-counts")
        fresh.write.mode("append").parquet(f"{cache_path}/tokenizer={tokenizer}")
        counts = fresh if counts is None else counts.unionByName(fresh)
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
