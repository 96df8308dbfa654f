"""Benchmark decontamination: short items inside long documents, by MinHash containment.

Items are partitioned by the size of their shingle sets. Only the small side is sketched: an item's
sketch is its smallest shingle hashes, as many as its partition needs so that a document which
contains enough of the item holds one of them. Documents of any length are then probed with all
their shingles, and what is hit is verified on the exact shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txmetrics.functions.columns import col
from txmetrics.llm import words
from txmetrics.llm.frames import map_texts, pick, steps
from txmetrics.sinks.tables import materialise

#: Prefilter: a bit for each value of the leading bits of a sketch hash.
_LEAD = np.uint64(64 - 20)


@dataclass(frozen=True)
class Settings:
    """``percent``: the least share of an item's shingles, in hundredths, that makes a match.
    ``miss``: the greatest probability that a match has none of an item's sketch.
    ``block_chars``: characters of items that go to the tasks at once; more are searched block by block."""

    percent: int = 80
    miss: float = 1e-12
    block_chars: int = 8_000_000

    def sketch_size(self, largest: int) -> int:
        """Hashes for a partition of items with up to ``largest`` shingles.

        A match lacks at most (1 - t) of the shingles, so one hash more than that cannot fail;
        larger items need no more than what makes a miss improbable.
        """
        lacking = 1 - self.percent / 100
        certain = largest * (100 - self.percent) // 100 + 1
        return certain if not lacking else min(certain, math.ceil(math.log(self.miss) / math.log(lacking)))


class Items:
    """A block of items: exact shingles, sketches, and the shingle lengths in use."""

    def __init__(self, rows: list[tuple], settings: Settings):
        self.percent = settings.percent
        self.ids = [r[0] for r in rows]
        cut = words.split([r[1] for r in rows])
        hashes = cut.hashes()
        self.shingles: list[dict[int, bytes]] = []
        self.length: list[int] = []
        partitions: dict[int, list[int]] = {}
        for d, (a, b) in enumerate(zip(cut.first[:-1], cut.first[1:], strict=True)):
            n = min(words.SHINGLE, int(b - a))
            self.length.append(n)
            grams = words.join_hashes(hashes[a:b], n).tolist() if n else []
            self.shingles.append({h: b" ".join(cut.word(a + k + j) for j in range(n)) for k, h in enumerate(grams)})
            if grams:
                partitions.setdefault(len(self.shingles[d]).bit_length(), []).append(d)
        #: For each shingle length: sorted sketch hashes, the items they belong to, and the prefilter.
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sketched: dict[int, list[tuple[int, int]]] = {}
        for members in partitions.values():
            size = settings.sketch_size(max(len(self.shingles[d]) for d in members))
            for d in members:
                sketched.setdefault(self.length[d], []).extend((h, d) for h in sorted(self.shingles[d])[:size])
        for n, pairs in sketched.items():
            pairs.sort()
            keys = np.array([h for h, _ in pairs], np.uint64)
            lead = np.zeros(1 << 20, bool)
            lead[(keys >> _LEAD).astype(np.int64)] = True
            self.probes[n] = keys, np.array([d for _, d in pairs], np.int64), lead

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Text, item and number of shared shingles, for every match."""
        cut = words.split(texts)
        hashes, counts = cut.hashes(), cut.counts
        found: set[tuple[int, int]] = set()
        grams: dict[int, np.ndarray] = {}
        for n, (keys, owner, lead) in self.probes.items():
            own = grams[n] = words.join_hashes(hashes, n)
            at = np.flatnonzero(lead[(own >> _LEAD).astype(np.int64)])
            lo, hi = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(cut.first, at, "right") - 1
            inside = at + n <= cut.first[doc + 1]
            for d, a, b in zip(doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                found.update((d, int(x)) for x in owner[a:b])
        out = []
        for d, item in sorted(found):
            n = self.length[item]
            if counts[d] < n:
                continue
            shared = self._shared(cut, grams[n], d, item)
            if 100 * shared >= self.percent * len(self.shingles[item]):
                out.append((d, item, shared))
        return out

    def _shared(self, cut: words.Words, grams: np.ndarray, d: int, item: int) -> int:
        """Distinct shingles of an item that the text has, word for word."""
        n, wanted = self.length[item], self.shingles[item]
        a, b = int(cut.first[d]), int(cut.first[d + 1]) - n + 1
        keys = np.sort(np.fromiter(wanted, np.uint64, len(wanted)))
        own = grams[a:b]
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        seen = {}
        for k in np.flatnonzero(keys[place] == own).tolist():
            h = int(own[k])
            if h not in seen or not seen[h]:
                seen[h] = b" ".join(cut.word(a + k + j) for j in range(n)) == wanted[h]
        return sum(seen.values())


def item_blocks(items: DataFrame, id_column: str, text_column: str, settings: Settings) -> tuple[int, Iterator[list[tuple]]]:
    """The distinct items with a text: how many blocks of about ``block_chars`` characters they make, and the
    blocks one after another, each fetched when it is asked for. Items of several blocks are written once, by block."""
    rows = items.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = rows.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = total // settings.block_chars + 1
    if parts > 1:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
        rows = materialise(rows.repartition("block").sortWithinPartitions("block"), "decontamination-items")

    def fetch() -> Iterator[list[tuple]]:
        for k in range(parts):
            block = rows.where(F.col("block") == k) if parts > 1 else rows
            found = [(r["id"], r["text"]) for r in block.collect()]
            if found:
                yield sorted(found, key=lambda r: (str(r[0]), r[1]))

    return parts, fetch()


def find_items(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``shared`` and ``item_shingles`` for every document that contains an item.

    An item is contained if ``percent`` hundredths or more of its distinct five-word shingles (A-Z
    lower-cased) occur anywhere in the document. An item with fewer words is one shingle of its own
    length. Items without words and documents without words match nothing. Repeated rows of
    documents give a match each; repeated rows of items count once. Null ids are ids like others, an
    empty table of documents or items gives no rows, and of columns with clashing names only those named are read.
    A very long text is a step of its own. Items of more than ``block_chars`` characters are searched block by
    block: the matches of one block are written before the next is fetched.
    """
    kind = items.schema[item_id].dataType.simpleString()
    pa_type = to_arrow_type(items.schema[item_id].dataType)
    texts = pick(docs, id_column, text_column)
    schema = f"doc_id, item_id {kind}, shared long, item_shingles long"
    out = None
    parts, blocks = item_blocks(items, item_id, item_text, settings)
    for rows in blocks:

        def each(ids, texts, block):
            found = block.matches(texts)
            return {
                "doc_id": ids.take(pa.array([d for d, _, _ in found], pa.int64())),
                "item_id": pa.array([block.ids[i] for _, i, _ in found], pa_type),
                "shared": pa.array([n for _, _, n in found], pa.int64()),
                "item_shingles": pa.array([len(block.shingles[i]) for _, i, _ in found], pa.int64()),
            }

        part = map_texts(texts, schema, each, lambda rows=rows: Items(rows, settings))
        if parts > 1:
            part = materialise(part, "decontamination-found")
        out = part if out is None else out.unionByName(part)
    if out is None:
        doc_kind = texts.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], schema.replace("doc_id,", f"doc_id {doc_kind},"))
    return out


def uncontaminated(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_column: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all their columns.

    Null and empty texts contain none; an empty table of items takes nothing away; repeated rows and rows with a null
    id stay or go by their text. Items of more than ``block_chars`` characters are searched block by block: what one
    block leaves is written before the next is fetched, so driver and tasks hold one block.
    """
    parts, blocks = item_blocks(items, item_id, item_text, settings)
    for rows in blocks:
        docs = docs.where(~_hit(rows, settings)(F.coalesce(col(text_column).cast("string"), F.lit(""))))
        if parts > 1:
            docs = materialise(docs, "decontamination-left")
    return docs


def is_contaminated(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_column: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> Column:
    """A condition on ``docs``: the text contains an item. False for a null text and for no items.

    A condition holds all items at once, so it is for those of one block; :func:`uncontaminated` takes any number.
    """
    parts, blocks = item_blocks(items, item_id, item_text, settings)
    if parts > 1:
        raise ValueError(f"the items are {parts} blocks of {settings.block_chars} characters: use uncontaminated")
    out = F.lit(False)
    for rows in blocks:
        out = out | _hit(rows, settings)(F.coalesce(col(text_column).cast("string"), F.lit("")))
    return out


def _hit(rows: list[tuple], settings: Settings):
    held: list[Items] = []

    @F.pandas_udf("boolean")
    def hit(texts):
        import pandas as pd

        if not held:
            held.append(Items(rows, settings))
        values = texts.tolist()
        out = np.zeros(len(values), bool)
        for lo, hi in steps(values):
            out[[lo + d for d, _, _ in held[0].matches(values[lo:hi])]] = True
        return pd.Series(out)

    return hit
