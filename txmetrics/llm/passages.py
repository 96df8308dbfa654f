"""Repeated passages by sparse suffix arrays.

Of all suffixes only those at minimisers are kept: in every window of positions, the one whose next
words have the smallest hash. Equal passages choose equal positions, so a passage of ``least`` words
that occurs twice has at least one kept suffix at the same place in both. Suffixes whose first words
occur in more than one document are sorted by what follows; neighbours are compared and their matches
extended to the right and to the left. A second sort, by what comes before, finds for each suffix the
neighbour that agrees longest on that side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txmetrics.llm import words
from txmetrics.llm.frames import map_texts, pick
from txmetrics.sinks.tables import materialise


#: A seed is hot if this part of all suffixes or more begins with it, so there are no more hot ones than this.
HOT = 1000


@dataclass(frozen=True)
class Settings:
    """``least``: words of the shortest passage reported. ``seed``: words hashed at a position to choose
    minimisers. ``reach``: words on either side of a minimiser that are compared; longer passages are
    seen through several minimisers and joined. ``task_rows``: suffixes sorted in one task."""

    least: int = 50
    seed: int = 8
    reach: int = 64
    task_rows: int = 40_000

    @property
    def window(self) -> int:
        """So many neighbouring positions hold a kept one: any ``least`` words have one with its seed inside."""
        return self.least - self.seed + 1


def minimisers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Positions that are smallest, and first among equals, in some ``window`` neighbouring ones."""
    if len(seeds) < window:
        return np.zeros(0, np.int64)
    # the minimum of each window, from minima of blocks: prefixes and suffixes of blocks cover any window
    n = -(-len(seeds) // window) * window
    padded = np.full(n, 2**64 - 1, np.uint64)
    padded[: len(seeds)] = seeds
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(seeds) - window + 1], ahead[window - 1 : len(seeds)])
    # a position is kept if its seed is the minimum of a window that holds it
    chosen = np.zeros(len(seeds), bool)
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    for lo, hi in zip(edge, np.append(edge[1:], len(least)), strict=True):
        at = lo
        while at < hi:  # windows lo..hi-1 share a minimum value; its first place in each of them
            place = at + int(np.argmax(seeds[at : at + window] == least[lo]))
            chosen[place] = True
            at = place + 1
    return np.flatnonzero(chosen)


def _suffixes(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``copy`` (its text's hash), ``seed`` and ``at`` of every kept suffix."""

    def each(rows, texts):
        cut = words.split(texts)
        seeds = words.join_hashes(cut.hashes(), settings.seed)
        owner, at, found = [], [], []
        for d, (a, b) in enumerate(zip(cut.first[:-1], cut.first[1:], strict=True)):
            if b - a < settings.least:
                continue
            own = seeds[a : b - settings.seed + 1]
            places = minimisers(own, settings.window)
            owner.append(np.full(len(places), d))
            at.append(places)
            found.append(own[places])
        none = np.zeros(0, np.int64)
        return {
            "doc_id": rows.field("doc_id").take(own := pa.array(np.concatenate([none, *owner]))),
            "copy": rows.field("copy").take(own),
            "seed": np.concatenate([none.view(np.uint64), *found]).view(np.int64),
            "at": np.concatenate([none, *at]).astype(np.int32),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.struct("doc_id", "copy").alias("doc_id"), "text")
    return map_texts(keyed, f"doc_id {kind}, copy long, seed long, at int", each)


def _contexts(docs: DataFrame, settings: Settings) -> DataFrame:
    """For the suffixes listed in ``places`` of each text: the hashes of the words after and before.

    Both are big-endian, nearest word first, so that bytes sort as words do.
    """
    reach = settings.reach

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):  # one text at a time: its contexts are many times its size
                doc, places = batch.column(0).slice(r, 1), np.array(batch.column(2)[r].as_py(), np.int64)
                cut = words.split([batch.column(1)[r].as_py()])
                one = cut.hashes()
                short = (one >> np.uint64(32)).astype(">u4")
                seeds = words.join_hashes(one, settings.seed)
                flat, turned = short.tobytes(), short[::-1].tobytes()
                n = len(one)
                for lo in range(0, len(places), 4096):
                    part = places[lo : lo + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.concat_arrays([doc] * len(part)),
                            "seed": seeds[part].view(np.int64),
                            "at": part.astype(np.int32),
                            "after": pa.array([flat[4 * p : 4 * (p + reach)] for p in part.tolist()], pa.binary()),
                            "before": pa.array([turned[4 * (n - p) : 4 * (n - p + reach)] for p in part.tolist()], pa.binary()),
                        }
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "places").mapInArrow(
        each, f"doc_id {kind}, seed long, at int, after binary, before binary"
    )


def _agree(x: bytes, y: bytes) -> int:
    """How many words two contexts have in common from their start."""
    n = min(len(x), len(y)) // 4
    differ = np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n)
    return int(differ.argmax()) if differ.any() else n


class _Neighbours:
    """Compares sorted suffixes with the nearest ones of other documents on both sides, one after another.

    A run is neighbouring suffixes of one seed and one document. ``held`` is the latest run and ``above``
    the row before it, if that has its seed.
    """

    def __init__(self, least: int):
        self.least = least
        self.above: tuple | None = None
        self.held: list[tuple] = []
        self.found: list[tuple] = []

    def add(self, row: tuple) -> bool:
        """``row``: seed, doc_id, at, after, before. Whether it begins a run."""
        if self.held and row[:2] == self.held[-1][:2]:
            self.held.append(row)
            if self.above:
                self.compare(self.above, row)
            return False
        same = bool(self.held) and row[0] == self.held[-1][0]
        if same:
            for other in self.held:
                self.compare(other, row)
        self.above = self.held[-1] if same else None
        self.held = [row]
        return True

    def compare(self, one: tuple, two: tuple) -> None:
        right, left = _agree(one[3], two[3]), _agree(one[4], two[4])
        if left + right >= self.least:
            self.found.append((one[1], one[2] - left, one[2] + right, two[1]))
            self.found.append((two[1], two[2] - left, two[2] + right, one[1]))


#: What a row of ``_matches`` is, in ``edge``: null for a match, or of a task's rows the first run and the last
#: run, and the first row, the last row and the foreign rows of one seed next to these runs.
_HEAD, _TAIL, _FIRST, _LAST, _BELOW_HEAD, _ABOVE_TAIL = range(6)


def _foreign(edges: DataFrame) -> DataFrame:
    """For the first and the last run of each task (``part``, ``edge``): the nearest row of another document
    of the same seed in tasks before or after, as ``far_doc``, ``far_at``, ``far_after`` and ``far_before``.

    ``edges``: the rows of a task from _FIRST on. In the order of tasks, where the document of a seed changes
    the row passed last is the foreign one of all rows up to the next change. A seed's window has at most three
    rows for each task that it fills, which is its share of all rows divided by ``task_rows``.
    """
    far = F.struct("doc_id", "at", "after", "before")
    found = []
    for run, kinds, turn in ((_HEAD, [_FIRST, _ABOVE_TAIL, _LAST], 1), (_TAIL, [_LAST, _BELOW_HEAD, _FIRST], -1)):
        place = F.array_position(F.lit(kinds), F.col("edge"))
        order = Window.partitionBy("seed").orderBy(turn * F.col("part"), place)
        passed = edges.where(F.col("edge").isin(kinds)).withColumn("passed", F.lag(far).over(order))
        changed = F.when(F.col("passed.doc_id") != F.col("doc_id"), F.col("passed"))
        nearest = F.last(changed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = passed.withColumn("far", nearest).where((F.col("edge") == kinds[0]) & F.col("far").isNotNull())
        found.append(
            rows.select(
                "part",
                F.lit(run).alias("edge"),
                F.col("far.doc_id").alias("far_doc"),
                F.col("far.at").alias("far_at"),
                F.col("far.after").alias("far_after"),
                F.col("far.before").alias("far_before"),
            )
        )
    return found[0].unionByName(found[1])


def _matches(suffixes: DataFrame, side: str, settings: Settings) -> DataFrame:
    """Matches between neighbours in the order of ``side``: doc_id, first word, end word, other document.

    The sort is by range over the whole key, down to document and position, so that even one passage
    that a third of all documents share is spread evenly. What lies on both sides of a border between
    tasks is compared afterwards: each task writes its first and last run of rows and at most four rows
    more, from which a window finds the nearest row of another document for every such run.
    """
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    n = suffixes.count()
    parts = max(1, -(-n // settings.task_rows))
    names = ["seed", "doc_id", "at", "after", "before"]
    key = ["seed", side, "doc_id", "at"]
    schema = f"doc_id {kind}, start int, stop int, other {kind}, edge int, part int, seed long, at int, after binary, before binary"
    doc_type = to_arrow_type(suffixes.schema["doc_id"].dataType)

    def each(batches):
        work, head, part = _Neighbours(settings.least), [], None
        edges: dict[int, tuple] = {}
        for batch in batches:
            if part is None:
                from pyspark import TaskContext

                part = TaskContext.get().partitionId()
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for row in zip(*columns, strict=True):
                begins = work.add(row)
                if not head:
                    edges[_FIRST] = row
                elif begins and _LAST not in edges:
                    edges[_LAST] = row  # the first run is over
                    if row[0] == head[0][0]:
                        edges[_BELOW_HEAD] = row
                if _LAST not in edges:
                    head.append(row)
            yield _batch(work.found, [], part)
            work.found = []
        if part is not None:
            edges[_LAST] = work.held[-1]
            if work.above:
                edges[_ABOVE_TAIL] = work.above
            runs = [*((_HEAD, row) for row in head), *((_TAIL, row) for row in work.held)]
            for lo in range(0, len(runs), 4096):
                yield _batch([], runs[lo : lo + 4096], part)
            yield _batch([], list(edges.items()), part)

    def _batch(found, edges, part):
        out = {c: [] for c in ("doc_id", "start", "stop", "other", "edge", "part", "seed", "at", "after", "before")}
        for doc, start, stop, other in found:
            for c, v in zip(out, (doc, start, stop, other, None, None, None, None, None, None), strict=True):
                out[c].append(v)
        for edge, (seed, doc, at, after, before) in edges:
            for c, v in zip(out, (doc, None, None, None, edge, part, seed, at, after, before), strict=True):
                out[c].append(v)
        types = {"start": pa.int32(), "stop": pa.int32(), "edge": pa.int32(), "part": pa.int32(), "seed": pa.int64(), "at": pa.int32(), "after": pa.binary(), "before": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, doc_type)) for c, v in out.items()})

    ordered = suffixes.select(*names).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    found = materialise(ordered.mapInArrow(each, schema), "passages-matches")
    foreign = _foreign(found.where(F.col("edge") >= _FIRST).select("part", "edge", *names))

    def across(batches):
        for batch in batches:
            work = _Neighbours(settings.least)
            for seed, doc, at, after, before, far_doc, far_at, far_after, far_before in zip(
                *(batch.column(k).to_pylist() for k in range(9)), strict=True
            ):
                work.compare((seed, far_doc, far_at, far_after, far_before), (seed, doc, at, after, before))
            columns = zip(*work.found, strict=True) if work.found else ([],) * 4
            types = (doc_type, pa.int32(), pa.int32(), doc_type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "stop", "other"])

    border = found.where(F.col("edge") < _FIRST).select("part", "edge", *names)
    met = border.join(foreign, ["part", "edge"]).drop("part", "edge")
    matches = found.where("edge is null").select("doc_id", "start", "stop", "other")
    return matches.unionByName(met.mapInArrow(across, f"doc_id {kind}, start int, stop int, other {kind}"))


def _in_several(kept: DataFrame) -> DataFrame:
    """The suffixes whose seed occurs in more than one document.

    At most ``HOT`` seeds have a ``HOT``-th of all suffixes or more. Theirs are told by a broadcast of those seeds and
    stay where they are; all others meet their seeds by a shuffle in which no seed is large.
    """
    counts = kept.groupBy("seed").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n"))
    shared = materialise(counts.where("x <> y").select("seed", "n"), "passages-seeds")
    often = F.col("n") * HOT >= kept.count()
    hot = F.broadcast(shared.where(often).select("seed"))
    rare = shared.where(~often).select("seed")
    return kept.join(hot, "seed", "left_semi").unionByName(kept.join(hot, "seed", "left_anti").join(rare, "seed", "left_semi"))


def repeated_passages(
    docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Passages of ``least`` words or more that also occur in another document, A-Z lower-cased.

    One row for each passage of a document after joining matches that overlap: ``doc_id``,
    ``start_word``, ``end_word`` (exclusive), ``n_words`` and ``other_doc_id``, the smallest id among
    the documents it was matched with. Null, empty and short texts have none. Rows that repeat an id
    count as one document: each text is searched by itself, and the places found in any of them are
    those of the id, as in the SQL twin. Rows with a null id are left out, since no other document can be named.
    """
    texts = pick(docs, id_column, text_column).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.withColumn("copy", F.xxhash64("text"))  # an id may be repeated with another text
    kept = materialise(_suffixes(texts, settings), "passages-suffixes")
    places = _in_several(kept).groupBy("doc_id", "copy").agg(F.collect_set("at").alias("places"))
    suffixes = materialise(_contexts(texts.join(places, ["doc_id", "copy"]), settings), "passages-contexts")
    matches = _matches(suffixes, "after", settings).unionByName(_matches(suffixes, "before", settings))
    return _joined(matches)


def _joined(matches: DataFrame) -> DataFrame:
    """Overlapping matches of a document as one passage. A window holds one document's matches, which its own length bounds."""
    spans = matches.groupBy("doc_id", "start", "stop").agg(F.min("other").alias("other"))
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    earlier = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("begins", F.coalesce((F.col("start") >= earlier).cast("int"), F.lit(1)))
    numbered = begun.withColumn("passage", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "passage").agg(
        F.min("start").alias("start_word"),
        F.max("stop").alias("end_word"),
        (F.max("stop") - F.min("start")).alias("n_words"),
        F.min("other").alias("other_doc_id"),
    ).drop("passage")
