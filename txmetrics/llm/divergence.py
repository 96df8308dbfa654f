"""How the word use of sources differs, by single-pass in-memory indexing.

Each task builds a block of postings in memory until the block is full, and spills it as runs that
are sorted by term, one for each hash shard. The runs of a shard are merged by a heap into the
frequencies of its terms. A divergence of two sources over all terms then is what it would be if
neither used any term, plus corrections for the terms that one or both use, which are summed as the
postings stream by. All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.llm.frames import STEP_CHARS
from txmetrics.sinks.tables import materialise

#: Probabilities are counted in units of one part in so many.
UNIT = 1_000_000_000
#: Bytes that a posting takes in a block, besides its term.
POSTING_BYTES = 150
#: Sources whose pairs one task sums at a time: a matrix of at most about twice this size squared.
SOURCE_BLOCK = 1024
#: Elements of one numpy step over pairs.
PAIR_STEP = 1 << 19

#: Postings of a run that travel as one row, and that a merge holds before it settles what is complete.
CHUNK, AT_ONCE = 1 << 14, 1 << 18

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
RUN_SCHEMA = "shard int, first binary, keys array<binary>, sources array<string>, counts array<long>, docs array<long>"
FREQUENCY_SCHEMA = "lang string, term string, source string, n long, total long, n_sources int, head int"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in parts: runs of letters of A to Z, lower-cased, and of everything beyond ASCII."""
    data = text.encode().lower()  # of bytes, so only A to Z
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + STEP_CHARS)
        stop = gap.start() if gap else len(data)
        yield _TERM.findall(data, start, stop)
        start = stop


class Block:
    """Postings in memory: occurrences, and documents, of every term by language and source."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: str) -> None:
        if (lang, source) not in self.groups:
            self.groups[lang, source] = Counter({b"": 0}), Counter()  # the empty term stands for the group itself
            self.held += POSTING_BYTES
        counts, docs = self.groups[lang, source]
        distinct: set[bytes] = set()
        for part in terms_of(text):
            before = len(counts)
            counts.update(part)
            own = set(part)
            if new := len(counts) - before:
                self.held += new * (POSTING_BYTES + max(map(len, own)))
            distinct |= own
        docs.update(distinct)

    def spill(self, shards: int) -> pa.RecordBatch:
        """The block as runs sorted by key (language, null byte, term) and source, one for each shard."""
        keys, hashes, names, of, counts, docs = [], [], [], [], [], []
        for k, ((lang, source), (n, m)) in enumerate(self.groups.items()):
            before = lang.encode() + b"\0"
            keys += [before + t for t in n]
            hashes += map(zlib.crc32, n)
            names.append(source)
            of += [k] * len(n)
            counts += n.values()
            docs += map(m.__getitem__, n)
        rows = pa.table(
            {
                "shard": (np.array(hashes, np.int64) % shards).astype(np.int32),
                "key": pa.array(keys, pa.binary()),
                "source": pa.array(names, pa.string()).take(pa.array(of, pa.int32())),
                "count": pa.array(counts, pa.int64()),
                "docs": pa.array(docs, pa.int64()),
            }
        )
        rows = rows.sort_by([("shard", "ascending"), ("key", "ascending"), ("source", "ascending")]).combine_chunks()
        shard = rows.column("shard").to_numpy()
        begun = np.diff(shard, prepend=-1) != 0
        at = np.arange(len(shard)) - np.maximum.accumulate(np.where(begun, np.arange(len(shard)), 0))
        edges = np.append(np.flatnonzero(at % CHUNK == 0), len(shard)).astype(np.int32)
        first = pa.array(edges[:-1])
        nested = [pa.ListArray.from_arrays(pa.array(edges), rows.column(c).chunk(0)) for c in ("key", "source", "count", "docs")]
        return pa.RecordBatch.from_arrays(
            [rows.column("shard").chunk(0).take(first), rows.column("key").chunk(0).take(first), *nested],
            ["shard", "first", "keys", "sources", "counts", "docs"],
        )


def runs(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """Sorted runs of all documents (lang, source, text), at most ``block_bytes`` of postings each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block.add(*row)
                if block.held >= block_bytes:
                    yield block.spill(shards)
                    block = Block()
        if block.groups:
            yield block.spill(shards)

    return docs.select("lang", "source", "text").mapInArrow(each, RUN_SCHEMA)


def merged(chunks: Iterator[tuple[bytes, pa.Table]]) -> Iterator[pa.Table]:
    """Postings of sorted runs in order of key and source, in tables that never part a key.

    ``chunks`` of all runs come in order of their first key. Those that have begun wait in a heap; what
    lies before the first key still to come is complete and is merged in one go.
    """
    heap: list[tuple[bytes, int, pa.Table]] = []
    held, most = 0, AT_ONCE
    for number, (first, chunk) in enumerate(chunks):
        if held > most:
            due = list(_due(heap, first))
            if due:
                held -= sum(len(x) for x in due)
                yield _merge(due)
            most = max(AT_ONCE, 2 * held)
        heapq.heappush(heap, (first, number, chunk))
        held += len(chunk)
    if heap:
        yield _merge([chunk for _, _, chunk in heap])


def _due(heap: list[tuple[bytes, int, pa.Table]], bound: bytes) -> Iterator[pa.Table]:
    """The postings before ``bound``; the heap keeps the rest."""
    later = []
    while heap and heap[0][0] < bound:
        _, number, chunk = heapq.heappop(heap)
        keys = chunk.column("key")
        cut = bisect_left(range(len(keys)), bound, key=lambda k: keys[k].as_py())  # noqa: B023
        yield chunk.slice(0, cut)
        if cut < len(keys):
            later.append((keys[cut].as_py(), number, chunk.slice(cut)))
    for entry in later:
        heapq.heappush(heap, entry)


def _merge(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).group_by(["key", "source"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    return table.sort_by([("key", "ascending"), ("source", "ascending")]).combine_chunks()


def frequencies(run_rows: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """Occurrences by language, term and source of the terms in ``least_docs`` documents of the language.

    ``total`` is the language's, ``n_sources`` the number of sources that use the term and ``head``
    1 in one row of each term. Every group has one row with the empty term, which is none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            for batch in batches:
                shard, first = (batch.column(k).to_pylist() for k in range(2))
                for k in range(batch.num_rows):
                    lists = [batch.column(c)[k].values for c in range(2, 6)]
                    yield shard[k], first[k], pa.table(lists, ["key", "source", "count", "docs"])

        for _, parts in groupby(chunks(), lambda c: c[0]):
            for table in merged((first, chunk) for _, first, chunk in parts):
                yield from _kept(table, least_docs)

    dealt = run_rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(each, FREQUENCY_SCHEMA)


def _kept(table: pa.Table, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of the terms of a merged table that are in enough documents, and of the groups themselves."""
    key = table.column("key").combine_chunks()
    start = np.append(0, 1 + np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)))
    size = np.diff(np.append(start, len(key)))
    n, docs = (table.column(c).to_numpy() for c in ("count_sum", "docs_sum"))
    names = [k.rpartition(b"\0") for k in key.take(pa.array(start)).to_pylist()]
    real = np.array([bool(term) for _, _, term in names])
    wanted = ~real | (np.add.reduceat(docs, start) >= least_docs)
    chosen = np.flatnonzero(wanted)
    rows = np.flatnonzero(np.repeat(wanted, size))
    times, own = size[chosen], real[chosen]
    spread = lambda values: np.repeat(values, times)
    of = pa.array(spread(np.arange(len(chosen))))
    head = np.zeros(len(rows), np.int32)
    head[np.cumsum(times) - times] = own
    out = pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([names[k][0].decode() for k in chosen], pa.string()).take(of),
            "term": pa.array([names[k][2].decode() for k in chosen], pa.string()).take(of),
            "source": table.column("source").combine_chunks().take(pa.array(rows)),
            "n": pa.array(n[rows]),
            "total": pa.array(spread(np.add.reduceat(n, start)[chosen])),
            "n_sources": pa.array(spread((times * own).astype(np.int32))),
            "head": pa.array(head),
        }
    )
    for lo in range(0, len(rows), 50_000):
        yield out.slice(lo, 50_000)


def probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + size)), exactly; null if there are no terms.

    Beyond nine billion occurrences the product leaves 64 bits, so there it is done in decimals.
    """
    over = total + size
    small = F.call_function("div", (n + 1) * UNIT, over)
    large = F.call_function("div", (n + 1).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)"), over.cast("decimal(20,0)"))
    return F.when(over > 0, 1 + F.when(n < 9_000_000_000, small).otherwise(large.cast("long")))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def audit(
    docs: DataFrame,
    least_docs: int = 3,
    term_ranks: int = 200,
    block_bytes: int = 64 << 20,
    shards: int | None = None,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """How each (language, source) group differs from the other sources of its language, and by which terms.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value`` long and ``rank`` int. Terms are runs of
    letters A to Z, lower-cased, and of characters beyond ASCII; a language keeps those in at least
    ``least_docs`` of its documents. A kept term's probability in a group or language is
    p = 1 + floor(10^9 (count + 1) / (N + V)), N the counts of the V kept terms together; the divergence
    of p from q is floor((p - q)^2 / q).

    Part ``pair``: ``item`` is every other source of the language, ``value`` the divergences from it
    summed over all kept terms, 0 if there are none. Part ``term``: ``item`` is a kept term that the
    group uses more than the language does, ``value`` its divergence from the language, ranks up to
    ``term_ranks``. Ranks begin with 1, by value downwards, ties by the item's UTF-8 bytes.

    Null text, language or source count as the empty string. Repeated rows and rows with null ids are
    documents like any other. A group without terms, or with empty texts only, has its pairs all the
    same. An empty table gives no rows. Other columns are not read, so their names and nulls do not matter. Very
    long texts are cut into terms part by part.

    ``block_bytes``: postings that a task holds before it spills them; one document may exceed it.
    ``shards``: hash shards of terms, each merged by one task; as many as shuffle partitions by
    default. A task holds the begun chunks of its shard, so shards should grow with the data. A sum of divergences
    fits 64 bits as long as a language keeps fewer than 10^9 terms.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_column), ("source", source_column), ("text", text_column))]
    )
    used = materialise(frequencies(runs(texts, shards, block_bytes), shards, least_docs), "divergence-frequencies")
    of_group = used.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("head").alias("heads"))
    of_lang = of_group.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("heads").alias("size"), F.count("*").alias("sources"))
    groups = of_group.join(of_lang, "lang").select(
        "lang", "source", "n_group", "n_lang", "size", F.ceil(F.col("sources") / SOURCE_BLOCK).cast("int").alias("blocks"),
        probability(F.lit(0).cast("long"), F.col("n_group"), F.col("size")).alias("p0"),
    )
    groups = materialise(groups, "divergence-groups")
    scored = used.where("term <> ''").join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("n_group"), F.col("size")))
    pairs = _pairs(scored, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    q = probability(F.col("total"), F.col("n_lang"), F.col("size"))
    terms = scored.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    return _ranked(pairs).unionByName(_ranked(terms).where(F.col("rank") <= term_ranks))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of every source of a language from every other, over all kept terms.

    Were no term used, each would give the same value. Terms that one of the two uses are corrected
    by its histogram of probabilities, since the other's is constant there; what that gets wrong for
    terms that both use is corrected as their postings stream by.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.join(other, "lang").where("source <> item")
    p0, q0, p = F.col("p0"), F.col("q0"), F.col("p")
    level = divergence(p0, q0)
    unused = both.select("lang", "source", "item", F.coalesce(F.col("size") * level, F.lit(0)).cast("decimal(38,0)").alias("value"))
    histogram = materialise(scored.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n")), "divergence-histograms")
    met = histogram.join(other, "lang").where("source <> item")
    one = met.groupBy("lang", "source", "item").agg(
        _exact_sum(F.col("n") * (divergence(p, q0) - level)).alias("to"),
        _exact_sum(F.col("n") * (divergence(q0, p) - divergence(q0, p0))).alias("from"),
    )
    ways = F.explode(
        F.array(
            F.struct(F.col("source").alias("source"), F.col("item").alias("item"), F.col("to").alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("from").alias("value")),
        )
    )
    one = one.select("lang", ways.alias("way")).select("lang", "way.*")
    shared = _corrections(scored).withColumn("value", F.col("value").cast("decimal(38,0)"))
    parts = unused.unionByName(one).unionByName(shared)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def _corrections(scored: DataFrame) -> DataFrame:
    """For terms that two sources both use: what their divergence is beyond the sum of either's own share.

    A language with more than SOURCE_BLOCK sources is cut into blocks of them and each two blocks
    meet in tasks of their own, so that no matrix grows with the number of sources.
    """
    part = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    rows = scored.where("n_sources > 1").withColumn("part", part)
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("part", "met").alias("lo"), F.greatest("part", "met").alias("hi"), "term", "source", "part", "p", "p0")
    dealt = rows.repartition("lang", "lo", "hi", "term").sortWithinPartitions("lang", "lo", "hi", "term", "source")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rest = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            key = _codes(table, ("lang", "lo", "hi"))
            term = _codes(table, ("lang", "lo", "hi", "term"))
            # the last term may go on in the next batch
            stop = int(np.searchsorted(term, term[-1])) if len(term) else 0
            rest = table.slice(stop)
            begun = np.concatenate([np.flatnonzero(np.diff(key[:stop], prepend=-1)), [stop]]) if stop else np.zeros(1, int)
            for a, b in zip(begun[:-1].tolist(), begun[1:].tolist(), strict=True):
                sums, done = _PairSums.of(table, a, sums)
                if done is not None:
                    yield from done.rows()
                sums.add(table.slice(a, b - a), term[a:b])
        if rest is not None and rest.num_rows:
            sums, done = _PairSums.of(rest, 0, sums)
            if done is not None:
                yield from done.rows()
            sums.add(rest, np.zeros(rest.num_rows, np.int64))
        if sums is not None:
            yield from sums.rows()

    return dealt.mapInArrow(each, "lang string, source string, item string, value long")


def _codes(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """A number for each row that grows where one of the columns changes."""
    changed = np.zeros(table.num_rows, bool)
    for c in columns:
        codes = table.column(c).combine_chunks()
        if pa.types.is_string(codes.type):
            codes = codes.dictionary_encode().indices
        codes = codes.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


class _PairSums:
    """Corrections of the pairs of sources of one language and one pair of source blocks."""

    def __init__(self, key: tuple[str, int, int]) -> None:
        self.key, self.index, self.part = key, {}, []
        self.sums = np.zeros((64, 64), np.int64)

    @staticmethod
    def of(table: pa.Table, row: int, held: _PairSums | None) -> tuple[_PairSums, _PairSums | None]:
        """The sums for a row, and those held so far if they are for something else and so complete."""
        key = tuple(table.column(c)[row].as_py() for c in ("lang", "lo", "hi"))
        return (held, None) if held is not None and held.key == key else (_PairSums(key), held)

    def add(self, table: pa.Table, term: np.ndarray) -> None:
        names = table.column("source").combine_chunks().dictionary_encode()
        local = np.empty(len(names.dictionary), np.int64)
        first = np.unique(names.indices.to_numpy(), return_index=True)[1]
        part = table.column("part").to_numpy()
        for k, name in enumerate(names.dictionary.to_pylist()):
            if name not in self.index:
                self.index[name] = len(self.index)
                self.part.append(int(part[first[k]]))
            local[k] = self.index[name]
        while len(self.index) > len(self.sums):
            self.sums = np.pad(self.sums, (0, len(self.sums)))
        source = local[names.indices.to_numpy()]
        p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
        start = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(start, len(term)))
        for k in np.unique(size[size > 1]).tolist():
            begun = start[size == k]
            step = max(1, PAIR_STEP // (k * k))
            for lo in range(0, len(begun), step):
                at = begun[lo : lo + step, None] + np.arange(k)
                for left in range(0, k, max(1, PAIR_STEP // k)):
                    self._meet(source, p, p0, at[:, left : left + max(1, PAIR_STEP // k)], at)

    def _meet(self, source, p, p0, one, other) -> None:
        a, a0, b, b0 = p[one][:, :, None], p0[one][:, :, None], p[other][:, None, :], p0[other][:, None, :]
        beyond = _floor(a, b) - _floor(a, b0) - _floor(a0, b) + _floor(a0, b0)
        place = source[one][:, :, None] * len(self.sums) + source[other][:, None, :]
        np.add.at(self.sums.reshape(-1), place.reshape(-1), beyond.reshape(-1))

    def rows(self) -> Iterator[pa.RecordBatch]:
        names, part = np.array(list(self.index), object), np.array(self.part)
        _, lo, hi = self.key
        for k in range(len(names)):
            # inside one block all pairs are here, of two blocks only those across
            others = np.flatnonzero((self.sums[k, : len(names)] != 0) & ((part != part[k]) | (lo == hi)))
            others = others[others != k]
            if len(others):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([self.key[0]] * len(others), pa.string()),
                        "source": pa.array([names[k]] * len(others), pa.string()),
                        "item": pa.array(names[others].tolist(), pa.string()),
                        "value": pa.array(self.sums[k, others]),
                    }
                )


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q
