"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact verification.

Documents with the same shingle set are one class and only its smallest id goes on. Candidates
share a band of their signatures. Their signatures are compared batch by batch; a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls under a chosen
miss probability. The rest is verified on the full sets.

Pairs inside a bucket are never listed. First every class in a bucket is compared with one leader,
a few times over with other leaders, which joins the members of dense groups. What then still lies
in different components of a bucket is compared in blocks of bounded size, and only links that join
components leave a block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.llm import words
from txmetrics.llm.frames import map_texts, pick
from txmetrics.llm.graph import components
from txmetrics.sinks.tables import materialise


@dataclass(frozen=True)
class Settings:
    """``percent``: the least similarity of a link, in hundredths. ``band_rows``: hashes of a band.
    ``band_miss``: probability that a pair at the threshold shares no band, which sets the number of
    bands. ``prune_miss``: posterior probability under which a pair is dropped. ``leader_rounds``:
    leaders tried for each bucket before blocks of ``block`` classes are compared."""

    percent: int = 80
    band_rows: int = 5
    band_miss: float = 1e-8
    prune_miss: float = 1e-9
    leader_rounds: int = 2
    block: int = 512

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log1p(-((self.percent / 100) ** self.band_rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows

    def least_matches(self) -> list[tuple[int, int]]:
        """After how many hashes to look, and the fewest matches with which a pair goes on.

        With a uniform prior, n hashes and k matches, the similarity reaches t with the probability
        that at most k of n + 1 draws fall under t.
        """
        t, out = self.percent / 100, []
        for n in [*range(4 * self.band_rows, self.hashes, 4 * self.band_rows), self.hashes]:
            total, k = 0.0, -1
            while total < self.prune_miss:
                k += 1
                total += math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k)
            out.append((n, k))
        return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(97)
    return random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(shingles: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set; a long set is done in parts."""
    a, b = multipliers
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for lo in range(0, len(shingles), 1024):
        part = shingles[lo : lo + 1024]
        np.minimum(least, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """For every (doc_id, text): size and fingerprint of its shingle set, MinHash signature and bands."""
    hashes, rows = settings.hashes, settings.band_rows
    salt = np.arange(settings.bands, dtype=np.uint64)

    def each(ids, texts, multipliers):
        cut = words.split(texts)
        grams, first = words.shingles(cut, cut.hashes())
        size, one, two, signed, bands = [], [], [], [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = np.unique(grams[a:b])
            size.append(len(own))
            one.append(words.mix(own).sum(dtype=np.uint64))
            two.append(words.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            if not len(own):
                signed.append(b"")
                bands.append([])
                continue
            signature = minhashes(own, multipliers)
            signed.append(signature.tobytes())
            grid = signature.astype(np.uint64).reshape(-1, rows)
            key = salt
            for k in range(rows):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
            bands.append(key.view(np.int64))
        return {
            "doc_id": ids,
            "n_shingles": pa.array(size, pa.int64()),
            "set1": pa.array(np.array(one, np.uint64).view(np.int64), pa.int64()),
            "set2": pa.array(np.array(two, np.uint64).view(np.int64), pa.int64()),
            "signature": pa.array(signed, pa.binary()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
        }

    schema = "doc_id, n_shingles long, set1 long, set2 long, signature binary, bands array<long>"
    return map_texts(docs, schema, each, lambda: _multipliers(hashes))


def _survives(left: np.ndarray, right: np.ndarray, plan: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices are still possible links after all batches."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in plan:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _prune(pairs: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that the signatures do not rule out."""
    plan, hashes = settings.least_matches(), settings.hashes

    def each(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, hashes) for k in (2, 3))
            keep = pa.array(_survives(left, right, plan))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left = signed.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = signed.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(each, f"a {kind}, b {kind}").distinct()


def shingle_set(text: str | None) -> frozenset[bytes]:
    """The exact shingles of a text."""
    cut = words.split([text])
    parts = [cut.word(k) for k in range(len(cut.start))]
    if len(parts) < words.SHINGLE:
        return frozenset([b" ".join(parts)] if parts else [])
    return frozenset(b" ".join(parts[k : k + words.SHINGLE]) for k in range(len(parts) - words.SHINGLE + 1))


def _verify(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    percent = settings.percent

    def each(batches):
        last, held = None, frozenset()
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != last:  # the leader of a group comes many times in a row
                    last, held = x, shingle_set(x)
                other = shingle_set(y)
                shared = len(held & other)
                if 100 * shared >= percent * (len(held) + len(other) - shared):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(each, f"a {kind}, b {kind}")


def _in_blocks(live: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Verified links between classes that share a bucket but lie in different components.

    A bucket of m classes is cut by hash into about m / block parts, and each two parts meet in one
    group of about two blocks, so no group grows with the bucket. A pair is looked at only in the
    first band that it shares, pruned by its signatures and verified on the full sets. What leaves a
    group is a spanning forest of its links, never all of them.
    """
    plan, hashes, percent = settings.least_matches(), settings.hashes, settings.percent
    kind = live.schema["node"].dataType.simpleString()

    def each(key, rows):
        same, band = key[1].as_py() == key[2].as_py(), rows.column("band")[0].as_py()
        node, component, part, size = (rows.column(c).to_numpy() for c in ("node", "component", "part", "n_shingles"))
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, hashes)
        earlier = signature[:, : band * settings.band_rows].reshape(len(node), band, settings.band_rows)
        text, sets = rows.column("text"), {}
        _, joined = np.unique(component, return_inverse=True)

        def own(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_fingerprints(text[k].as_py())
            return sets[k]

        lefts, rights = [], []
        for k in range(len(node)):
            others = np.flatnonzero((joined != joined[k]) & (size >= size[k]) & (percent * size <= 100 * size[k]))
            others = others[(size[others] > size[k]) | (others > k)]
            if not same:
                others = others[part[others] != part[k]]
            others = others[_survives(np.broadcast_to(signature[k], (len(others), hashes)), signature[others], plan)]
            others = others[~(earlier[others] == earlier[k]).all(axis=2).any(axis=1)]
            for other in others.tolist():
                if joined[other] == joined[k]:
                    continue
                x, y = own(k), own(other)
                shared = _in_common(x, y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    lefts.append(k)
                    rights.append(other)
                    joined[joined == joined[other]] = joined[k]
        a, b = node[np.array(lefts, np.int64)], node[np.array(rights, np.int64)]
        id_type = rows.schema.field("node").type
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema([("a", id_type), ("b", id_type)]))

    sizes = live.groupBy("bucket").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("parts"))
    cut = live.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meet = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", "band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "component", "part"
    )
    rows = meet.join(held, "node")
    return rows.groupBy("bucket", "lo", "hi").applyInArrow(each, f"a {kind}, b {kind}").distinct()


def shingle_fingerprints(text: str) -> np.ndarray:
    """The whole shingle set of a text as sorted 64-bit fingerprints."""
    cut = words.split([text])
    return np.unique(words.shingles(cut, cut.hashes())[0])


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Two documents are linked if their sets of distinct five-word shingles (A-Z lower-cased) have
    ``percent`` hundredths or more in common; a component is what links connect, and its smallest id
    names it. Fewer than five words are one shingle. A document without words, null text included,
    has an empty set and is a component of its own. Rows that repeat an id are judged each by its
    shingles; if their texts differ, links of either count for the id, so all its rows with words have one
    component. A null id takes part in its exact class only, and is kept only as the sole kind of id
    in it. An empty table gives no rows. Other columns than id and text are not read.
    """
    texts = pick(docs, id_column, text_column)
    signed = materialise(signatures(texts, settings), "near-signatures")
    key = ["set1", "set2", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"))
    chosen = signed.join(classes, key).where(F.col("doc_id") == F.col("node"))
    links = _links(chosen, texts, settings).unionByName(_same_id(signed, classes, key))
    found = materialise(links, "near-links")
    named = classes.join(components(found, "near-components"), "node", "left").select(
        *key, F.coalesce("component", "node").alias("component_id")
    )
    return (
        signed.select("doc_id", *key)
        .join(named, key, "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _same_id(signed: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links between the classes of ids that are repeated with different texts."""
    held = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    differ = " OR ".join(f"min({k}) <> max({k})" for k in key)
    repeated = held.groupBy("doc_id").agg(F.expr(differ).alias("differ")).where("differ").select("doc_id")
    of = held.select("doc_id", *key).join(repeated, "doc_id").join(classes, key).select("doc_id", "node").distinct()
    of = materialise(of, "near-repeated-ids")
    least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
    return of.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _links(chosen: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Verified links that connect all classes that similarity connects."""
    buckets = chosen.select("node", F.posexplode("bands").alias("band", "bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = materialise(buckets.join(shared, "bucket"), "near-buckets")
    nodes = live.select("node").distinct()
    signed = materialise(chosen.select("node", "n_shingles", "signature").join(nodes, "node"), "near-held")
    whole = materialise(
        texts.join(nodes, texts["doc_id"] == nodes["node"]).select("node", "text").where(F.col("text").isNotNull()), "near-texts"
    )
    live = live.withColumn("component", F.col("node"))
    links = None
    for k in range(settings.leader_rounds):
        # any leader will do; another is drawn in each round
        order = F.struct(F.xxhash64("node", F.lit(k)), "node", "component")
        leaders = live.groupBy("bucket").agg(F.min(order).alias("first")).select(
            "bucket", F.col("first.node").alias("leader"), F.col("first.component").alias("led")
        )
        pairs = live.join(leaders, "bucket").where("component <> led").select(
            F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")
        ).distinct()
        new = materialise(_verify(_prune(pairs, signed.select("node", "signature"), settings), whole, settings), "near-round")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        live = _still_apart(live, components(links, "near-step"))
    rest = _in_blocks(live, signed.join(whole, "node"), settings)
    return rest if links is None else links.unionByName(rest)


def _still_apart(live: DataFrame, found: DataFrame) -> DataFrame:
    """Memberships with the components as now known, without buckets that lie in one component."""
    named = live.drop("component").join(found, "node", "left").select(
        "bucket", "band", "node", F.coalesce("component", "node").alias("component")
    )
    named = materialise(named, "near-live")
    apart = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return materialise(named.join(apart, "bucket"), "near-live")
