"""Language-model scores: exact unigram counts, and a hashed maximum-entropy model over words.

The model factors a word's probability: its class given the words before it, then the word given its
class. Classes are a softmax over hashed features of the context (the word before, the two words
before, and the second and third word before with those between skipped); their number and the
size of the feature table grow with the corpus. A word's share of its class is its exact count plus one half.

Classes are learnt. The most frequent words (anchors) are grouped by the company they keep: their neighbours
within a few words are counted over the whole corpus, and the matrix of these counts, whose size is fixed,
is cut at the principal axis of the heaviest group until there are enough groups. All other known words join
the class for which the anchors around them speak in most of their occurrences. Words that occur once, words
beyond the ``frequent`` most frequent ones and new words make up one more class, so that the
probability of a new word is learnt from words that are almost new.

Training takes the sums over the whole corpus in each round: the features' counts with each class, and what the
model expects of them. They are added up by slices of the table, so the result does not depend on how
the rows are split into tasks, but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.llm import words
from txmetrics.llm.frames import map_texts, pick, steps
from txmetrics.sinks.tables import materialise

#: The fingerprint of the token that ends every text, and of what stands before a text.
END = np.uint64(0x1F83D9ABFB41BD6B)
BEFORE = np.uint64(0x5BE0CD19137E2179)


@dataclass(frozen=True)
class Settings:
    """``frequent``: words whose counts and classes go to every task; all others are looked up by a join.
    ``anchors``: words that classes are made of. ``reach``: how far a neighbour may be away. ``rounds``:
    gradient updates after the first, which starts from no weights and so needs the counts alone. ``prior``: occurrences that a feature needs to be half believed. ``bits`` and
    ``classes`` fix the size of the model; by default it follows the corpus, see :func:`sizes`, up to ``most_bits``
    and ``most_classes``, since the table goes to every task (268 MB; reached at some 10^11 tokens)."""

    frequent: int = 1 << 18
    anchors: int = 512
    reach: int = 4
    rounds: int = 1
    prior: float = 16.0
    most_bits: int = 20
    most_classes: int = 64
    bits: int | None = None
    classes: int | None = None


def sizes(train_tokens: int, distinct: int, settings: Settings) -> tuple[int, int]:
    """Bits of the feature table, whose rows are 128 times the cube root of the tokens, and the number of learnt
    classes, the fifth root of the vocabulary. So the tables that tasks hand on grow more slowly than the input."""
    bits = settings.bits or min(7 + round(np.log2(train_tokens + 1) / 3), settings.most_bits)
    return bits, settings.classes or min(1 << max(round(np.log2(distinct + 1) / 5), 2), settings.most_classes)


@dataclass
class Tokens:
    """Fingerprints of all tokens of some texts in order, and the number of tokens before each text."""

    hashes: np.ndarray
    first: np.ndarray


def tokens(texts: list[str | None]) -> Tokens:
    """Words with A-Z lower-cased, and one end for each text; a null text is an end alone."""
    cut = words.split(texts)
    n = len(texts)
    first = cut.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = cut.hashes()
    return Tokens(out, first)


@dataclass
class Known:
    """Sorted fingerprints of the words that every task knows, their counts and classes. Any other word is of
    class ``rare``, the last one."""

    words: np.ndarray
    n: np.ndarray
    kind: np.ndarray
    rare: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place, and whether it is known."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.rare)
        at, hit = self.find(hashes)
        return np.where(hit, self.kind[at], self.rare)


#: Kinds of features of a context.
KINDS = 4


def _before(t: Tokens, k: int, values: np.ndarray, outside) -> np.ndarray:
    """For every token the value of the one ``k`` places before it in its text, or ``outside``."""
    out = np.full(len(values), outside, values.dtype)
    out[k:] = values[:-k]
    starts = t.first[:-1]
    for d in range(k):
        out[starts[np.diff(t.first) > d] + d] = outside
    return out


def context_features(t: Tokens, bits: int) -> list[np.ndarray]:
    """For every token: its hashed features, one array for each kind."""
    one, two, three = (_before(t, k, t.hashes, BEFORE) for k in (1, 2, 3))
    shift = np.uint64(64 - bits)
    kinds = [one * np.uint64(3), words.mix(two * np.uint64(5) + one), two * np.uint64(7), three * np.uint64(11)]
    return [(words.mix(k) >> shift).astype(np.int32) for k in kinds]


def _shares(features: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probability of every class after each context. Weights are logs of ratios of counts, so they need no shift."""
    s = weights.take(features[0], axis=0)
    for f in features[1:]:
        s += weights.take(f, axis=0)
    s += bias
    np.exp(s, out=s)
    s /= (s @ np.ones(s.shape[1], s.dtype))[:, None]
    return s


def neighbours(texts: list[str | None], out: np.ndarray, anchors: np.ndarray, reach: int) -> None:
    """Adds to a flat matrix how often each anchor (sorted fingerprints) is followed by each within ``reach`` words."""
    t, m = tokens(texts), len(anchors)
    at = np.minimum(np.searchsorted(anchors, t.hashes), m - 1)
    at = np.where(anchors[at] == t.hashes, at, -1)
    for k in range(1, reach + 1):
        other = _before(t, k, at, -1)
        both = (at >= 0) & (other >= 0)
        out += np.bincount(other[both] * m + at[both], minlength=m * m)


def group_anchors(pairs: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """A class for every anchor. ``pairs``: the symmetric matrix of :func:`neighbours`; ``n``: counts.

    Rows become positive pointwise information projected on the greatest principal axes. The group with the
    greatest count is cut at the weighted median of its first axis, until there are ``classes`` groups or
    no group can be cut.
    """
    total = max(pairs.sum(), 1.0)
    side = pairs.sum(axis=1) + 1e-9
    information = np.log((pairs * total + 1e-9) / np.outer(side, side)).clip(0)
    value, axis = np.linalg.eigh(information)
    top = np.argsort(-np.abs(value))[:classes]
    place = axis[:, top] * np.sqrt(np.abs(value[top]))
    kind = np.zeros(len(n), np.int64)
    whole: set[int] = set()
    while (made := int(kind.max(initial=0)) + 1) < classes:
        weight = np.bincount(kind, n, made)
        weight[list(whole)] = -1
        heavy = int(weight.argmax())
        if weight[heavy] < 0:
            break
        rows = np.flatnonzero(kind == heavy)
        if len(rows) < 2:
            whole.add(heavy)
            continue
        own = place[rows] - np.average(place[rows], axis=0, weights=n[rows])
        along = own @ np.linalg.svd(own * np.sqrt(n[rows])[:, None], full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        # the widest gap between neighbours on the axis that leaves a fifth of the weight on each side
        share = np.cumsum(n[rows][order])[:-1] / n[rows].sum()
        gap = np.diff(along[order]) * ((share >= 0.2) & (share <= 0.8))
        cut = int(gap.argmax()) if gap.max() > 0 else int(np.abs(share - 0.5).argmin())
        kind[rows[order[cut + 1 :]]] = made
    return kind


def votes(texts: list[str | None], out: np.ndarray, known: Known, company: np.ndarray, reach: int) -> None:
    """Adds for each known word and class in how many of its occurrences the anchors around speak for the class.

    ``known.kind`` is the class of anchors and ``known.rare`` for all others; ``company``: log probability
    of a neighbour's class given the own class, a row for each neighbour's class, zeros in the last.
    """
    t = tokens(texts)
    classes = company.shape[1]
    at, hit = known.find(t.hashes)
    kind = np.where(hit, known.kind[at], known.rare)
    todo = np.flatnonzero(hit & (kind == known.rare))
    owner = np.repeat(np.arange(len(texts)), np.diff(t.first))[todo]
    low, high = np.maximum(todo - reach, t.first[owner]), np.minimum(todo + reach + 1, t.first[owner + 1])
    vote = np.empty(len(todo), np.int64)
    for lo in range(0, len(todo), 1 << 13):  # a bounded part of a very long text at a time
        part = slice(lo, lo + (1 << 13))
        base, end = low[part].min(), high[part].max()
        total = np.zeros((end - base + 1, classes))
        np.cumsum(company.take(kind[base:end], axis=0), axis=0, out=total[1:])
        # sums of differences are rounded, so that the same neighbours give the same vote at any place
        vote[part] = (total.take(high[part] - base, axis=0) - total.take(low[part] - base, axis=0)).round(6).argmax(axis=1)
    place, n = np.unique(at[todo] * classes + vote, return_counts=True)
    out[place] += n


def observed(texts: list[str | None], out: np.ndarray, known: Known, bits: int) -> None:
    """Adds to a flat table how often each feature comes before each class."""
    t = tokens(texts)
    kind, classes = known.classes(t.hashes), known.rare + 1
    out += np.bincount(np.concatenate([f * np.int64(classes) + kind for f in context_features(t, bits)]), minlength=len(out))


def expected(texts: list[str | None], out: np.ndarray, weights: np.ndarray, bias: np.ndarray, bits: int) -> None:
    """Adds the same as the model foresees it."""
    t = tokens(texts)
    features = context_features(t, bits)
    table = out.reshape(weights.shape)
    for lo in range(0, len(t.hashes), 1 << 16):
        part = [f[lo : lo + (1 << 16)] for f in features]
        share = _shares(part, weights, bias)
        for f in part:
            order = np.argsort(f.astype(np.uint16) if bits <= 16 else f, kind="stable")
            own = f.take(order)
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            table[own[edge]] += np.add.reduceat(share.take(order, axis=0), edge, axis=0)


def start_weights(seen: np.ndarray, bias: np.ndarray, prior: float, kinds: int = KINDS) -> np.ndarray:
    """Each feature's own log odds against the shares of the classes, divided among the kinds of features."""
    share = np.exp(bias)
    rate = (seen + prior * share) / (seen.sum(axis=1, keepdims=True) + prior)
    return (np.log(rate / share) * (1.5 / kinds)).astype(np.float32)


def step(weights: np.ndarray, seen: np.ndarray, foreseen: np.ndarray, bias: np.ndarray, prior: float, kinds: int = KINDS) -> np.ndarray:
    """A gradient step, seen less foreseen, each entry scaled by what is foreseen and the prior."""
    share = np.exp(bias)
    change = (seen - foreseen) / (np.maximum(seen, foreseen) + prior * share + 0.5)
    return (weights + change * (1.5 / kinds)).astype(np.float32)


@dataclass
class MaxentModel:
    """``known``: words with counts and classes; ``weights``: features x classes; ``bias``: log share of each
    class; ``total``: log10 of each class's denominator."""

    settings: Settings
    bits: int
    known: Known
    weights: np.ndarray
    bias: np.ndarray
    total: np.ndarray
    train_tokens: int
    distinct: int


def _partition_counts(texts: DataFrame) -> DataFrame:
    """Word counts, summed in each task before they are shuffled: ``word``, ``n``."""

    def each(batches):
        found: dict[str, list[np.ndarray]] = {"word": [], "n": []}
        size = 0

        def flush():
            word, n = np.concatenate(found["word"]), np.concatenate(found["n"])
            own, at = np.unique(word, return_inverse=True)
            return own, np.bincount(at, n).astype(np.int64)

        for batch in batches:
            values = batch.column(0).to_pylist()
            for lo, hi in steps(values):
                own, n = np.unique(tokens(values[lo:hi]).hashes, return_counts=True)
                found["word"].append(own)
                found["n"].append(n)
                size += len(own)
                if size > 1 << 20:
                    own, n = flush()
                    if len(own) > 1 << 19:  # mostly new words: hand them on, the shuffle adds them up
                        yield pa.RecordBatch.from_pydict({"word": own.view(np.int64), "n": n})
                        own, n = own[:0], n[:0]
                    found["word"], found["n"], size = [own], [n], len(own)
        if found["word"]:
            own, n = flush()
            yield pa.RecordBatch.from_pydict({"word": own.view(np.int64), "n": n})

    return texts.select("text").mapInArrow(each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> tuple[MaxentModel, DataFrame]:
    """The model, and the table of exact counts (``word``, ``n``) of all tokens of ``docs``.

    Null and empty texts are an end alone, repeated rows count as often as they occur, ids play no part, and
    other columns are left behind. Without any rows the model gives every new word the share of the unigrams.
    """
    texts = pick(docs, id_column, text_column).select("text")
    counts = materialise(_partition_counts(texts), "lm-counts")
    all_tokens, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    bits, classes = sizes(all_tokens, distinct, settings)
    known = _known(counts, settings.frequent, classes)
    known = _learn_classes(texts, known, settings)
    n, v = np.bincount(known.kind, known.n, classes + 1), np.bincount(known.kind, minlength=classes + 1).astype(float)
    n[classes], v[classes] = all_tokens - n.sum(), distinct - v.sum() + 1  # one for all new words
    weight = n + 0.5 * v
    bias = np.log(np.maximum(weight / weight.sum(), 1e-12))
    size = (classes + 1) << bits
    seen = _total(texts, lambda t, out: observed(t, out, known, bits), size).reshape(-1, classes + 1)
    weights = start_weights(seen, bias, settings.prior)
    for _ in range(settings.rounds):
        now, level = weights, bias.astype(np.float32)
        foreseen = _total(texts, lambda t, out: expected(t, out, now, level, bits), size, np.float32)
        weights = step(weights, seen, foreseen.reshape(seen.shape), bias, settings.prior)
    return MaxentModel(settings, bits, known, weights, bias, np.log10(np.maximum(weight, 0.5)), all_tokens, distinct), counts


#: Entries of a table that travel together; their places in a slice take two bytes.
_SLICE = 1 << 15
#: Characters of a step of these passes, which pay for the size of their table in each.
_PASS_CHARS = 1 << 22


def _pack(k: int, values: np.ndarray, kind: type) -> dict[str, pa.Array]:
    """A slice as the places and values of what is not zero; no places if nothing is."""
    at = np.flatnonzero(values)
    places = b"" if len(at) == len(values) else at.astype(np.uint16).tobytes()
    return {
        "slice": pa.array([k], pa.int32()),
        "at": pa.array([places], pa.binary()),
        "value": pa.array([values[at].astype(kind).tobytes()], pa.binary()),
    }


def _unpack(into: np.ndarray, at: bytes, value: bytes, kind: type) -> None:
    values = np.frombuffer(value, kind)
    if at:
        into[np.frombuffer(at, np.uint16)] += values
    else:
        into[: len(values)] += values


def _total(texts: DataFrame, add: Callable[[list[str | None], np.ndarray], None], size: int, kind: type = np.int64) -> np.ndarray:
    """The sum over all rows of what ``add(texts, table)`` adds to a flat table.

    Each task hands on its table in slices without zeros. They are summed in two steps of a slice and a
    part, so that no group holds more than about the square root of the tasks.
    """

    def each(batches):
        out, some = np.zeros(size), False
        for batch in batches:
            values = batch.column(0).to_pylist()
            for lo, hi in steps(values, _PASS_CHARS):
                add(values[lo:hi], out)
                some = True
        for k in range(0, size if some else 0, _SLICE):
            if out[k : k + _SLICE].any():
                yield pa.RecordBatch.from_pydict(_pack(k // _SLICE, out[k : k + _SLICE], kind))

    def merge(rows: pa.Table, into: type) -> pa.Table:
        k = rows.column("slice")[0].as_py()
        total = np.zeros(min(_SLICE, size - k * _SLICE))
        for at, value in zip(rows.column("at"), rows.column("value")):
            _unpack(total, at.as_py(), value.as_py(), kind)
        return pa.table(_pack(k, total, into))

    schema = "slice int, at binary, value binary"
    parts = texts.mapInArrow(each, schema).withColumn("part", F.spark_partition_id() % max(isqrt(texts.rdd.getNumPartitions()), 1))
    halves = parts.groupBy("slice", "part").applyInArrow(lambda key, rows: merge(rows, kind), schema)
    out = np.zeros(size)
    for r in halves.groupBy("slice").applyInArrow(lambda key, rows: merge(rows, kind), schema).toLocalIterator():
        k = r["slice"] * _SLICE
        _unpack(out[k : k + _SLICE], bytes(r["at"]), bytes(r["value"]), kind)
    return out


def _known(counts: DataFrame, most: int, classes: int) -> Known:
    """The words of at least two occurrences with the greatest counts, at most ``most``, all of the last class yet."""
    top = _frequent(counts.where("n > 1"), most)
    found, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(float)
    order = np.argsort(found)
    return Known(found[order], n[order], np.full(len(found), classes), classes)


def _learn_classes(texts: DataFrame, known: Known, settings: Settings) -> Known:
    """The same words with their learnt classes."""
    if not len(known.words):
        return known
    classes, m = known.rare, min(settings.anchors, len(known.words))
    top = np.sort(np.lexsort((known.words, -known.n))[:m])
    anchors = known.words[top]
    pairs = _total(texts, lambda t, out: neighbours(t, out, anchors, settings.reach), m * m).reshape(m, m)
    pairs = pairs + pairs.T
    kind = known.kind.copy()
    kind[top] = group_anchors(pairs, known.n[top], classes)
    member = np.eye(classes)[kind[top]]
    company = member.T @ pairs @ member + 1
    table = np.vstack([np.log(company / company.sum(axis=0)), np.zeros(classes)])
    first = Known(known.words, known.n, kind, classes)
    found = _total(texts, lambda t, out: votes(t, out, first, table, settings.reach), len(kind) * classes)
    chosen = found.reshape(len(kind), classes).argmax(axis=1)
    return Known(known.words, known.n, np.where(kind == classes, chosen, kind), classes)


def _frequent(counts: DataFrame, most: int) -> pa.Table:
    """The words with the greatest counts, at most ``most``: all above a count that a histogram gives."""
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(level.alias("level")).count().collect()  # a few hundred levels
    total, least = 0, 10**6
    for r in sorted(histogram, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(level >= least).toArrow()


def score(
    docs: DataFrame, model: MaxentModel, counts: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row of ``docs``.

    ``base_score`` is the unigram log10 probability with one half added to every count; ``score``
    is the model's: both are over the words of the corpus and one event for every new word. A null or empty text is its end alone. Repeated rows and null ids are scored
    row by row. The counts of the most frequent words, a bounded number, go to every task; the rare
    words of a text are looked up by a join on the word, where none can be hot, and summed by row.
    An empty table gives no rows; other columns are left behind.
    """
    known, bits = model.known, model.bits
    denominator = np.log10(model.train_tokens + 0.5 * (model.distinct + 1))
    weights, bias = model.weights, model.bias.astype(np.float32)

    def each(ids, texts):
        t = tokens(texts)
        at, hit = known.find(t.hashes)
        kind = known.classes(t.hashes)
        features = context_features(t, bits)
        logp = np.empty(len(kind))
        for lo in range(0, len(kind), 1 << 16):
            s = _shares([f[lo : lo + (1 << 16)] for f in features], weights, bias)
            logp[lo : lo + len(s)] = np.log10(np.maximum(s[np.arange(len(s)), kind[lo : lo + len(s)]], 1e-30))
        logp -= model.total[kind]
        share = np.where(hit, np.log10(known.n[at] + 0.5), 0.0) if len(known.words) else np.zeros(len(hit))
        total = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every text has a token
        rare, owner = t.hashes[~hit], np.repeat(np.arange(len(texts)), np.diff(t.first))[~hit]
        split = np.searchsorted(owner, np.arange(len(texts) + 1))
        offsets = pa.array(split.astype(np.int32))
        return {
            "doc_id": ids,
            "n_tokens": np.diff(t.first),
            "n_hit": total(hit.astype(np.int64)),
            "share": total(share),
            "context": total(logp),
            "rare": pa.ListArray.from_arrays(offsets, pa.array(rare.view(np.int64))),
        }

    schema = "doc_id, n_tokens long, n_hit long, share double, context double, rare array<long>"
    rows = map_texts(pick(docs, id_column, text_column), schema, each)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    found = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_share")
    )
    share = F.col("share") + F.coalesce("rare_share", F.lit(0.0))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_hit") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (share - F.col("n_tokens") * F.lit(float(denominator))).alias("base_score"),
        (share + F.col("context")).alias("score"),
    )
