"""Personal data by weak supervision.

Patterns propose spans. Labelers vote on each: its own pattern's strict form, gazetteers, the words
before it, and how it sits in the text. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without any labels; the resulting probabilities train a
logistic span classifier. Spans of the base patterns always stay; proposed ones stay if the
classifier says so.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.llm.frames import map_texts, pick, steps

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone", "handle", "person")
LABELERS = ("form", "gazetteer", "context", "boundary")
YES, NO, SILENT = 1, 0, -1

# The base patterns. Look-behinds and possessive runs only avoid repeated scans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGIT = re.compile("[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of what may be personal data.
_PROPOSED = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9A-Za-z-])"),
    "handle": re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@]|\.[A-Za-z0-9])"),
}
_TITLE = re.compile(
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|[Nn]ame|[Nn]amed|[Nn]ombre|[Nn]om|[Cc]ontact|[Kk]ontakt)"
    r"\b[.:]?\x20((?:[^\W\d_]+[\x20'-]){0,2}[^\W\d_]+)"
)

#: Words before a span that speak for a kind, in the languages at hand, and words that speak against all.
CONTEXT = {
    "email": "mail email e-mail contact write correo courriel kontakt",
    "ip": "ip address server host client login adresse",
    "card": "card credit visa mastercard payment karte tarjeta carte",
    "phone": "phone tel call mobile fax telefon teléfono téléphone",
    "iban": "iban bank account konto cuenta compte",
    "national_id": "ssn social security id ausweis dni nif",
    "local_phone": "phone tel call mobile fax telefon teléfono téléphone",
    "handle": "twitter follow instagram user",
    "person": "name mr mrs ms dr prof herr frau",
}
AGAINST = "version build order invoice isbn issn page chapter section figure table total price ratio score".split()
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica "
    "thomas sarah charles karen anna maria peter hans klaus ursula jürgen monika jean marie pierre nathalie michel "
    "isabelle josé carmen antonio ana juan laura carlos lucía".split()
)
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ch at it nl".split())
COUNTRY_CODES = ("1", "7", "20", "27", *map(str, range(30, 70)), *map(str, range(81, 99)))
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Characters before a span in which context words count.
REACH = 40


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, found from their @ in linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, kind by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def proposed_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the other patterns that meet none of ``taken`` nor each other."""
    out: list[tuple[str, int, int]] = []
    begins = sorted((a, b) for _, a, b in taken)
    furthest = list(accumulate((b for _, b in begins), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(begins, (end, -1))
        return not before or furthest[before - 1] <= start

    digit, mark = bool(_DIGIT.search(text)), "@" in text
    patterns = [(k, p) for k, p in _PROPOSED.items() if (mark if k == "handle" else digit)]
    found = [(kind, *m.span()) for kind, pattern in patterns for m in pattern.finditer(text)]
    found += [("person", *m.span(1)) for m in _TITLE.finditer(text) if m[1][0].isupper()]
    last = 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= last and free(a, b):
            out.append((kind, a, b))
            last = b
    return out


def _form(kind: str, span: str) -> int:
    """Whether the span meets the strict rules of its kind."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "iban":
        solid = span.replace(" ", "")
        return YES if int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1 else NO
    if kind == "national_id":
        return NO if span[:3] in ("000", "666") or span[0] == "9" or "00" == span[4:6] or span.endswith("0000") else YES
    if kind == "local_phone":
        return YES if 7 <= len(digits) <= 12 and span[0] in "(0" else NO
    if kind == "person":
        return YES if all(w[0].isupper() and w[1:].islower() for w in _WORD.findall(span)) else NO
    if kind == "email":
        return NO if ".." in span or span[0] in ".-" or span.endswith("-") else YES
    if kind == "handle":
        return SILENT
    return YES


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return YES if span.rpartition(".")[2].lower() in DOMAINS else NO
    if kind == "phone":
        return YES if span[1:].startswith(COUNTRY_CODES) else NO
    if kind == "iban":
        return YES if span[:2] in IBAN_COUNTRIES else NO
    if kind == "ip":
        return NO if span.startswith(("0.", "127.", "255.")) else SILENT
    if kind == "card":
        return YES if span[0] in "3456" else NO
    if kind == "person":
        return YES if any(w.lower() in GIVEN_NAMES for w in _WORD.findall(span)) else NO
    return SILENT


_FOR = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
_AGAINST = frozenset(AGAINST)


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What each of ``LABELERS`` says about a span."""
    span = text[start:end]
    before = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start])}
    context = YES if before & _FOR[kind] else NO if before & _AGAINST else SILENT
    left, right = text[start - 1 : start], text[end : end + 1]
    boundary = NO if (left and (left.isalnum() or left in "_/=")) or (right and (right.isalnum() or right in "_/=")) else YES
    return _form(kind, span), _gazetteer(kind, span), context, boundary


def shape(span: str) -> tuple[int, int]:
    """Length and share of digits, in a few steps."""
    return min(len(span).bit_length(), 6), 4 * sum(c.isdigit() for c in span) // len(span)


@dataclass
class SpanModel:
    """``reliability``: for each labeler, class and vote (no, yes, silent) its probability; ``weights`` of the classifier."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def score(self, kinds: np.ndarray, voted: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(kinds, voted, shapes) @ self.weights, -35, 35)))


def _features(kinds: np.ndarray, voted: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One-hot kind, vote of each labeler, length and share of digits, and an intercept."""
    hot = lambda x, n: np.eye(n)[x]
    parts = [hot(kinds, len(KINDS)), *[hot(voted[:, k] + 1, 3) for k in range(len(LABELERS))]]
    return np.hstack([*parts, hot(shapes[:, 0], 7), hot(shapes[:, 1], 5), np.ones((len(kinds), 1))])


def estimate(kinds: np.ndarray, voted: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: reliabilities, share of personal data by kind, posteriors.

    It starts from the majority of the votes. Pseudo-counts say that labelers are right more often
    than not, which keeps the two classes from changing places and gives an answer without data.
    """
    vote = np.where(voted == SILENT, 2, voted)
    yes, no = (voted == YES).sum(1), (voted == NO).sum(1)
    posterior = (yes + 1) / (yes + no + 2)
    trust = np.array([[4.0, 1.0, 2.0], [1.0, 4.0, 2.0]])
    reliability = np.tile(trust / trust.sum(1, keepdims=True), (len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        both = np.stack([1 - posterior, posterior]) * counts
        for k in range(len(LABELERS)):
            seen = np.stack([np.bincount(vote[:, k], both[c], minlength=3) for c in (0, 1)]) + trust
            reliability[k] = seen / seen.sum(1, keepdims=True)
        n = np.bincount(kinds, counts, minlength=len(KINDS))
        prior = (np.bincount(kinds, both[1], minlength=len(KINDS)) + 1) / (n + 2)
        log = np.log(np.stack([1 - prior[kinds], prior[kinds]]))
        for k in range(len(LABELERS)):
            log = log + np.log(reliability[k][:, vote[:, k]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved = np.abs(new - posterior).max(initial=0)
        posterior = new
        if moved < 1e-6:
            break
    return reliability, prior, posterior


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression on probabilities, by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -35, 35)))
        gradient = features.T @ (counts * (p - target)) + l2 * w
        hessian = (features * (counts * p * (1 - p))[:, None]).T @ features + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _judged(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """All candidate spans of a text with kind, votes and shape as one row of small numbers."""
    base = base_spans(text)
    return [
        (kind, a, b, (KINDS.index(kind), *votes(text, kind, a, b), *shape(text[a:b])))
        for kind, a, b in base + proposed_spans(text, base)
    ]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> SpanModel:
    """Reliabilities and classifier from the candidates of all rows of ``docs``.

    Only counts of vote patterns leave the tasks: their number is bounded by kinds, votes and shapes
    (under 26,000), however many rows there are. A table without candidates gives a model whose
    classifier says one half to everything.
    """
    names = ["kind", *LABELERS, "length", "digits"]

    def each(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in steps(texts):
                rows = [row for t in texts[lo:hi] if t for *_, row in _judged(t)]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int32()) for k, n in enumerate(names)})

    text = pick(docs, id_column, text_column).select("text")
    found = text.mapInArrow(each, ", ".join(f"{n} int" for n in names)).groupBy(*names).count().toPandas()
    found = found.sort_values(names)
    kinds, voted, shapes = found["kind"].to_numpy(int), found[list(LABELERS)].to_numpy(int), found[["length", "digits"]].to_numpy(int)
    counts = found["count"].to_numpy(float)
    reliability, prior, posterior = estimate(kinds, voted, counts)
    return SpanModel(reliability, prior, fit_classifier(_features(kinds, voted, shapes), posterior, counts))


def find(text: str, model: SpanModel, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Spans of personal data by kind, then start: all base spans, and the others above ``threshold``."""
    rows = _judged(text)
    if not rows:
        return []
    numbers = np.array([row for *_, row in rows])
    n = 1 + len(LABELERS)
    scores = model.score(numbers[:, 0], numbers[:, 1:n], numbers[:, n:])
    kept = [(k, a, b, float(p)) for (k, a, b, _), p in zip(rows, scores, strict=True) if k in BASE or p > threshold]
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


def detect(docs: DataFrame, model: SpanModel, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end, score), for every row of ``docs``.

    Positions are code points, end exclusive, by kind as in ``KINDS``, then start. A null or empty
    text has an empty array. Rows are judged one by one, so repeated rows and null ids stay.
    """

    def each(ids, texts):
        rows = [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in (find(t, model, threshold) if t else [])] for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return {"doc_id": ids, "spans": pa.array(rows, kind)}

    schema = "doc_id, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return map_texts(pick(docs, id_column, text_column), schema, each)


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; spans that meet are replaced as one, by the kind of the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(model: SpanModel, text_column: str | Column = "text", threshold: float = 0.5) -> Column:
    """The text column with all spans masked; null stays null."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, find(t, model, threshold)) if t else t)

    return masked(col(text_column) if isinstance(text_column, str) else text_column)
