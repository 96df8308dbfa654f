"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample per
language; the inverse document frequencies count every document of the training fold. A single
temperature, fitted on a part of the sample that the weights have not seen, calibrates the scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.llm.frames import STEP_CHARS, map_texts, pick, steps
from txmetrics.llm.ftrl import Settings, softmax, train_softmax

#: The label of a text without a letter.
UNDETERMINED = "und"
BITS = 14
ORDERS = (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    """``weights``: features x languages; ``idf``: a factor for each feature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def count_features(text: str) -> np.ndarray:
    """How often each hashed n-gram of 1 to 3 characters occurs in the lower-cased text."""
    total = np.zeros(1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    # a long text is counted in parts that overlap by two characters, so none of its n-grams is lost
    for lo in range(0, len(text), STEP_CHARS):
        part = text[lo : lo + STEP_CHARS + ORDERS[-1] - 1].lower()
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
        last = lo + STEP_CHARS >= len(text)
        gram = np.zeros(len(points), np.uint64)
        for n in ORDERS:
            size = len(points) - n + 1
            if size <= 0:
                break
            gram = gram[:size] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            counted = gram if last else gram[:STEP_CHARS]
            total += np.bincount(((counted * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=1 << BITS)
    return total


def sparse_row(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF values, of length one together."""
    index = np.flatnonzero(counts)
    value = (1 + np.log(counts[index])) * idf[index]
    return index, value / max(np.sqrt(value @ value), 1e-12)


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each feature occurs. One row a feature and task is shuffled."""

    def each(batches):
        seen, docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs += 1
                if text:
                    seen += count_features(text) > 0
        feature = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(feature, -1), "n": np.append(seen[feature], docs)})

    found = texts.select("text").mapInArrow(each, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = {r["feature"]: r["n"] for r in found.collect()}  # at most 2^14 + 1 rows
    total = rows.pop(-1, 0)
    out = np.zeros(1 << BITS)
    out[list(rows)] = list(rows.values())
    return total, out


def train(
    docs: DataFrame,
    language: str = "lang",
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_language: int = 1_500,
    settings: Settings = Settings(),
    max_languages: int = 500,
) -> LanguageModel:
    """Fit on the rows of ``docs``; those with a null language only count in the document frequencies.

    ``rows_per_language`` bounds the labelled rows, drawn by a hash of their ids: about so many of
    each language, whole texts. More than ``max_languages`` is an error, since the model's size
    grows with them. Without any labelled text that has a letter the model knows no language.
    Rows that share an id, also a null one, are drawn together or not at all: a language above the
    bound whose rows all have null ids may contribute all of them or none.
    """
    texts = docs.select(col(id_column).alias("doc_id"), col(text_column).alias("text"), col(language).alias("label"))
    labelled = texts.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    total, seen = _document_frequencies(texts)
    idf = np.log((1 + total) / (1 + seen)) + 1
    languages = sorted(sizes)
    # a little under the bound, since a draw by hash gives so many rows only on average
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 0.9 * rows_per_language / sizes[lang]))])
    drawn = labelled.where(_uniform(F.col("doc_id")) < rate[F.col("label")]) if languages else labelled.limit(0)
    rows = _rows(drawn, idf)
    if not rows:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), 1.0)
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[label] for label, _, _ in rows])
    x = [(index, value) for _, index, value in rows]
    aside = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    weights = train_softmax([r for r, a in zip(x, aside, strict=True) if not a], y[~aside], 1 << BITS, len(languages), settings)
    temperature = 1.0
    if aside.any():
        scores = np.array([value @ weights[index] for (index, value), a in zip(x, aside, strict=True) if a])
        temperature = fit_temperature(scores, y[aside])
    return LanguageModel(languages, idf, weights, temperature)


def _uniform(key: Column) -> Column:
    """A value in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)


def _rows(drawn: DataFrame, idf: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Label, features and values of the drawn texts, in an order that does not depend on the run."""

    def each(batches):
        for batch in batches:
            ids, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in steps(texts):
                rows = [sparse_row(count_features(t), idf) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([str(x) for x in ids[lo:hi]], pa.string()),
                        "label": pa.array(labels[lo:hi], pa.string()),
                        "feature": pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                        "value": pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()),
                    }
                )

    found = drawn.mapInArrow(each, "key string, label string, feature binary, value binary").distinct().collect()
    found.sort(key=lambda r: (r["key"], bytes(r["feature"])))
    return [
        (r["label"], np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64))
        for r in found
    ]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels most probable, by golden-section search on its logarithm.

    One pseudo-error is spread over the rows, so that faultless scores do not become certainties.
    """
    doubt = 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        log_p = np.log(softmax(scores / np.exp(log_t)) + 1e-300)
        return -((1 - doubt) * log_p[np.arange(len(labels)), labels] + doubt * log_p.mean(axis=1)).mean()

    lo, hi, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def guess(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """Language and calibrated score of a text."""
    if not text or not model.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    index, value = sparse_row(count_features(text), model.idf)
    p = softmax(value @ model.weights[index] / model.temperature)
    return model.languages[int(p.argmax())], float(p.max())


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (calibrated, 0 to 1) of every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the model
    knows no language. Equal scores go to the language that comes first in the alphabet. Rows are
    judged one by one and whole, so repeated rows, null ids and very long texts need no rule of their
    own; an empty table gives no rows. Other columns are not read.
    """

    def each(ids, texts):
        found = [guess(t, model) for t in texts]
        return {
            "doc_id": ids,
            "lang_pred": pa.array([x for x, _ in found], pa.string()),
            "score": pa.array([x for _, x in found], pa.float64()),
        }

    return map_texts(pick(docs, id_column, text_column), "doc_id, lang_pred string, score double", each)


def language(model: LanguageModel, text_column: str = "text") -> Column:
    """The same as a column of ``lang_pred`` and ``score``, for use beside other columns.

    Marked as nondeterministic, though it is not, so that a filter on it does not make Spark compute
    it a second time, in a second Python worker beside the first.
    """

    @F.pandas_udf("lang_pred string, score double")
    def found(texts):
        import pandas as pd

        return pd.DataFrame([guess(t, model) for t in texts], columns=["lang_pred", "score"])

    return found.asNondeterministic()(col(text_column).cast("string"))
