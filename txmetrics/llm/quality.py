"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters, case kept, and runs of marks, so that shouting and decoration are seen. A
document is scored as a sparse dot product with the weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.llm import words
from txmetrics.llm.frames import map_texts, pick, steps
from txmetrics.llm.ftrl import Settings, train_logistic

BITS = 18
_MARKS = re.compile(r"([^\w\s]+)")


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float


def rows_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed uni- and bigrams of each text with damped counts of length one; an empty text has none."""
    cut = words.split([_MARKS.sub(r" \1 ", t) if t else "" for t in texts], lower=False)
    one = cut.hashes()
    two = words.join_hashes(one, 2)
    shift = np.uint64(64 - BITS)
    out = []
    for a, b in zip(cut.first[:-1], cut.first[1:], strict=True):
        if a == b:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        index, n = np.unique(np.concatenate([one[a:b], two[a : b - 1]]) >> shift, return_counts=True)
        value = 1 + np.log(n)
        out.append((index.astype(np.int64), value / np.sqrt(value @ value)))
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_label: int = 2_500,
    settings: Settings = Settings(alpha=1.0, l1=0.002, l2=0.01, epochs=5),
) -> QualityModel:
    """Fit on the texts of ``docs`` whose id has label 0 or 1 in ``labels``; other labels are left out.

    ``rows_per_label`` bounds the rows: about so many of each label are drawn by a hash of their
    ids, and only then are their whole texts fetched, so the texts of all others stay where they
    are. The ids drawn are bounded by the same number, repeats counting once. The intercept
    restores the share of label 1 among all labelled ids. Without rows of both labels the model
    scores every text by that share alone.
    """
    marks = labels.select(col(id_column).alias("doc_id"), col(label).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    share = (n1 + 1) / (n0 + n1 + 2)
    prior = float(np.log(share / (1 - share)))
    if not (n0 and n1):
        return QualityModel(np.zeros(1 << BITS), prior)
    rates = {k: min(1.0, 0.9 * rows_per_label / n) for k, n in sizes.items()}
    drawn = marks.where(
        F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
        < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    )
    texts = pick(docs, id_column, text_column)
    found = _collect_rows(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label"))
    if len({y for y, _, _ in found}) < 2:
        return QualityModel(np.zeros(1 << BITS), prior)
    y = np.array([y for y, _, _ in found])
    # one feature more is the intercept
    x = [(np.append(index, 1 << BITS), np.append(value, 1.0)) for _, index, value in found]
    weights = train_logistic(x, y, (1 << BITS) + 1, settings)
    drawn_odds = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return QualityModel(weights[:-1], float(weights[-1] + prior - drawn_odds))


def _collect_rows(drawn: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    def each(batches):
        for batch in batches:
            ids, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in steps(texts):
                rows = rows_of(texts[lo:hi])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([str(x) for x in ids[lo:hi]], pa.string()),
                        "label": pa.array(labels[lo:hi], pa.int32()),
                        "feature": pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                        "value": pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()),
                    }
                )

    found = drawn.mapInArrow(each, "key string, label int, feature binary, value binary").distinct().collect()
    found.sort(key=lambda r: (r["key"], bytes(r["feature"])))
    return [
        (r["label"], np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64))
        for r in found
    ]


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (the probability of label 1) of every row of ``docs``.

    A null or empty text has no features and gets the model's intercept alone. Rows are scored one by
    one and whole, so repeated rows, null ids and very long texts need no rule of their own; an empty
    table gives no rows. Other columns are not read.
    """

    def each(ids, texts):
        scores = [float(value @ model.weights[index]) + model.bias for index, value in rows_of(texts)]
        p = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
        return {"doc_id": ids, "score": pa.array(p, pa.float64())}

    return map_texts(pick(docs, id_column, text_column), "doc_id, score double", each)
