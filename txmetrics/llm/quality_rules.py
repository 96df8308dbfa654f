"""Quality rules as a short-circuit cascade, in built-in column functions only.

A rule is a condition under which a document is rejected. The cost and the selectivity of each are
estimated on a sample; the rules then run in the order of rejections per unit of cost, and a rule
is evaluated only for documents that all earlier ones let through. The order changes which rule is
named as the reason and how long it takes, never whether a document is kept.
"""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col

BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Tasks in which the sample is timed, however many partitions the table has.
SAMPLE_PARTS = 8
LEAST_SECONDS = 1 / 64


@dataclass(frozen=True)
class Rule:
    """``rejects`` names the documents to drop, over the columns of ``text_counts`` and the text."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """The production rules. Each says with wide margins that a text is not running prose."""
    n, text = F.col("n_words"), col(text)
    return [
        Rule("few_words", n < 20),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.size(F.split(text, "\n"))),
        Rule("capitals", 2 * _count(text, "[A-Z]") > F.col("word_chars")),
        Rule("exclamations", 10 * _count(text, "!") > n),
    ]


def text_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    A word is a run of characters other than space and U+0009 to U+000D. A null text counts as
    empty. Columns of these names in ``docs`` are replaced. Repeated windows are looked for by
    hashes first; only texts in which two hashes meet compare the windows themselves.
    """
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK[1:-1]}]"))
    held, made, found = F.col("__words"), F.col("__lines"), F.col("__windows")
    hashes = _windows(F.transform(held, lambda w: F.xxhash64(w)), lambda a, b: F.xxhash64(a, b))
    return (
        docs.withColumns({"__words": F.array_remove(F.split(text, f"{BLANK}+"), ""), "__lines": lines})
        .withColumns(
            {
                "n_words": F.size(held).cast("long"),
                "word_chars": F.length(F.array_join(held, "")).cast("long"),
                "n_symbols": _count(text, SYMBOLS),
                "n_dup_lines": (F.size(made) - F.size(F.array_distinct(made))).cast("long"),
                "__windows": F.when(F.size(held) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
            }
        )
        .withColumn(
            "n_repeat_words",
            F.when(F.size(found) == F.size(F.array_distinct(found)), F.lit(0)).otherwise(_repeated_words(held)).cast("long"),
        )
        .drop("__words", "__lines", "__windows")
    )


def _count(text: Column, kind: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, kind, ""))).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _windows(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The eight items from every position on, joined: pairs, then pairs of pairs, then of those.

    Arrays are shifted as a whole; taking a slice inside a lambda would copy the array each time.
    """

    def doubled(items: Column, step: int) -> Column:
        size = F.greatest(F.size(items) - step, F.lit(0))
        return F.zip_with(F.slice(items, F.lit(1), size), F.slice(items, F.lit(1 + step), size), join)

    return _let(_let(_let(items, lambda x: doubled(x, 1)), lambda x: doubled(x, 2)), lambda x: doubled(x, 4))


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    The windows are sorted; those equal to a neighbour are the repeated ones. Their starts in order
    give the covered words: each adds as many as lie before the next start, at most a window.
    """
    texts = _windows(words, lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.sort_array(F.transform(texts, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.aggregate(
        F.sort_array(F.filter(_let(windows, _beside_equals), lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def _beside_equals(windows: Column) -> Column:
    """Starts of the sorted ``windows`` that equal a neighbour, null for the others."""
    none = F.array(F.lit(None).cast("struct<w:string,i:int>"))
    marked = F.zip_with(
        windows,
        F.slice(F.concat(none, windows), F.lit(1), F.size(windows)),
        lambda a, b: F.struct(a["i"].alias("i"), a["w"].alias("w"), a["w"].eqNullSafe(b["w"]).alias("same")),
    )
    after = F.slice(F.concat(windows, none), F.lit(2), F.size(windows))
    return F.zip_with(marked, after, lambda a, b: F.when(a["same"] | a["w"].eqNullSafe(b["w"]), a["i"]))


def plan_cascade(
    sample: DataFrame, rules: list[Rule], counts: Callable[[DataFrame], DataFrame] = lambda df: df, runs: int = 3
) -> list[Rule]:
    """``rules`` by rejections per unit of cost over ``sample``.

    ``counts`` adds the columns that the rules use. Each rule is timed alone over the sample as it was before, so what
    it pays for is its condition with those counts that it needs, and no others. Its cost is the median of ``runs``
    timings after one to warm up, in steps of a factor of two, so that a timer's noise seldom decides.
    Rules of equal merit, and all rules over an empty sample, stay in the given order.
    """
    sample = sample.repartition(SAMPLE_PARTS).persist()
    try:
        rejections = [F.count_if(F.coalesce(r.rejects, F.lit(False))) for r in rules]
        rejected = counts(sample).select(F.count("*"), *rejections).first()[1:]
        idle = _seconds(sample, F.lit(False), runs)
        cost = [_steps(_seconds(counts(sample), rule.rejects, runs) - idle) if n else 1.0 for rule, n in zip(rules, rejected, strict=True)]
    finally:
        sample.unpersist()
    merit = [n / c for n, c in zip(rejected, cost, strict=True)]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -merit[k])]


def _steps(seconds: float) -> float:
    """The nearest power of two, at least ``LEAST_SECONDS``, below which there is only noise."""
    return 2.0 ** round(math.log2(max(seconds, LEAST_SECONDS)))


def _seconds(df: DataFrame, condition: Column, runs: int) -> float:
    query = df.select(F.count_if(condition))
    query.first()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        query.first()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken)


def cascade(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``failed_rule``: the first rule of ``rules`` that rejects the row, or null.

    A rule whose condition is null rejects nothing. Later rules are not evaluated for a row that
    an earlier one has rejected.
    """
    if not rules:
        return counted.withColumn("failed_rule", F.lit(None).cast("string"))
    chain = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return counted.withColumn("failed_rule", chain)


def apply_rules(
    docs: DataFrame, rules: list[Rule] | None = None, text_column: str = "text", sample_rows: int = 2_000
) -> DataFrame:
    """All rows of ``docs`` with the counts of ``text_counts`` and ``failed_rule``.

    Null, empty and very long texts are counted like all others; an empty table gives an empty
    result; repeated rows are judged one by one. Rules are ordered on a sample of about ``sample_rows`` rows, then
    applied to all. All counts are returned, so all are made for every row; the order decides which conditions run.
    """
    rules = default_rules(text_column) if rules is None else rules
    total = docs.select(F.count("*")).first()[0]
    sample = docs.sample(fraction=min(1.0, sample_rows / total), seed=17) if total else docs
    ordered = plan_cascade(sample, rules, lambda df: text_counts(df, text_column))
    return cascade(text_counts(docs, text_column), ordered)
