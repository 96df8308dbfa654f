"""Registered queries of the operators over ``documents``, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmetrics.llm import (
    decontamination,
    divergence,
    language_id,
    maxent_lm,
    near_dedup,
    passages,
    pii,
    quality,
    quality_rules,
    secret_scan,
    sentencepieces,
    token_counts,
    whitening,
)
from txmetrics.llm.frames import fold
from txmetrics.sinks.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the other four folds of five."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from the labels of two folds of three."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur in more than one document, for all documents."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", "n_words")


OP3_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents WHERE text IS NOT NULL
), windows AS MATERIALIZED (
    SELECT doc_id, i, list_aggregate(words[i + 1:i + 50], 'string_agg', ' ') AS passage
    FROM d, unnest(range(len(words) - 49)) AS u(i)
), shared AS (
    SELECT passage FROM windows GROUP BY passage HAVING count(DISTINCT doc_id) > 1
), begun AS (
    SELECT doc_id, i, i >= coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, 0) AS begins
    FROM (SELECT DISTINCT doc_id, i FROM windows JOIN shared USING (passage))
), numbered AS (
    SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM begun
)
SELECT doc_id, min(i)::INT AS start_word, (max(i) + 50)::INT AS end_word, (max(i) + 50 - min(i))::INT AS n_words
FROM numbered GROUP BY doc_id, n
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts, a digest of the base spans, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_of_kind("secrets", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.filter("secrets", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rules and the verdict of the cascade for every document."""
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    n = F.col("n_words")
    return judged.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        ((n < 20) | (100 * F.col("n_repeat_words") > 30 * n)).alias("base_failed"),
        F.col("failed_rule").isNull().alias("kept"),
    )


OP5_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), windows AS (
    SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS words8
    FROM w, unnest(range(1, len(words) - 6)) AS u(i)
), repeated AS (
    SELECT r, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY r, words8) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM repeated, unnest(range(8)) AS u(k) GROUP BY r
), counts AS (
    SELECT doc_id, text, len(words)::BIGINT AS n_words,
        length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len(string_split(text, chr(10))) AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
        length(regexp_replace(text, '[^!]', '', 'g')) AS exclamations,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, coalesce(chars, 0)::BIGINT AS word_chars,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
        OR 100 * n_dup_lines > 30 * n_lines OR 2 * capitals > word_chars OR 10 * exclamations > n_words) AS kept
FROM judged
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document at a similarity of 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(percent=85))


#: Lower-cased words of every row of a table, as SQL.
WORDS_SQL = r"""
    SELECT row_number() OVER () AS r, {id},
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words
    FROM {table}
"""
#: Their distinct shingles; fewer than five words are one shingle.
SHINGLES_SQL = """
    SELECT DISTINCT r, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS shingle
    FROM {words}, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0
"""

OP6_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED ({WORDS_SQL.format(id="doc_id", table="documents")}),
s AS MATERIALIZED ({SHINGLES_SQL.format(words="d")}),
sets AS MATERIALIZED (
    SELECT r, count(*) AS n, string_agg(shingle, '|' ORDER BY shingle) AS whole FROM s GROUP BY r
), classes AS MATERIALIZED (
    SELECT whole, min(n) AS n, min(r) AS r, min(doc_id) AS node FROM sets JOIN d USING (r) GROUP BY whole
), parts AS MATERIALIZED (
    SELECT r AS c, n, shingle FROM classes JOIN s USING (r)
), held AS MATERIALIZED (
    SELECT DISTINCT doc_id, classes.r AS c FROM d JOIN sets ON sets.r = d.r JOIN classes ON classes.whole = sets.whole
), links AS MATERIALIZED (
    SELECT a.c AS x, b.c AS y FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.c <> b.c
    WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    UNION SELECT a.c, b.c FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.c <> b.c
), reach AS (
    SELECT r AS c, r AS other FROM classes
    UNION
    SELECT reach.c, links.y FROM reach JOIN links ON reach.other = links.x
), named AS (
    SELECT reach.c, min(node) AS component FROM reach JOIN classes ON other = r GROUP BY reach.c
)
SELECT doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id,
    doc_id = coalesce(component, doc_id) AS kept
FROM d LEFT JOIN sets ON sets.r = d.r LEFT JOIN classes ON classes.whole = sets.whole LEFT JOIN named ON classes.r = named.c
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains, for all documents."""
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = f"""
WITH d AS MATERIALIZED ({WORDS_SQL.format(id="doc_id", table="documents")}),
b AS MATERIALIZED ({WORDS_SQL.format(id="item_id", table="(SELECT DISTINCT item_id, text FROM benchmark)")}),
item AS MATERIALIZED (
    SELECT r, item_id, len(s.words) AS k, shingle
    FROM b s JOIN ({SHINGLES_SQL.format(words="b")}) USING (r)
), size AS (
    SELECT r, count(*) AS n FROM item GROUP BY r
), length AS (
    SELECT DISTINCT least(k, 5) AS k FROM item
), grams AS MATERIALIZED (
    SELECT DISTINCT d.r, d.doc_id, k, list_aggregate(words[i:i + k - 1], 'string_agg', ' ') AS shingle
    FROM d, length, unnest(range(1, greatest(len(words) - k + 2, 1))) AS u(i)
)
SELECT g.doc_id, item.item_id, count(*)::BIGINT AS shared, size.n::BIGINT AS item_shingles
FROM item JOIN size USING (r) JOIN grams g ON g.shingle = item.shingle AND g.k = least(item.k, 5)
GROUP BY g.r, g.doc_id, item.r, item.item_id, size.n
HAVING 100 * count(*) >= 80 * size.n
"""


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document, learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 1
    model, counts = maxent_lm.train(docs.where(~held_out))
    return maxent_lm.score(docs, model, counts).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts, a digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))
    return found.select(
        "doc_id",
        *[_of_kind("spans", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of a language from the others, and the terms that mark it."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS MATERIALIZED (
    SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS MATERIALIZED (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), grp AS MATERIALIZED (
    SELECT DISTINCT lang, source FROM d
), used AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), filled AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n
    FROM grp g JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), scored AS MATERIALIZED (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p
    FROM filled WINDOW w AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS q
    FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM scored x JOIN scored y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY x.lang, x.source, y.source
    ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), term AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
    FROM scored JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that is new with each run."""
    import public_tokenizers

    cache_path = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality,
        op3_passages,
        op4_secret_scan,
        op5_quality_rules,
        op6_near_duplicates,
        op7_decontamination,
        op8_lm_scores,
        op9_sentencepiece,
        op10_pii,
        op11_whitening,
        op12_source_divergence,
        op13_token_counts,
    )
}
ORACLE = {
    "op3_passages": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op12_source_divergence": OP12_SQL,
}
