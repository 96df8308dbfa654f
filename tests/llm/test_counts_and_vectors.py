import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import LOWER, SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from txmetrics.llm import divergence, queries, token_counts, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# Token counts


def library_count(path, text):
    if path.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_token_counts_of_all_documents(spark, document_rows):
    got = {r["doc_id"]: r for r in queries.op13_token_counts(spark, SF).collect()}
    library = Tokenizer.from_file(BYTES)
    assert len(got) == len(document_rows)
    for i, text in document_rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_token_counts_corner_cases(spark, corner, corner_rows, empty, tmp_path, path):
    cache = str(tmp_path / "cache")
    more = [("x", "ONE"), ("y", "a <|endoftext|> b<|endoftext|>"), ("z", "a <|ENDOFTEXT|> b<|endoftext|>"), (None, "é é")]
    rows = [(str(i) if i is not None else None, t) for i, t in corner_rows] + more
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    want = sorted((str(i), len((t or "").encode()), library_count(path, t or "")) for i, t in rows)
    for _ in range(2):  # without and with the counts of the first run
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(corner, path, cache).count() == len(corner_rows)
    assert token_counts.count_tokens(empty, path, cache).collect() == []
    assert token_counts.count_tokens(empty, path, str(tmp_path / "none")).collect() == []


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    encoded = []
    plain = token_counts._encode
    monkeypatch.setattr(token_counts, "_encode", lambda texts, path: plain(texts, path).where(~_tell(encoded, texts)))

    def frame(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    stored = lambda: spark.read.parquet(cache).count()
    token_counts.count_tokens(frame(["a b", "a b", "c", None, ""]), BYTES, cache).collect()
    assert (stored(), encoded) == (3, [["", "a b", "c"]])
    token_counts.count_tokens(frame(["c", "d", "d", "a b"]), BYTES, cache).collect()
    assert (stored(), encoded[1:]) == (4, [["d"]])
    token_counts.count_tokens(frame(["d", "c"] * 5), BYTES, cache).collect()
    assert (stored(), len(encoded)) == (4, 2)
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    got = token_counts.count_tokens(frame(["e", "e", "c"]), BYTES, cache).collect()
    assert (stored(), encoded[2:], [r["n_tokens"] for r in got]) == (5, [["e"]], [1, 1, 1])
    # another tokenizer has counts of its own
    token_counts.count_tokens(frame(["c"]), WORDS, cache).collect()
    assert stored() == 6 and token_counts.version(BYTES) != token_counts.version(WORDS)


def _tell(encoded, texts):
    from pyspark.sql import functions as F

    encoded.append(sorted(r["text"] for r in texts.select("text").distinct().collect()))
    return F.lit(False)


def test_copies_with_other_spelling_share_a_count_only_if_the_tokenizer_says_so():
    words, plain = token_counts.Counter(WORDS), token_counts.Counter(BYTES)
    assert words.content("A  b") == words.content("a b") != words.content("ab")
    assert words.content("<|endoftext|>") != words.content("<|ENDOFTEXT|>")
    assert plain.normaliser is None


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "STEP_CHARS", 5)
    counter = token_counts.Counter(BYTES)

    @given(st.text(st.sampled_from("ab1 é日'ts\n\t.<|>endoftx🎉"), max_size=80))
    @settings(max_examples=300, deadline=None)
    def same(text):
        assert "".join(counter._parts(text)) == text
        assert counter.count([text, "x"]) == [len(counter.library.encode(text, add_special_tokens=False).ids), 1]

    same()
    assert len(list(counter._parts("ab 12 cd 34 ef gh ij"))) > 2


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="only"):
        token_counts.Counter("x.tiktoken")


# Divergence of sources


def audit_rows(rows, least=3, ranks=200):
    """The contract word by word, over (lang, source, text)."""
    docs = [(lang or "", source or "", Counter(re.findall("[a-z\x80-\U0010ffff]+", (text or "").translate(LOWER)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if in_docs[t] >= least})
            counts[None].update({t: n for t, n in c.items() if in_docs[t] >= least})
        if not kept:
            p = {s: {} for s in counts}
        else:
            p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        sources = [s for s in counts if s is not None]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ordered[:most], 1)}
    return out


def audited(frame, **options):
    return {tuple(r) for r in divergence.audit(frame, **options).collect()}


def test_divergence_of_all_documents(spark, documents):
    rows = [(r["lang"], r["source"], r["text"]) for r in documents.collect()]
    got = queries.op12_source_divergence(spark, SF).collect()
    assert {tuple(r) for r in got} == audit_rows(rows) and len(got) == len(audit_rows(rows))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1}, {"block_bytes": 700, "shards": 1}, {"shards": 5}])
def test_divergence_of_blocks_and_shards_of_any_size(spark, options):
    vocabulary = ["a", "Ab", "éa", "日本", "zz", "o'clock", "x-y", "caféX", "\x00q", "w" * 300]
    random = np.random.default_rng(5)
    rows = [
        (["en", "de", None, ""][int(random.integers(4))], f"s{random.integers(7)}" if k % 9 else None, " ".join(random.choice(vocabulary, random.integers(0, 30))))
        for k in range(120)
    ]
    rows += [("fr", "alone", "once"), ("it", "a", None), ("it", "b", ""), ("it", "c", "12 34"), ("es", "a", "x x"), ("es", "b", "x"), ("es", "b", "x"), ("es", "c", "y")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(frame, **options) == audit_rows(rows)


def test_divergence_with_source_blocks(spark, monkeypatch):
    rows = [("en", f"s{k % 23}", f"a b{k % 3} c{k % 5} d{k % 7} a") for k in range(300)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    want = audit_rows(rows)
    for size in (4, 7):
        monkeypatch.setattr(divergence, "SOURCE_BLOCK", size)
        assert audited(frame) == want
    monkeypatch.setattr(divergence, "PAIR_STEP", 10)
    assert audited(frame) == want


def test_runs_are_merged_a_part_at_a_time(monkeypatch):
    import pyarrow as pa

    random = np.random.default_rng(8)
    monkeypatch.setattr(divergence, "AT_ONCE", 20)
    chunks, plain = [], defaultdict(lambda: [0, 0])
    for _ in range(12):
        keys = sorted({(bytes([97 + int(k) % 26]) * (1 + int(k) // 26), f"s{k % 3}") for k in random.integers(0, 90, 30)})
        for part in (keys[:9], keys[9:15], keys[15:]):
            chunks.append((part[0][0], pa.table({"key": [k for k, _ in part], "source": [s for _, s in part], "count": [2] * len(part), "docs": [1] * len(part)})))
        for k in keys:
            plain[k][0] += 2
            plain[k][1] += 1
    parts = list(divergence.merged(iter(sorted(chunks, key=lambda c: c[0]))))
    got = [((r["key"], r["source"]), [r["count_sum"], r["docs_sum"]]) for part in parts for r in part.to_pylist()]
    assert got == sorted(plain.items()) and len(parts) > 3
    keys = [set(part.column("key").to_pylist()) for part in parts]
    assert all(a.isdisjoint(b) for a, b in zip(keys, keys[1:]))


def test_divergence_terms_across_batches(spark):
    rows = [("en", f"s{k % 11}", f"a{k % 13} b c a{k % 4}") for k in range(200)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audited(frame) == audit_rows(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_corner_cases(spark, corner, corner_rows, empty):
    assert audited(empty) == set()
    assert audited(corner) == audit_rows([(None, None, t) for _, t in corner_rows])
    assert audited(corner.withColumn("other", corner["words"]), source_column="ids", lang_column="words") == audit_rows([("x", "y", t) for _, t in corner_rows])


def test_divergence_ranks_are_cut_for_terms_only(spark):
    rows = [("en", f"s{k}", f"t{k} t{k} u{k} all") for k in range(6)] * 3
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(frame, term_ranks=1) == audit_rows(rows, ranks=1)


def test_probability_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(0, 5, 7), (8_999_999_999, 10**12, 3), (9_000_000_000, 10**13, 3), (10**15, 10**15 + 9, 10**6), (0, 0, 0)]
    frame = spark.createDataFrame(cases, "n long, total long, size long")
    got = [r[0] for r in frame.select(divergence.probability(F.col("n"), F.col("total"), F.col("size"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) if t + v else None for n, t, v in cases]


def test_terms_of_long_texts_part_by_part(monkeypatch):
    monkeypatch.setattr(divergence, "STEP_CHARS", 7)
    text = "ab CDé, x" * 40 + "l" * 100 + " 9 end"
    found = [t for part in divergence.terms_of(text) for t in part]
    assert found == [t.encode() for t in re.findall("[a-z\x80-\U0010ffff]+", text.translate(LOWER))]


# Whitening


def plain_whitening(vectors, components=4):
    usable = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in usable])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return {
        "n": n,
        "deviation": ((n * x - sums) ** 2).sum(1),
        "whitened": (x - sums / n) @ vectors / np.sqrt(values),
        "explained": values / np.trace(centred.T @ centred / n),
    }


def compare(rows, want, ids):
    components = want["whitened"].shape[1]
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r["vec_id"]][r["component"]] = r
    assert len(rows) == len(ids) * components and len(by_id) == len(ids)
    got = np.array([[by_id[i][k + 1]["whitened"] for k in range(components)] for i in ids])
    for k in range(components):
        assert min(abs(got[:, k] - want["whitened"][:, k]).max(), abs(got[:, k] + want["whitened"][:, k]).max()) < 1e-6
        assert abs(by_id[ids[0]][k + 1]["explained"] / want["explained"][k] - 1) < 1e-9
    for i, d in zip(ids, want["deviation"].tolist()):
        r = by_id[i][1]
        assert (r["n"], r["deviation"]) == (want["n"], d) and r["identity_error"] < 1e-9


def test_whitening_of_all_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op11_whitening(spark, SF).collect()
    compare(got, plain_whitening([r["embedding"] for r in table]), [r["vec_id"] for r in table])


def test_whitening_of_badly_scaled_vectors_with_copies(spark):
    random = np.random.default_rng(1)
    base = random.normal(size=(300, 6)) * [4000, 500, 60, 9, 1, 0.1]
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 500
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(7)
    compare(whitening.whiten(frame, components=5).collect(), plain_whitening(vectors, 5), list(range(len(vectors))))


def test_partial_sums_are_folded(spark, monkeypatch):
    random = np.random.default_rng(2)
    vectors = random.normal(size=(200, 3)).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    one = sorted(map(tuple, whitening.whiten(frame).collect()))
    monkeypatch.setattr(whitening, "FOLD_BYTES", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        many = sorted(map(tuple, whitening.whiten(frame.repartition(40)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.allclose([r[4:6] for r in one], [r[4:6] for r in many], atol=1e-9)


def test_whitening_corner_cases(spark):
    schema = "vec_id string, embedding array<double>, x int, n string, component string"

    def run(vectors, **options):
        rows = [(str(k) if k else None, v, None, None, "c") for k, v in enumerate(vectors)]
        return whitening.whiten(spark.createDataFrame(rows, schema), **options).collect()

    assert run([]) == [] and run([None, [None], [float("nan")], [float("inf"), 1.0], []]) == []
    assert run([[1.0, 2.0]] * 3) == []  # one distinct vector has no direction
    got = run([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [3.0, 3.0], [float("-inf"), 0.0], [1.0, None], None, [2.0], [1e30, 0.0]])
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == [("1", 1, 3), ("2", 1, 3), ("3", 1, 3), ("None", 1, 3)]
    assert all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in got)
    # equal variances: any two axes, but orthonormal
    got = run([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])
    assert len(got) == 8 and all(r["identity_error"] < 1e-9 for r in got)
    # a constant dimension and more components asked for than there are
    got = run([[1.0, 5.0, 2.0], [2.0, 5.0, 1.0], [4.0, 5.0, 4.0], [0.0, 5.0, 9.0]], components=9)
    assert {r["component"] for r in got} == {1, 2}


def test_deviations_do_not_wrap():
    x = np.array([[2**33, 0], [3, 4]])
    assert whitening.deviations(x, 10**6, [0, 0]) == [None, 25 * 10**12]
    assert whitening.deviations(np.array([[3 * 10**9, 0]]), 1, [0, 0]) == [9 * 10**18]
    assert whitening.deviations(np.array([[5]]), 1, [2**70]) == [None]


def test_triangular_solves():
    random = np.random.default_rng(3)
    upper = np.triu(random.normal(size=(70, 70))) + 9 * np.eye(70)
    x = random.normal(size=(11, 70))
    assert np.allclose(whitening.right_solve(x, upper) @ upper, x)
