"""Null and repeated ids, repeated rows, ties, empty tables and columns with clashing names, for every operator."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import embedding_dedup, language_id, minhash_dedup, packing, quality_rules, source_mixing, substring_dedup, token_counts, toxicity, url_filter

LONG = " ".join(f"word{i}" for i in range(40))
#: (doc_id, text): a null id with a text of another, an id with two texts and one that repeats, an empty and a null text.
ROWS = [(1, LONG), (None, LONG), (2, LONG + " more"), (2, "another text"), (2, "another text"), (3, ""), (4, None), (None, None), (5, LONG)]
SCHEMA = "doc_id long, text string"
CLASHES = ("n_words", "rank", "component", "shard", "anchor", "bands", "set_key", "weight", "key", "size", "label", "score", "ids", "window", "starts", "version", "vector", "rep", "n")


def clashing(df):
    return df.withColumns({n: F.lit(7) for n in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "a", "xx") for r in ROWS], SCHEMA + ", source string, lang string").transform(clashing).repartition(2)


def keyed(rows, *columns):
    return sorted(([r.doc_id, *[r[c] for c in columns]] for r in rows), key=str)


def test_substring(docs):
    got = keyed(substring_dedup.remove_repeats(docs).collect(), "n_words", "n_removed")
    assert got == sorted([[1, 40, 0], [None, 40, 0], [2, 41, 40], [2, 2, 0], [2, 2, 0], [3, 0, 0], [4, 0, 0], [None, 0, 0], [5, 40, 40]], key=str)


def test_minhash(docs):
    got = keyed(minhash_dedup.near_duplicates(docs).collect(), "n_shingles", "component_id", "kept")
    assert got == sorted([[1, 36, 1, True], [None, 36, None, True], [2, 37, 1, False], [2, 1, 1, False], [2, 1, 1, False], [3, 0, 3, True], [4, 0, 4, True], [None, 0, None, True], [5, 36, 1, False]], key=str)


def test_packing(docs):
    pieces = packing.pack(docs, "byte_bpe_50k.json", size=64).collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    counts = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(docs, "byte_bpe_50k.json").collect()}
    assert tokens == {i: sum(counts[i, len((t or "").encode())] + 1 for j, t in ROWS if j == i) for i in (None, 1, 2, 3, 4, 5)}


def test_counts(docs):
    got = keyed(token_counts.count_tokens(docs, "word_bpe_49k.json").collect(), "n_bytes")
    assert got == sorted([[i, len((t or "").encode())] for i, t in ROWS], key=str)


def test_quality(docs):
    voted = quality_rules.with_votes(docs)
    got = quality_rules.judge(voted, quality_rules.fit(voted)).collect()
    assert keyed(got, "n_words", "base_failed") == sorted([[i, len((t or "").split()), len((t or "").split()) < 10] for i, t in ROWS], key=str)
    assert not any(r.kept for r in got if r.base_failed)


def test_mixing(docs):
    one, two = (keyed(source_mixing.mix(docs).collect(), "size", "source_size", "copies", "taken") for _ in range(2))
    assert one == two and len(one) == len(ROWS)
    assert all(size == len((t or "").split()) for (_, size, *_), (_, t) in zip(sorted(one, key=str), sorted(([i, t] for i, t in ROWS), key=lambda r: str([r[0], len((r[1] or "").split())]))))
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in one)


def test_languages(docs, spark):
    model = language_id.fit(docs)
    assert keyed(language_id.identify(docs, model).collect(), "lang_pred") == sorted([[i, "xx" if t else "und"] for i, t in ROWS], key=str)
    none = spark.createDataFrame([], SCHEMA + ", lang string")
    assert language_id.identify(none, model).count() == 0 and language_id.identify(docs, language_id.fit(none)).where("lang_pred <> 'und' or score <> 0").count() == 0
    tie = language_id.fit(spark.createDataFrame([(1, "same words", "aa"), (2, "same words", "bb")], SCHEMA + ", lang string"))
    r = language_id.identify(spark.createDataFrame([(9, "same words " * 50_000)], SCHEMA), tie).first()
    assert r.lang_pred in ("aa", "bb") and r.ambiguous


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int").transform(clashing)
    model = toxicity.fit(labels, docs)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(labels.limit(0), docs)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(labels.where("toxic = 1"), docs)).collect()} == {1.0}


def test_sample_bounds(spark):
    from tallyloom.llm.common import sampled

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 4000 == 1, None).otherwise("often").alias("label"))
    got = {r.label: r["count"] for r in sampled(rows, "doc_id", "label", 500).groupBy("label").count().collect()}
    assert 400 < got["rare"] < 600 and 400 < got["often"] < 600 and got[None] == rows.where("label is null").count()


def test_embeddings(spark):
    half = [1.0, 0.0, 0.0, 0.0]
    edge = [0.9, math.sqrt(1 - 0.81), 0.0, 0.0]
    rows = [(1, half), (1, half), (None, half), (2, half), (3, edge), (4, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").transform(clashing)
    got = sorted(([r.vec_id, r.n_links, r.component_id, r.kept] for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    cosine = 0.9 / math.sqrt(0.9**2 + (1 - 0.81))
    linked = cosine >= 0.9
    assert got == sorted([[1, 2 + linked, 1, True], [1, 2 + linked, 1, True], [None, 0, None, True], [2, 2 + linked, 1, False], [3, 3 * linked, 1 if linked else 3, not linked], [4, 0, 4, True], [4, 0, 4, True], [5, 1, 5, True], [6, 1, 5, False]], key=str)


def test_urls(spark):
    pages = spark.createDataFrame([(None, "http://bad.com/", None), (1, "http://bad.com/", None), (1, "http://bad.com/", None), (1, None, "<a href=//bad.com>")], "page_id long, url string, html string").transform(clashing)
    got = sorted(([r.page_id, r.host, r.verdict] for r in url_filter.judge(pages, [("block", "bad.com", "/")]).collect()), key=str)
    assert got == sorted([[None, "bad.com", "block"], [1, "bad.com", "block"], [1, "bad.com", "block"], [1, "", "allow"]], key=str)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA + ", source string")
    assert substring_dedup.remove_repeats(none).count() == minhash_dedup.near_duplicates(none).count() == packing.pack(none, "byte_bpe_50k.json").count() == 0
    assert token_counts.count_tokens(none, "piece_bpe_32k.model").count() == source_mixing.mix(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("odd", [(*r, "en", "a", 5) for r in ROWS])):
        spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # no document fails but those without ten words; of ids 1, 2 and 5, near duplicates of each other, one stays
        assert {p.doc_id for p in pieces} == ({None, 1} if rows else set())
