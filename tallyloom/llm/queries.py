"""The registered queries opN_<name>: thin applications of the operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import embedding_dedup, language_id, minhash_dedup, packing, quality_rules, source_mixing, substring_dedup, token_counts, toxicity, url_filter
from tallyloom.llm.common import Scratch, table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
REMAINDER = "crc32(cast(cast(doc_id as string) as binary)) % {}"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = Scratch(spark, "quality").keep(quality_rules.with_votes(docs).drop("text"), "voted")
    judged = quality_rules.judge(voted, quality_rules.fit(voted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.expr(REMAINDER.format(3)) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out), "lang")
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.expr(REMAINDER.format(5)) == 0, F.lit(False))
    known = labels.where(~held_out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(known, docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_url_filter, op3_source_mixing, op4_quality_rules, op5_packing, op6_language_id, op7_toxicity, op8_embedding_dedup, op9_token_counts, op10_minhash_dedup)}

_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
own AS (SELECT g, min(doc_id) AS m FROM k GROUP BY g),
gone AS (SELECT DISTINCT k.doc_id, k.p + t.j AS p FROM k JOIN own USING (g), range(13) AS t(j) WHERE own.m < k.doc_id),
wp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT wp.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY wp.p) FILTER (gone.p IS NULL) AS t
         FROM wp LEFT JOIN gone ON wp.doc_id = gone.doc_id AND wp.p = gone.p GROUP BY wp.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _op2(rounds: int = 100, damping: float = 0.85) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (_, h, p) in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, (k, _, _) in zip(fits, rules)) + " END"
    upper, lower = url_filter.UPPER, url_filter.LOWER
    link = url_filter.LINK.replace("'", "''")
    return f"""
    WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{upper}', '{lower}') AS host,
          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    j AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM p),
    c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
    s0 AS (SELECT 'trust' AS kind, host, a AS n FROM c WHERE a > 0 UNION ALL SELECT 'distrust', host, b FROM c WHERE b > 0),
    s AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM s0),
    l0 AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{upper}', '{lower}') AS dst FROM j WHERE host <> ''),
    l AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> dst GROUP BY ALL),
    e0 AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
    e AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS part FROM e0),
    m AS (SELECT 0 AS i, kind, host, {1 - damping} * seed AS rank FROM s
          UNION ALL SELECT i + 1, e.kind, e.dst, sum({damping} * e.part * m.rank) FROM m JOIN e ON e.kind = m.kind AND e.src = m.host WHERE i < {rounds} GROUP BY i, e.kind, e.dst),
    r AS (SELECT kind, host, sum(rank) AS rank FROM m GROUP BY ALL),
    f AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) / (SELECT coalesce(sum(rank), 1) FROM r WHERE kind = 'trust') AS t,
          coalesce(sum(rank) FILTER (kind = 'distrust'), 0) / (SELECT coalesce(sum(rank), 1) FROM r WHERE kind = 'distrust') AS d
          FROM r GROUP BY host)
    SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d, 0) > coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict
    FROM j LEFT JOIN f ON f.host = j.host
    """


_OP3 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
           CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
           (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-1')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s0 AS (SELECT key, sum(size)::BIGINT AS source_size, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY key),
s1 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY level, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM s1),
w AS (SELECT arg_min(try, (level, key)) AS water FROM s2 WHERE try <= level),
t AS (SELECT key, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM s2 CROSS JOIN w),
g AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
v AS (SELECT key, source_size, target, whole, target - whole * source_size AS "left" FROM g),
k0 AS (SELECT d.key, CASE WHEN size >= 50 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, sum(size)::BIGINT AS words, any_value("left") AS "left" FROM d JOIN v ON v.key = d.key GROUP BY 1, 2),
k1 AS (SELECT *, ("left" - coalesce(sum(words) OVER (PARTITION BY key ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / nullif(sum(weight * words) OVER (PARTITION BY key ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS try FROM k0),
k2 AS (SELECT key, arg_max(try, weight) AS c FROM k1 WHERE try * weight <= 1 GROUP BY key),
k AS (SELECT k1.key, weight, least(1.0::DOUBLE, coalesce(c * weight, 0)) AS chance FROM k1 LEFT JOIN k2 ON k2.key = k1.key),
r AS (SELECT d.*, CASE WHEN chance < 1 THEN u / (1 - u) / (greatest(chance, 1e-9::DOUBLE) / (1 - chance)) ELSE 0 END AS rank
      FROM d JOIN k ON k.key = d.key AND k.weight = CASE WHEN size >= 50 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END),
o AS (SELECT r.*, g.source_size, g.target, g.whole, g."left",
      coalesce(sum(size) OVER (PARTITION BY r.key ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM r JOIN v g ON g.key = r.key),
q AS (SELECT *, before + size <= "left" AS drawn FROM o),
gap AS (SELECT key, any_value("left") - coalesce(sum(size) FILTER (drawn), 0) AS gap FROM q GROUP BY key),
last AS (SELECT q.key, arg_min(before, (abs(size - gap), before)) AS last FROM q JOIN gap ON gap.key = q.key
         WHERE NOT drawn AND size > 0 AND abs(size - gap) < gap GROUP BY q.key)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN drawn OR (coalesce(before = last, false) AND size > 0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q LEFT JOIN last ON last.key = q.key
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_url_filter": _op2(), "op3_source_mixing": _OP3, "op8_embedding_dedup": _OP8, "op10_minhash_dedup": _OP10}
