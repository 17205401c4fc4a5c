"""Queries: terminology of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import terms
from tallyloom.plans.register import query, table

#: Terms with their aliases, in the synthetic language of documents.
SEED = [("of", None), ("the-of", "of the|OF-THE"), ("that and", "and that| "), ("in", "inen"), ("no such term", None)]
_PATTERNS = ["of", "the[- ]+of|of[- ]+the", "that[- ]+and|and[- ]+that", "inen|in", "no[- ]+such[- ]+term"]


def segments(spark, sf_dir: str) -> DataFrame:
    """Documents as segments of prose."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("text", F.lit("prose").alias("kind"), F.lit("prose").alias("occurrence_type"), F.coalesce("source", F.lit("")).alias("file"), F.col("doc_id").alias("start_line"))


_TERMS = ", ".join(f"({i}, '{t}', '(?i)\\b(?:{p})\\b')" for i, ((t, _), p) in enumerate(zip(SEED, _PATTERNS)))


@query(
    f"""WITH t(ord, term, pattern) AS (VALUES {_TERMS}),
    h AS (SELECT ord, coalesce(source, '') AS file, doc_id, len(regexp_extract_all(text, pattern)) AS n, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS context FROM documents, t WHERE text IS NOT NULL),
    m AS (SELECT * FROM h WHERE n > 0), f AS (SELECT ord, context, min((file, doc_id)) AS first_at FROM m WHERE context <> '' GROUP BY 1, 2),
    k AS (SELECT ord, context, row_number() OVER (PARTITION BY ord ORDER BY first_at, context) AS nth FROM f),
    c AS (SELECT ord, string_agg(context, ' | ' ORDER BY nth) AS contexts FROM k WHERE nth <= 3 GROUP BY 1)
    SELECT t.ord, term, coalesce(sum(n), 0)::BIGINT AS frequency, CASE WHEN sum(n) > 0 THEN 'prose' END AS occurrence_types, any_value(contexts) AS contexts
    FROM t LEFT JOIN m ON m.ord = t.ord LEFT JOIN c ON c.ord = t.ord GROUP BY t.ord, term"""
)
def term_match(spark, sf_dir):
    return terms.match_terms(segments(spark, sf_dir), SEED)


_STOP = ", ".join(f"'{w}'" for w in terms.STOPWORDS)
#: Markup off, breaks marked, tokens, runs of two and three of them that hold neither a break nor a stopword.
_GRAMS = f"""s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[[^\\]]*\\]\\]', ' ', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'),
      '\\{{[^}}]*\\}}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT regexp_extract_all(regexp_replace(x, '[^A-Za-z''\\s-]+', ' | ', 'g'), '[A-Za-z][A-Za-z'']*|\\|') AS w FROM s),
p AS (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) > 1),
g AS (SELECT w[i:i + 1] AS g FROM p UNION ALL SELECT w[i:i + 2] FROM p WHERE i + 2 <= len(w)),
k AS (SELECT array_to_string(g, ' ') AS display FROM g WHERE len(list_filter(g, lambda t: length(t) < 2 OR lower(t) IN ({_STOP}))) = 0),
n AS (SELECT lower(display) AS term, display, count(*) AS n FROM k GROUP BY 1, 2),
c AS (SELECT term, sum(n)::BIGINT AS frequency, arg_min(display, (-n, display)) AS display FROM n GROUP BY 1 HAVING sum(n) >= 5)"""


def candidates(spark, sf_dir: str) -> DataFrame:
    return terms.counted(terms.candidate_grams(segments(spark, sf_dir)).select("display"))


@query(f"WITH {_GRAMS} SELECT term, frequency, display FROM c")
def ngram_counts(spark, sf_dir):
    return candidates(spark, sf_dir)


@query(f"WITH {_GRAMS} SELECT * FROM c WHERE regexp_matches(display, '(^| )[a-z]') OR NOT EXISTS (SELECT 1 FROM c b WHERE b.frequency = c.frequency AND b.term <> c.term AND contains(' ' || b.term || ' ', ' ' || c.term || ' '))")
def nested_duplicates(spark, sf_dir):
    return terms.without_nested(candidates(spark, sf_dir))


@query()
def discover_candidates(spark, sf_dir):
    return terms.discover(segments(spark, sf_dir), SEED)


@query()
def draft_glossary(spark, sf_dir):
    return terms.draft(segments(spark, sf_dir), SEED)


def review(spark, sf_dir: str) -> DataFrame:
    """A draft, automatic resolutions and an earlier review, made of parts."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", F.lit("Part"), k.cast("string")).alias("term_en"))
    rows = p.select("term_en", F.when(k % 3 == 0, F.concat(F.lit("pièce "), k.cast("string"))).when(k % 3 == 1, F.lit(" ")).alias("fr_rendering"), (k % 2 == 1).alias("decision_needed"))
    auto = p.where(k % 5 == 0).select(F.lower(F.replace("term_en", F.lit("-"), F.lit(" "))).alias("term_en"), F.when(k % 10 == 0, "keep english").otherwise("translate").alias("decision"), F.when(k % 15 == 0, F.lit("pièce")).alias("approved_fr"), F.lit("auto").alias("reviewer_notes"))
    earlier = p.where(k % 7 == 0).select("term_en", F.when(k % 2 == 0, "gloss on first use").otherwise("").alias("decision"), F.lit("  ").alias("approved_fr"), F.lit("seen").alias("reviewer_notes"))
    return terms.prepared(rows, auto, earlier)


_REVIEW = """p AS (SELECT p_partkey AS k, 'Part-' || p_partkey AS term_en, CASE p_partkey % 3 WHEN 0 THEN 'pièce ' || p_partkey WHEN 1 THEN ' ' END AS fr, p_partkey % 2 = 1 AS open FROM part),
x AS (SELECT *, NOT open AND trim(coalesce(fr, '')) <> '' AS settled, k % 5 = 0 AND NOT (NOT open AND trim(coalesce(fr, '')) <> '') AS hit FROM p),
r AS (SELECT term_en, CASE WHEN settled THEN fr WHEN hit AND k % 15 = 0 THEN 'pièce' END AS approved_fr,
      CASE WHEN k % 14 = 0 THEN 'gloss on first use' WHEN settled THEN 'translate' WHEN hit AND k % 10 = 0 THEN 'keep english' WHEN hit THEN 'translate' END AS decision,
      CASE WHEN k % 7 = 0 THEN 'seen' WHEN hit THEN 'auto' END AS reviewer_notes, open AND NOT hit AS decision_needed FROM x)"""


@query(f"WITH {_REVIEW} SELECT * FROM r")
def review_merge(spark, sf_dir):
    return review(spark, sf_dir)


@query(f"WITH {_REVIEW} SELECT term_en FROM r WHERE NOT coalesce(decision IN ('keep english', 'gloss on first use') OR (decision = 'translate' AND trim(coalesce(approved_fr, '')) <> ''), false)")
def unresolved_terms(spark, sf_dir):
    return terms.unresolved(review(spark, sf_dir)).select("term_en")
