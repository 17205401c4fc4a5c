"""Queries: reading time, line classes, text checks and fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.plans.register import query, table


def _replaced(of: str, *patterns: str) -> str:
    for p in patterns:
        of = f"regexp_replace({of}, '{p}', chr(10), 'g')"
    return of


_COUNTED = _replaced(
    "text", r"(?s)\A---\n.*?\n---\n", r"(?ms)^```.*?^```[^\n]*$", r"(?s)<script\b.*?</script>", r"(?s)<style\b.*?</style>", r"(?ms)^:::\s*\{[^}]*\.hidden[^}]*\}.*?^:::\s*$", r"(?m)^#\s[^\n]*$", r"(?m)^:\s[^\n]*$", "<[^>]*>"
)
_MINUTES = f"m AS (SELECT doc_id, len(regexp_extract_all({_COUNTED}, '\\S+')) AS words FROM documents), n AS (SELECT *, CASE WHEN words >= 50 THEN greatest(ceil(words / 200.0), 1)::BIGINT END AS minutes FROM m)"


def _times(spark, sf_dir):
    words = T.word_count(D.countable(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).withColumn("minutes", D.minutes(F.col("words")))


@query(f"WITH {_MINUTES} SELECT doc_id, words, minutes FROM n")
def reading_time(spark, sf_dir):
    return _times(spark, sf_dir)


@query(
    f"""WITH {_MINUTES}, k AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 23 END AS session, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 19 END AS track FROM n)
    SELECT doc_id, '~ ' || minutes || ' min reading' || CASE WHEN abs(session - minutes) > 1 THEN ' &middot; ~ ' || session || ' min at the course&rsquo;s pace' || CASE WHEN abs(track - session) > 1 THEN ' (~ ' || track || ' min on the second track)' ELSE '' END
           WHEN session IS NULL AND doc_id % 5 = 0 THEN ' + activities' ELSE '' END AS label FROM k"""
)
def reading_label(spark, sf_dir):
    k = F.col("doc_id")
    session, track = F.when(k % 4 != 0, k % 23), F.when(k % 3 != 0, k % 19)
    return _times(spark, sf_dir).select("doc_id", D.pace_label(F.col("minutes"), session, track, k % 5 == 0).alias("label"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(x, '\\A\\s*\\z') THEN 'blank' WHEN regexp_matches(x, '^#{1,6} |^[A-Z][A-Z0-9 ,.''-]{3,}$') THEN 'heading' WHEN regexp_matches(x, '^\\s*([-*•]|[0-9]+[.)])\\s') THEN 'list_item' ELSE 'paragraph' END AS kind,
    count(*) AS lines, count(*) FILTER (regexp_matches(x, '(?i)\\b[0-9]+ ?(min|minutes|hours?)\\b')) AS timing, count(*) FILTER (regexp_matches(x, '(?i)\\b(activity|exercise|pause for thought)\\b')) AS activity,
    count(*) FILTER (regexp_matches(x, '=.*[0-9]|[0-9] ?[+×÷] ?[0-9]')) AS equation FROM l GROUP BY 1, 2"""
)
def line_classify(spark, sf_dir):
    x = D.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    flags = [F.count_if(c).alias(n) for n, c in D.line_flags(F.col("text")).items()]
    return x.groupBy("doc_id", D.line_class(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"), *flags)


@query(
    r"""WITH p AS (SELECT doc_id, text, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\A---.*?---', ''), '(?s)```.*?```', '', 'g'), '<[^>]+>', '', 'g'), '\A\s+|\s+\z', '', 'g')) AS n FROM documents)
    SELECT doc_id, NOT (starts_with(text, '---') AND contains(substr(text, 4), '---') AND contains(split_part(substr(text, 4), '---', 1), 'title:')) AS no_title, n < 100 AS very_short, n >= 100 AND n < 300 AS short,
    regexp_matches(text, '\|\s+|\]\s+|\[A\]|\[B\]') AS artefacts, regexp_matches(text, '\w+-\s*\n\s*\w+') AS broken_words, len(regexp_extract_all(text, '\n\s*\n\s*\n')) > 3 AS blank_runs, regexp_matches(text, '!\[\]\([^)]+\)') AS image_without_alt,
    CASE WHEN regexp_matches(lower(text), 'activity|exercise') THEN 'activity' WHEN regexp_matches(lower(text), 'introduction|overview') THEN 'introduction' WHEN regexp_matches(lower(text), 'conclusion|summary') THEN 'conclusion' ELSE 'narrative' END AS content_type FROM p"""
)
def text_qc(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[f.alias(n) for n, f in D.checks(c).items()], D.content_type(c).alias("content_type"))


_FINGERPRINTS = r"""q AS (SELECT item_id, unnest(string_split_regex(text, '\n(?:[ \t]*\n)+')) AS x, generate_subscripts(string_split_regex(text, '\n(?:[ \t]*\n)+'), 1) AS paragraph FROM benchmark),
r AS (SELECT item_id, paragraph, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM q),
f AS (SELECT item_id, paragraph, list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda w: length(w) > 2)[1:8] AS w FROM r
      WHERE length(x) >= 40 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 0.4 * length(replace(x, ' ', '')))"""


def fingerprints(spark, sf_dir):
    found = D.paragraphs(table(spark, sf_dir, "benchmark"), ["item_id"])
    return found.select("item_id", "paragraph", D.fingerprint(F.col("text")).alias("words"))


@query(f"WITH {_FINGERPRINTS} SELECT item_id, paragraph::BIGINT AS paragraph, array_to_string(w, ' ') AS fingerprint FROM f")
def paragraph_fingerprint(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("item_id", "paragraph", F.array_join("words", " ").alias("fingerprint"))


@query(
    f"""WITH {_FINGERPRINTS}, n AS (SELECT item_id, paragraph, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run, least(len(w), 5) AS k FROM f WHERE len(w) > 0),
    d AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2) AS w FROM documents),
    c AS (SELECT DISTINCT k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS run FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k),
    h AS (SELECT DISTINCT item_id, paragraph FROM n SEMI JOIN c ON c.run = n.run AND c.k = n.k)
    SELECT f.item_id, count(*) AS total, count(h.item_id) AS matched, floor(100 * count(h.item_id) / count(*))::BIGINT AS percent FROM f LEFT JOIN h ON h.item_id = f.item_id AND h.paragraph = f.paragraph GROUP BY 1"""
)
def fingerprint_coverage(spark, sf_dir):
    asked = fingerprints(spark, sf_dir).withColumn("id", F.struct("item_id", "paragraph"))
    met = D.covered(asked.select("id", "words"), table(spark, sf_dir, "documents").select("text"))
    return D.coverage(met.select("id.item_id", "found"), ["item_id"])
