"""Queries: links, anchors and paths of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import audit, ledger
from tallyloom.plans.register import query, table

HREF = 'href="([^"]*)"'
#: Host and path of an absolute address.
ADDRESS = "^[a-z]+://([^/?#]*)([^?#]*)"


def edges(spark, sf_dir: str) -> DataFrame:
    """(page_id, nth, host, href, target_file, anchor): links of pages; the target is the host that an address names,
    else the page's own, the anchor the path."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", ADDRESS, 1).alias("host"), "html")
    e = audit.extract_matches(p, HREF, ["href"], "html")
    outside = F.col("href").rlike(ADDRESS)
    return e.select(
        "page_id", "nth", "host", "href", F.when(outside, F.regexp_extract("href", ADDRESS, 1)).otherwise(F.col("host")).alias("target_file"),
        F.when(outside, F.regexp_extract("href", ADDRESS, 2)).otherwise(F.regexp_extract("href", "^[^?#]*", 0)).alias("anchor"),
    )


_EDGES = f"""p AS (SELECT page_id, regexp_extract(url, '{ADDRESS}', 1) AS host, regexp_extract_all(html, '{HREF}', 1) AS h FROM pages),
l AS (SELECT page_id, host, unnest(h) AS href, generate_subscripts(h, 1) AS nth FROM p),
e AS (SELECT *, CASE WHEN regexp_matches(href, '{ADDRESS}') THEN regexp_extract(href, '{ADDRESS}', 1) ELSE host END AS target_file,
      CASE WHEN regexp_matches(href, '{ADDRESS}') THEN regexp_extract(href, '{ADDRESS}', 2) ELSE regexp_extract(href, '^[^?#]*') END AS anchor FROM l)"""


@query(f"WITH {_EDGES} SELECT page_id, nth::BIGINT AS nth, href, target_file, anchor FROM e")
def link_edges(spark, sf_dir):
    return edges(spark, sf_dir).drop("host").withColumn("nth", F.col("nth").cast("long"))


@query(f"WITH {_EDGES}, d AS (SELECT DISTINCT regexp_extract(url, '{ADDRESS}', 1) AS host, regexp_extract(url, '{ADDRESS}', 2) AS path FROM pages) SELECT page_id, nth::BIGINT AS nth, e.target_file, e.anchor FROM e LEFT JOIN d ON d.host = e.target_file AND d.path = e.anchor WHERE d.host IS NULL")
def link_integrity(spark, sf_dir):
    defined = table(spark, sf_dir, "pages").select(F.regexp_extract("url", ADDRESS, 1).alias("target_file"), F.regexp_extract("url", ADDRESS, 2).alias("anchor"))
    return audit.violations(edges(spark, sf_dir), defined).select("page_id", F.col("nth").cast("long").alias("nth"), "target_file", "anchor")


@query(f"WITH {_EDGES} SELECT anchor, array_to_string(list_sort(list_distinct(list(target_file))), ' | ') AS files, count(DISTINCT target_file) AS n FROM e GROUP BY 1")
def anchor_groups(spark, sf_dir):
    return audit.grouped(edges(spark, sf_dir).select("anchor", F.col("target_file").alias("source_file")), ["anchor"])


@query(
    """WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '/content/days/day-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '/' || lpad((page_id % 15 + 1)::VARCHAR, 2, '0') || '-name.html' END AS path FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN (page_id % 12 + 1)::INT END AS day, CASE WHEN page_id % 3 <> 0 THEN (page_id % 15 + 1)::INT END AS chapter FROM u"""
)
def page_context(spark, sf_dir):
    k = F.col("page_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    made = F.concat(F.lit("/content/days/day-"), two(k % 12 + 1), F.lit("/"), two(k % 15 + 1), F.lit("-name.html"))
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in ledger.page_context(F.when(k % 3 == 0, F.col("url")).otherwise(made)).items()])


@query("SELECT page_id, 'content/day-' || (page_id % 5 + 1) || '/' || page_id || '.html' AS path, 'content/day-2/' || page_id || '.html' AS up FROM pages")
def url_rewrite(spark, sf_dir):
    k = F.col("page_id").cast("string")
    file = F.concat(F.lit("content/day-"), (F.col("page_id") % 5 + 1).cast("string"), F.lit("/"), k, F.lit(".qmd"))
    up = T.resolved(T.directory(file), F.concat(F.lit("./../day-2//"), k, F.lit(".qmd")))
    return table(spark, sf_dir, "pages").select("page_id", T.page_url(file).alias("path"), T.page_url(up).alias("up"))
