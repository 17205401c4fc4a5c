"""URL filter: rules, and link-graph propagation for what they leave open.

Rules of (host, path) allow or block a host with all its subdomains where the path starts with the rule's; the longest
rule wins.  For urls without a rule the host decides.  Host edges are the links between pages of different hosts.
Trust is personalised PageRank along the links from the hosts of allowed pages; distrust is the same against the links
from the hosts of blocked pages, so that a host which links to blocked ones is distrusted.  Seeds weigh as their pages
do.  The rounds go on until what still moves is at most `tolerance` of all.  Both are made to sum to 1, which gives the
ranks of a walk that returns to the seeds from hosts without links; a host whose distrust is above `threshold` times
its trust is blocked.

Pages of a host are summed up before any shuffle, edges too; the rounds run over hosts, and are written to the shared
folder.  The join of pages with hosts has both sides shuffled, so that adaptive execution can split a host that holds
much of all pages; html never moves.  Only DataFrame operations.

Nulls and odd cases: urls that are null or have no `://` have an empty host and path, fit no rule and are allowed; a
null html has no links; links of hosts no page is from are edges too; repeated rows and null ids are judged as any; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rest of an absolute or scheme-relative link in an attribute, from the host on.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^"'\s<>/?#]+)"""


def host_of(url: Column) -> Column:
    """Host: what follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: what follows the host up to ? # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_scores(pages: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from pages(host, verdict, links: array of hosts); hosts without either are left out."""
    counted = pages.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    seeds = counted.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("allow", "block"))).alias("kind", "seed"))
    seeds = scratch.keep(seeds.where("seed > 0 and host <> ''"), "seeds")
    totals = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("n")).collect()}  # two rows
    seeds = seeds.withColumn("seed", F.col("seed") / F.when(F.col("kind") == "trust", F.lit(float(totals.get("trust", 1)))).otherwise(F.lit(float(totals.get("distrust", 1)))))

    links = pages.where("host <> ''").select("host", F.explode("links").alias("to")).where("host <> to").groupBy("host", "to").agg(F.count(F.lit(1)).alias("n"))
    links = scratch.keep(links, "links")
    forward = links.select(F.lit("trust").alias("kind"), F.col("host").alias("from"), "to", "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("to").alias("from"), F.col("host").alias("to"), "n")
    edges = forward.unionByName(backward)
    out = edges.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    edges = scratch.keep(edges.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("part")), "edges")
    # rank: what has arrived at a host; moving: the part of it that arrived last and goes on
    rank = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"), ((1 - damping) * F.col("seed")).alias("moving"))
    turn, left = 0, 0.0 if edges.isEmpty() else 1.0
    while left > tolerance:  # at most log(tolerance) / log(damping) times
        flow = edges.join(rank.where("moving > 0").select("kind", F.col("host").alias("from"), "moving"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(damping * F.col("part") * F.col("moving")).alias("rank"))
        both = flow.withColumn("moving", F.col("rank")).unionByName(rank.withColumn("moving", F.lit(0.0)))
        rank = scratch.keep(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("moving").alias("moving")), f"rank{turn}")
        if turn:
            scratch.drop(f"rank{turn - 1}")
        turn, left = turn + 1, rank.agg(F.coalesce(F.sum("moving"), F.lit(0.0))).first()[0]
    sums = {r["kind"]: r["s"] for r in rank.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}  # two rows
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)) / sums.get(kind, 1.0)
    return rank.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages(page_id, url, html); rules:
    (allow or block, host, path)."""
    if any(kind not in ("allow", "block") for kind, _, _ in rules):
        raise ValueError("a rule allows or blocks")
    scratch = Scratch(pages.sparkSession, "urls")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    scores = host_scores(ruled.select("host", "verdict", links.alias("links")), scratch, damping, tolerance)
    out = ruled.drop("html").join(scratch.keep(scores, "scores"), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > threshold * trust, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
