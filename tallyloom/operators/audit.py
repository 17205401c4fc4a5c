"""Cross-references between documents: lines, anchors, references, integrity.

A line table is (source_file, source_line, text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.series import toggled

ANCHOR = r"\{#sec-page([0-9]+)\}"
DAY_PAGE = r"Day ([0-9]+),? pages? ([0-9]+)"
APPENDIX = r"Appendix,? pages? ([0-9]+)"
LINK = r"\[[^\]]*\]\(([^)#\s]*)#([^)\s]+)\)"


def extract_matches(df: DataFrame, pattern: str, names: list[str], text: str = "text") -> DataFrame:
    """One row for each match, with `nth` (from 1), `match` and a column for each group."""
    every = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(["match", *names])]
    return df.select("*", F.posexplode(F.arrays_zip(*every)).alias("_i", "_m")).select(*df.columns, (F.col("_i") + 1).alias("nth"), *[F.col(f"_m.{n}").alias(n) for n in ["match", *names]])


def located(pattern: str):
    """A function of a text column: array<struct<start,end>> of all matches, from 1, end inclusive."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(texts: pd.Series) -> pd.Series:
        p = re.compile(pattern)
        return texts.map(lambda t: [(m.start() + 1, m.end()) for m in p.finditer(t)] if t is not None else None)

    return find


def masked_links(c: Column) -> Column:
    """Links replaced by as many spaces, so that places stay what they are."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        p = re.compile(r"\[[^\]]*\]\([^)]*\)")
        return texts.map(lambda t: p.sub(lambda m: " " * len(m[0]), t) if t is not None else None)

    return mask(c)


def day_directory(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(day-[0-9]+)", 1), F.lit(""))


def anchors(lines: DataFrame) -> DataFrame:
    """(day_dir, page, files, n): distinct files that define a page's anchor, joined by " | "."""
    found = extract_matches(lines, ANCHOR, ["page"]).select(day_directory(F.col("source_file")).alias("day_dir"), F.col("page").cast("int").alias("page"), "source_file")
    return grouped(found, ["day_dir", "page"])


def grouped(defined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., files, n): the distinct source_file of a key, sorted and joined by " | ", and how many they are."""
    return defined.select(*keys, "source_file").distinct().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("source_file")), " | ").alias("files"), F.count("source_file").alias("n"))


def concrete_references(lines: DataFrame, known: DataFrame) -> DataFrame:
    """"Day D page P" with the files of its anchor, if any."""
    found = extract_matches(lines, DAY_PAGE, ["day", "page"]).select("source_file", "source_line", "match", F.format_string("day-%02d", F.col("day").cast("int")).alias("day_dir"), F.col("page").cast("int").alias("page"), T.shortened(F.col("text")).alias("context"))
    return found.join(known, ["day_dir", "page"], "left").withColumn("status", F.when(F.col("files").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok"))


def appendix_references(lines: DataFrame, known: DataFrame) -> DataFrame:
    """"Appendix page P" classed as already-linked, notation-example or anchor-needed; several anchors give rows each."""
    found = extract_matches(lines, APPENDIX, ["page"]).withColumn("page", F.col("page").cast("int"))
    linked = F.expr(r"text rlike concat('\\[[^\\]]*', match, '[^\\]]*\\]\\(')")
    kind = F.when(linked, "already-linked").when(F.expr(r"text rlike concat('[\"“`]', match)"), "notation-example").otherwise("anchor-needed")
    return found.select("source_file", "source_line", "match", "page", kind.alias("kind")).join(known.select(F.col("page"), F.col("files")), "page", "left")


def prose_lines(lines: DataFrame) -> DataFrame:
    """Lines outside front matter and fences."""
    fenced = toggled(lines, ["source_file"], ["source_line"], F.col("text").rlike("^```"))
    w = Window.partitionBy("source_file").orderBy("source_line")
    marks = F.sum((F.col("text") == "---").cast("int")).over(w)
    first = F.first("text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "---"
    matter = first & ((marks < 2) | ((marks == 2) & (F.col("text") == "---")))
    return fenced.withColumn("_m", matter).where("not inside and not _m").where(~F.col("text").rlike("^```")).drop("inside", "_m")


def bare_references(lines: DataFrame, known: DataFrame, books: tuple[str, ...] = (), reach: int = 80) -> DataFrame:
    """"page P" and "pages P-Q" in prose that are neither links nor part of a longer reference: external where a book is
    named within `reach` characters, else joined with the anchors of the same day, null directories matching."""
    pattern = r"(?i)(?<!day [0-9] )(?<!day [0-9][0-9] )(?<!appendix )\bpages? ([0-9]+)(?:\s?[-–]\s?([0-9]+))?"
    rows = prose_lines(lines).where(F.col("text").rlike("(?i)\\bpages? [0-9]")).withColumn("masked", masked_links(F.col("text")))
    spots = rows.withColumn("at", F.explode(located(pattern)(F.col("masked"))))
    start, end = F.col("at.start"), F.col("at.end")
    around = F.substring(F.col("masked"), F.greatest(start - reach, F.lit(1)), end - F.greatest(start - reach, F.lit(1)) + 1 + reach)
    hit = F.substring(F.col("masked"), start, end - start + 1)
    external = F.lit(False)
    for b in books:
        external = external | F.instr(around, b).cast("boolean")
    found = spots.select("source_file", "source_line", hit.alias("match"), day_directory(F.col("source_file")).alias("day_dir"), F.regexp_extract(hit, "([0-9]+)", 1).cast("int").alias("page"), external.alias("external"), (F.regexp_extract(hit, r"[0-9]+\s?[-–]\s?[0-9]+", 0) != "").alias("is_range"))
    k = known.select(F.col("day_dir").alias("_d"), F.col("page").alias("_p"), "files")
    met = found.join(k, F.col("day_dir").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    return met.withColumn("status", F.when(F.col("external"), "external").when(F.col("files").isNotNull(), "internal").otherwise("unknown"))


def fuzzy_sample(lines: DataFrame, n: int = 30, seed: int = 1) -> DataFrame:
    """At most n lines that name a day without a page, chosen by a hash of file and line, in order."""
    rows = lines.where(F.col("text").rlike(r"Day [0-9]+(?!,? pages? [0-9])\b"))
    return rows.orderBy(F.xxhash64("source_file", "source_line", F.lit(seed)), "source_file", "source_line").limit(n).orderBy("source_file", "source_line")


def links(lines: DataFrame) -> DataFrame:
    """(source_file, source_line, target_file, anchor) of Markdown links with an anchor; paths from the root."""
    found = extract_matches(lines, LINK, ["path", "anchor"])
    target = F.when(F.col("path") == "", F.col("source_file")).otherwise(T.resolved(T.directory(F.col("source_file")), F.col("path")))
    return found.select("source_file", "source_line", target.alias("target_file"), "anchor")


def violations(links: DataFrame, defined: DataFrame) -> DataFrame:
    """Links (.., target_file, anchor) without a definition (target_file, anchor)."""
    return links.join(defined.select("target_file", "anchor").distinct(), ["target_file", "anchor"], "left_anti")


def section_violations(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Links to #sec-... anchors that are wrong, with reasons: a page's anchor without a path (the same ids come back in
    every folder), a target that is not among files(source_file), an anchor that its target does not define."""
    found = extract_matches(lines, r"\]\(([^()#]*)#(sec-[A-Za-z0-9_-]+)\)", ["path", "anchor"]).where(~F.col("path").rlike("^https?://"))
    bare = F.col("path") == ""
    target = F.when(bare, F.col("source_file")).otherwise(T.resolved(T.directory(F.col("source_file")), F.col("path")))
    found = found.select("source_file", "source_line", "match", target.alias("target_file"), "anchor", (bare & F.col("anchor").rlike("^sec-page[0-9]+$")).alias("bare"))
    defined = extract_matches(lines, r"\{#([A-Za-z0-9_-]+)(?:\s[^}]*)?\}", ["anchor"]).select(F.col("source_file").alias("target_file"), "anchor", F.lit(True).alias("defined")).distinct()
    there = files.select(F.col("source_file").alias("target_file"), F.lit(True).alias("exists")).distinct()
    met = found.join(there, "target_file", "left").join(defined, ["target_file", "anchor"], "left")
    missing = F.col("exists").isNull()
    reasons = F.filter(F.array(F.when(F.col("bare"), "path needed"), F.when(missing, "no such file"), F.when(~missing & F.col("defined").isNull(), "no such anchor")), lambda r: r.isNotNull())
    return met.select("source_file", "source_line", "match", "target_file", "anchor", reasons.alias("reasons")).where(F.size("reasons") > 0)


def bound(*tables: DataFrame) -> DataFrame:
    """Rows of several tables one below the other, by name; what a table lacks is null (U1)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_links(df: DataFrame, pattern: str, target: str, text: str = "text") -> DataFrame:
    """Unlinked occurrences of a pattern wrapped as links; those inside links stay."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = re.compile(rf"(\[[^\]]*\]\([^)]*\))|({pattern})")
        for pdf in batches:
            pdf[text] = pdf[text].map(lambda t: p.sub(lambda m: m[1] or f"[{m[2]}]({target})", t) if t is not None else None)
            yield pdf

    return df.mapInPandas(sweep, df.schema)
