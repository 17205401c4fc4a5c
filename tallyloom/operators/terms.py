"""Terminology: matching known terms, mining candidates, review, lock.

Segments are (text, kind, occurrence_type, file, start_line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.segments import extract

# Words that no mined term holds, and words that may join a capitalised run.
STOPWORDS = (
    "a an the of in on at to for and or but nor so yet is are was were be been being it its this that these those "
    "as by with from into onto over under not no if then than you your we our i he she they them his her their "
    "do does did have has had can could will would should may might there here what which who whom when where why how "
    "all some any one two three up down out about also just more most very "
    "dr drs each other own let next through term four day days page pages"
).split()
CONNECTORS = ("of", "the", "and", "for", "to", "in", "a", "an")
DECISIONS = ("translate", "keep english", "gloss on first use")


def occurrence_type(kind: Column) -> Column:
    """Segment kind to occurrence type; an unknown kind is an error."""
    return (
        F.when(kind == "yaml_value", F.lit("yaml")).when(kind.isin("yaml", "prose"), F.lit("prose")).when(kind == "r-string", F.lit("r")).when(kind.isin("ui-string", "aria-label"), F.lit("ui"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))))
    )


def corpus_segments(files: DataFrame) -> DataFrame:
    """files(path, text) -> segments (text, kind, occurrence_type, file, start_line) of all of them."""
    return extract(files).select("text", "kind", occurrence_type(F.col("kind")).alias("occurrence_type"), "file", "start_line")


def match_terms(segments: DataFrame, seed: list[tuple[str, str]], contexts: int = 3) -> DataFrame:
    """(ord, term, frequency, occurrence_types, contexts): for each (term, aliases) in order, matches in all segments.

    The patterns are compiled into the plan; segments are read once and only those that match are aggregated.
    A term without a match has frequency 0 and nulls.
    """
    spark = segments.sparkSession
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("ord"), F.regexp_count("text", F.lit(T.term_pattern(t, a))).alias("n")) for i, (t, a) in enumerate(seed)]), lambda s: s["n"] > 0)
    hits = segments.select("text", "occurrence_type", "file", "start_line", F.explode(found).alias("m")).select("m.ord", "m.n", "occurrence_type", "file", "start_line", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 160).alias("context"))
    total = hits.groupBy("ord").agg(F.sum("n").alias("frequency"), F.array_join(F.sort_array(F.collect_set("occurrence_type")), "|").alias("occurrence_types"))
    shown = first_distinct(hits, ["ord"], "context", ["file", "start_line"], contexts)
    terms = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(seed)], "ord int, term string")
    out = terms.join(total, "ord", "left").join(shown, "ord", "left")
    return out.select("ord", "term", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"), "occurrence_types", F.col("context").alias("contexts"))


def first_distinct(df: DataFrame, keys: list[str], value: str, order: list[str], k: int) -> DataFrame:
    """(keys..., value): the first k distinct non-empty values by first appearance, joined by " | "; the rest is cut
    before anything is collected."""
    each = df.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(*keys).orderBy("_at", value)
    top = each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda s: s[value]), " | ").alias(value))


def ngrams(tokens: Column, n: int) -> Column:
    """Arrays of n neighbouring tokens; none crosses a null."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: F.slice(tokens, i + 1, n)), lambda g: ~F.exists(g, lambda t: t.isNull()))


def candidate_grams(segments: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """segments with display: each n-gram of prose without a stopword and with tokens of two letters or more."""
    tokens = segments.where(F.col("kind") == "prose").withColumn("_t", T.bridged_tokens(T.stripped(F.col("text"))))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    every = F.concat(*[ngrams(F.col("_t"), n) for n in sizes])
    fit = F.filter(every, lambda g: ~F.exists(g, lambda t: (F.length(t) < 2) | F.array_contains(stop, F.lower(t))))
    return tokens.select("*", F.explode(F.transform(fit, lambda g: F.array_join(g, " "))).alias("display")).drop("_t")


def capitalised_runs(segments: DataFrame, shortest: int = 4, longest: int = 6) -> DataFrame:
    """segments with display: runs of capitalised tokens of 4 to 6, connectors inside; longer runs go whole."""
    joined = F.array_join(F.transform(T.bridged_tokens(T.stripped(F.col("text"))), lambda t: F.coalesce(t, F.lit("\u0001"))), " ")
    word, link = "[A-Z][A-Za-z']*", "(?:" + "|".join(CONNECTORS) + ")"
    runs = F.regexp_extract_all(joined, F.lit(rf"(?<![A-Za-z'])({word}(?: {link}(?= [A-Z])| {word})+)(?![A-Za-z'])"), F.lit(1))
    fit = F.filter(runs, lambda r: F.size(F.split(r, " ")).between(shortest, longest))
    return segments.where(F.col("kind") == "prose").select("*", F.explode(fit).alias("display"))


def counted(grams: DataFrame, min_freq: int = 5) -> DataFrame:
    """(term, frequency, display): of (display, ...) by normalised term, those met often enough; the commonest display,
    the smallest of equals."""
    each = grams.groupBy(T.normalised_term(F.col("display")).alias("term"), "display").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("term").agg(F.sum("n").alias("frequency"), F.min(F.struct((-F.col("n")).alias("n"), "display")).alias("_d")).where(F.col("frequency") >= min_freq)
    return totals.select("term", "frequency", F.col("_d.display").alias("display"))


def without_nested(candidates: DataFrame) -> DataFrame:
    """Candidates (term, frequency, display) but for those that are all capitalised and lie inside a longer one of
    equal frequency that adds a word of weight.

    Every run of words inside a term is made, at most a few a term, and met by equality.
    """
    words = F.split("term", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.struct(F.array_join(F.slice(words, i, n), " ").alias("term"), (F.array_join(F.slice(words, F.lit(1), i - 1), " ")).alias("before"), F.array_join(F.slice(words, i + n, F.size(words)), " ").alias("after")))))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    inner = candidates.select("frequency", F.col("term").alias("longer"), F.explode(runs).alias("r")).where("r.term <> longer")
    extra = F.filter(F.concat(F.split("r.before", " "), F.split("r.after", " ")), lambda w: w != "")
    inner = inner.where(F.exists(extra, lambda w: ~F.array_contains(stop, w))).select("frequency", F.col("r.term").alias("term")).distinct()
    capital = ~F.exists(F.split("display", " "), lambda w: w.rlike("^[a-z]"))
    return candidates.where(~capital).unionByName(candidates.where(capital).join(inner, ["frequency", "term"], "left_anti").select(*candidates.columns))


def discover(segments: DataFrame, seed: list[tuple[str, str]], min_freq: int = 5, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """(term, frequency, display): n-grams, capitalised runs and interface texts that recur and are not known."""
    interface = segments.where(F.col("kind").isin("ui-string", "aria-label")).withColumn("display", F.trim("text"))
    grams = candidate_grams(segments).select("display").unionByName(capitalised_runs(segments).select("display")).unionByName(interface.select("display"))
    known = sorted({" ".join(x.replace("-", " ").lower().split()) for t, a in seed for x in (t, *(a or "").split("|"))} | {e.lower() for e in exclusions})
    fresh = counted(grams, min_freq)
    if known:
        fresh = fresh.join(segments.sparkSession.createDataFrame([(k,) for k in known], "term string"), "term", "left_anti")
    return without_nested(fresh)


def draft(segments: DataFrame, seed: list[tuple[str, str]], min_freq: int = 5) -> DataFrame:
    """(term, frequency, source): known terms and candidates, by falling frequency, then term."""
    known = match_terms(segments, seed).select("term", "frequency", F.lit("seed").alias("source"))
    mined = discover(segments, seed, min_freq).select("term", "frequency", F.lit("discovered").alias("source"))
    return known.unionByName(mined).orderBy(F.desc("frequency"), "term")


def prepared(draft_rows: DataFrame, resolutions: DataFrame, earlier: DataFrame) -> DataFrame:
    """Review rows (term_en, approved_fr, decision, reviewer_notes, decision_needed) of a draft (term_en, fr_rendering,
    decision_needed): established ones filled in, then automatic resolutions (never over established), then what a
    reviewer wrote before, column by column where it is not blank."""
    established = ~F.col("decision_needed") & ~T.blank(F.col("fr_rendering"))
    base = draft_rows.select("term_en", "fr_rendering", "decision_needed", established.alias("_e"), T.normalised_term(F.col("term_en")).alias("_k"))
    first = F.row_number().over(Window.partitionBy("_k").orderBy("term_en"))
    auto = resolutions.withColumn("_k", T.normalised_term(F.col("term_en"))).withColumn("_n", first).where("_n = 1").select("_k", F.col("decision").alias("_d"), F.col("approved_fr").alias("_f"), F.col("reviewer_notes").alias("_r"), F.lit(True).alias("_hit"))
    prior = earlier.withColumn("_n", F.row_number().over(Window.partitionBy("term_en").orderBy("approved_fr", "decision"))).where("_n = 1")
    prior = prior.select("term_en", F.col("decision").alias("_pd"), F.col("approved_fr").alias("_pf"), F.col("reviewer_notes").alias("_pr"))
    met = base.join(auto, "_k", "left").join(prior, "term_en", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & ~F.col("_e"))
    pick = lambda old, filled: F.when(~T.blank(F.col(old)), F.col(old)).otherwise(filled)
    return met.select(
        "term_en",
        pick("_pf", F.when(F.col("_e"), F.col("fr_rendering")).when(F.col("_hit"), F.col("_f"))).alias("approved_fr"),
        pick("_pd", F.when(F.col("_e"), F.lit("translate")).when(F.col("_hit"), F.col("_d"))).alias("decision"),
        pick("_pr", F.when(F.col("_hit"), F.col("_r"))).alias("reviewer_notes"),
        (F.col("decision_needed") & ~F.col("_hit")).alias("decision_needed"),
    )


def resolved(decision: Column, rendering: Column) -> Column:
    d = F.lower(F.trim(decision))
    return F.coalesce(d.isin("keep english", "gloss on first use") | ((d == "translate") & ~T.blank(rendering)), F.lit(False))


def unresolved(review: DataFrame) -> DataFrame:
    return review.where(~resolved(F.col("decision"), F.col("approved_fr")))


def locked(review: DataFrame) -> DataFrame:
    """(term_en, entry as JSON); an error that names what is not resolved."""
    d = F.lower(F.trim(F.col("decision")))
    checked = F.when(resolved(F.col("decision"), F.col("approved_fr")), F.regexp_replace(F.when(d == "gloss on first use", F.lit("gloss first use")).otherwise(d), " ", "-")).otherwise(F.raise_error(F.concat(F.lit("unresolved: "), F.col("term_en"))))
    return review.select("term_en", F.to_json(F.struct(checked.alias("decision"), F.when(~T.blank(F.col("approved_fr")), F.col("approved_fr")).alias("approved_fr"))).alias("entry"))
