"""Documents: reading time, line classes, text checks, fingerprints, pages and indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T

# Words a minute, and the fewest words that are given a time.
WORDS_A_MINUTE, FEWEST = 200, 50


def countable(raw: Column) -> Column:
    """A page's text without fenced code, raw HTML, level-1 headings, hidden blocks and captions."""
    c = raw
    for pattern in (r"(?s)\A---\n.*?\n---\n", r"(?ms)^```.*?^```[^\n]*$", r"(?s)<(script|style)\b.*?</\1>", r"(?ms)^:::\s*\{[^}]*\.hidden[^}]*\}.*?^:::\s*$", r"(?m)^#\s[^\n]*$", r"(?m)^:\s[^\n]*$", r"<[^>]*>"):
        c = F.regexp_replace(c, pattern, "\n")
    return c


def minutes(words: Column) -> Column:
    """Reading time in minutes, one at least; null below 50 words."""
    return F.when(words >= FEWEST, F.greatest(F.ceil(words / WORDS_A_MINUTE), F.lit(1)).cast("long"))


def pace_label(minutes: Column, session: Column, track: Column, active: Column, pace: str = "the course&rsquo;s", other: str = "the second track") -> Column:
    """"~ N min reading", with the session's time where the two differ by more than one (then with a second track's
    where that differs from the session's by more than one); "+ activities" only where no session time is known, since
    that holds them."""
    n = lambda c: c.cast("string")
    base = F.concat(F.lit("~ "), n(minutes), F.lit(" min reading"))
    second = F.concat(F.lit(" &middot; ~ "), n(session), F.lit(f" min at {pace} pace"))
    third = F.when(F.abs(track - session) > 1, F.concat(F.lit(" (~ "), n(track), F.lit(f" min on {other})"))).otherwise(F.lit(""))
    return F.when(F.abs(session - minutes) > 1, F.concat(base, second, F.coalesce(third, F.lit("")))).when(session.isNull() & active, F.concat(base, F.lit(" + activities"))).otherwise(base)


def has_activity(raw: Column) -> Column:
    return raw.rlike(r"\bviewof\b|Inputs\.textarea|createDownloadButton|\.thought\b|class=\"[^\"]*\bthought\b")


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., line, text): a document's lines, counted from 1."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_l")).select(*keys, (F.col("_i") + 1).cast("long").alias("line"), F.col("_l").alias("text"))


def line_class(c: Column) -> Column:
    return F.when(T.blank(c), F.lit("blank")).when(c.rlike(r"^#{1,6} |^[A-Z][A-Z0-9 ,.'-]{3,}$"), F.lit("heading")).when(c.rlike(r"^\s*([-*•]|[0-9]+[.)])\s"), F.lit("list_item")).otherwise(F.lit("paragraph"))


def line_flags(c: Column) -> dict[str, Column]:
    return {
        "timing": c.rlike(r"(?i)\b[0-9]+ ?(min|minutes|hours?)\b"),
        "activity": c.rlike(r"(?i)\b(activity|exercise|pause for thought)\b"),
        "equation": c.rlike(r"=.*[0-9]|[0-9] ?[+×÷] ?[0-9]"),
    }


# Words that tell a content type.
CONTENT_WORDS = {"activity": ("activity", "exercise"), "introduction": ("introduction", "overview"), "conclusion": ("conclusion", "summary")}


def content_type(c: Column) -> Column:
    """The first that fits: activity, introduction, conclusion, narrative; a word counts wherever its letters stand."""
    has = lambda *w: F.lower(c).rlike("|".join(w))
    return F.when(has(*CONTENT_WORDS["activity"]), F.lit("activity")).when(has(*CONTENT_WORDS["introduction"]), F.lit("introduction")).when(has(*CONTENT_WORDS["conclusion"]), F.lit("conclusion")).otherwise(F.lit("narrative"))


def checks(c: Column) -> dict[str, Column]:
    """One flag for each rule of a text check.  Lengths are of the text without front matter, code and tags."""
    matter = F.when(c.startswith("---") & (F.instr(F.substring(c, 4, 2**31 - 1), "---") > 0), F.substring_index(F.substring(c, 4, 2**31 - 1), "---", 1))
    plain = c
    for pattern in (r"(?s)\A---.*?---", r"(?s)```.*?```", r"<[^>]+>"):
        plain = F.regexp_replace(plain, pattern, "")
    length = F.length(F.regexp_replace(plain, r"\A\s+|\s+\z", ""))
    return {
        "no_title": ~F.coalesce(F.contains(matter, F.lit("title:")), F.lit(False)),
        "very_short": length < 100,
        "short": (length >= 100) & (length < 300),
        "artefacts": c.rlike(r"\|\s+|\]\s+|\[A\]|\[B\]"),
        "broken_words": c.rlike(r"\w+-\s*\n\s*\w+"),
        "blank_runs": F.regexp_count(c, F.lit(r"\n\s*\n\s*\n")) > 3,
        "image_without_alt": c.rlike(r"!\[\]\([^)]+\)"),
    }


def repaired(c: Column) -> Column:
    """Stray bars and brackets as I, hyphen-broken words joined, broken lines joined."""
    for pattern, by in ((r"[|]\s+", "I "), (r"\]\s+", "I "), (r"(\w+)-\s*\n\s*(\w+)", "$1$2"), (r"(\w+)\s*\n\s*(\w+)", "$1 $2")):
        c = F.regexp_replace(c, pattern, by)
    return c


def paragraphs(df: DataFrame, keys: list[str], text: str = "text", shortest: int = 40, letters: float = 0.4) -> DataFrame:
    """(keys..., paragraph, text): lines between blank ones, joined; at least `shortest` characters long, and `letters` of
    those that are not spaces letters."""
    joined = F.transform(F.split(F.col(text), r"\n(?:[ \t]*\n)+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    out = df.select(*keys, F.posexplode(joined).alias("_i", "_p")).select(*keys, (F.col("_i") + 1).cast("long").alias("paragraph"), F.col("_p").alias("text"))
    return out.where((F.length("text") >= shortest) & (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= letters * F.length(F.replace("text", F.lit(" "))))).where(F.regexp_like("text", F.lit("[^ ]")))


def fingerprint(c: Column, words: int = 8) -> Column:
    """The first eight lower-cased words (letters and digits) of more than two characters."""
    spelled = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.filter(spelled, lambda w: F.length(w) > 2), 1, words)


def runs_of(words: Column, n: int = 5) -> Column:
    """The n-word runs of an array of words joined by spaces; the whole where it is shorter."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))


def covered(fingerprints: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """fingerprints(id, words) with found: whether one of their n-word runs occurs among the words of more than two
    characters of a corpus(text) document, in order and side by side.  Both sides are cut to runs and met by equality;
    fingerprints shorter than n meet runs of their own length."""
    spelled = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    asked = fingerprints.where("size(words) > 0").select("id", F.explode(runs_of(F.col("words"), n)).alias("run")).withColumn("n", F.size(F.split("run", " ")))
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most n of them
    held = None
    for k in lengths:
        part = corpus.select(spelled.alias("w")).where(F.size("w") >= k).select(F.explode(runs_of(F.col("w"), k)).alias("run")).distinct()
        held = part if held is None else held.unionByName(part)
    if held is None:
        return fingerprints.withColumn("found", F.lit(False))
    hit = asked.join(held.distinct(), "run", "left_semi").select("id").distinct().withColumn("found", F.lit(True))
    return fingerprints.join(hit, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def coverage(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., total, matched, percent): percent is rounded down."""
    s = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("matched"))
    return s.withColumn("percent", F.floor(100 * F.col("matched") / F.col("total")))


def structure(actual: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """(file, total, passed, failed): of a manifest's expectations a file, by full join.  Arrays have to hold the same
    texts in the same order, but for runs of spaces and typographic quotes."""
    met = actual.select("file", F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields]).join(expected.select("file", F.lit(True).alias("_e"), *[F.col(f).alias(f"e_{f}") for f in fields]), "file", "full")
    kinds = dict(expected.dtypes)
    plain = lambda s: F.translate(F.trim(F.regexp_replace(s, " +", " ")), "\u2018\u2019\u201c\u201d", "''\"\"")
    value = lambda c, f: F.transform(c, plain) if kinds[f] == "array<string>" else F.col(c)
    same = lambda f: value(f"e_{f}", f).eqNullSafe(value(f"a_{f}", f))
    both = F.col("_a") & F.col("_e")
    flags = [F.coalesce(both & same(f), F.lit(False)).cast("int") for f in fields]
    return met.select("file", F.lit(len(fields)).alias("total"), sum(flags[1:], flags[0]).alias("passed")).withColumn("failed", F.col("total") - F.col("passed"))


def without_overlaps(boxes: DataFrame, page: str = "page", most: float = 0.5) -> DataFrame:
    """Boxes (page, x, y, w, h) kept greedily, largest first, unless one kept before overlaps by more than `most` of
    the union.  Sequential by nature: one group of rows a page."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_a=pdf.w * pdf.h).sort_values(["_a", "x", "y", "w"], ascending=[False, True, True, True], kind="stable")
        kept: list[int] = []
        for i, b in enumerate(pdf.itertuples(index=False)):
            fits = True
            for j in kept:
                k = pdf.iloc[j]
                across = max(0, min(b.x + b.w, k.x + k.w) - max(b.x, k.x)) * max(0, min(b.y + b.h, k.y + k.h) - max(b.y, k.y))
                union = b.w * b.h + k.w * k.h - across
                if union > 0 and across / union > most:
                    fits = False
                    break
            if fits:
                kept.append(i)
        return pdf.iloc[kept].drop(columns="_a")

    return boxes.groupBy(page).applyInPandas(greedy, boxes.schema)


def compared(local: DataFrame, served: DataFrame) -> DataFrame:
    """(path, state): ok, differs or missing, by the SHA-256 of contents."""
    met = local.select("path", F.sha2("content", 256).alias("a")).join(served.select("path", F.sha2("content", 256).alias("b")), "path", "left")
    return met.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "ok").otherwise("differs").alias("state"))


def with_social_tags(html: Column) -> Column:
    """A page's description copied into its og: and twitter: descriptions."""
    found = F.regexp_extract(html, r'<meta name="description" content="([^"]*)"', 1)
    safe = F.regexp_replace(found, r"([\\$])", r"\\$1")
    out = html
    for tag in (r'property="og:description"', r'name="twitter:description"'):
        out = F.regexp_replace(out, F.lit(rf'(<meta {tag} content=")[^"]*(")'), F.concat(F.lit("$1"), safe, F.lit("$2")))
    return F.when(found != "", out).otherwise(html)


def page_index(files: DataFrame) -> DataFrame:
    """files(path, text) with page number (else 0), order prefix (else 999) and title (front matter, else the path)."""
    number = lambda p, d: F.coalesce(F.nullif(F.regexp_extract("path", p, 1), F.lit("")).cast("int"), F.lit(d))
    title = lambda key: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", rf"(?m)^{key}:\s*(.+)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    return files.select("path", number(r"page[-_ ]?([0-9]+)", 0).alias("page"), number(r"(?:^|/)([0-9]+)[-_][^/]*$", 999).alias("ord"), F.coalesce(title("pagetitle"), title("title"), F.col("path")).alias("title")).orderBy("ord", "path")


def site_map(pages: DataFrame, base: str) -> DataFrame:
    """pages(part, ord, path, title) -> (part, bullets): a part's pages as bullet lines of links, in order."""
    line = F.concat(F.lit("- ["), F.col("title"), F.lit(f"]({base}"), T.page_url(F.col("path")), F.lit(")"))
    return pages.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", line.alias("line")))), lambda s: s["line"]), "\n").alias("bullets"))


def stale(made: DataFrame, current: DataFrame, key: str = "part", text: str = "bullets") -> DataFrame:
    """Keys whose published text is not the one made now: missing, left over or different."""
    both = made.select(key, F.col(text).alias("_a")).join(current.select(key, F.col(text).alias("_b")), key, "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def orphans(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that no listing names (U4)."""
    return pages.select("path").subtract(listed.select("path"))


def changelog(entries: DataFrame, order: list[str]) -> DataFrame:
    """entries(section, ord, entry) -> (place, section, body): preferred sections first, others by name."""
    rank = F.lit(len(order))
    for i, s in enumerate(order):
        rank = F.when(F.col("section") == s, F.lit(i)).otherwise(rank)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda s: F.concat(F.lit("- "), s["entry"])), "\n")
    grouped = entries.groupBy("section", rank.alias("rank")).agg(body.alias("body"))
    return grouped.withColumn("place", F.row_number().over(Window.orderBy("rank", "section"))).select("place", "section", "body")


def dated_log(files: DataFrame) -> DataFrame:
    """files(path, text) of names YYYY-MM-DD-... as (path, text), newest first, headings one level down and a rule
    after each."""
    dated = files.where(F.col("path").rlike(r"(^|/)[0-9]{4}-[0-9]{2}-[0-9]{2}-[^/]*\.md$"))
    return dated.select("path", F.concat(F.regexp_replace("text", "(?m)^(#+ )", "#$1"), F.lit("\n\n---\n")).alias("text")).orderBy(F.desc("path"))


def smoothed(points: DataFrame, keys: list[str], span: float = 0.9) -> DataFrame:
    """points(keys..., x, y) with fit: local quadratic regression with tricube weights; null below three points."""
    import numpy as np

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        if len(x) < 3:
            return pdf.assign(fit=np.nan)
        k = max(3, int(np.ceil(span * len(x))))
        out = []
        for at in x:
            d = abs(x - at)
            h = np.sort(d)[min(k, len(x)) - 1] or 1.0
            w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, 1) ** 3)
            a = np.vander(x - at, 3, increasing=True)
            out.append(np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0][0])
        return pdf.assign(fit=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(*keys).applyInPandas(local, f"{schema}, fit double")
