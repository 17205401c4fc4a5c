"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z][A-Za-z']*"


def normalised_term(c: Column) -> Column:
    """Hyphens as spaces, lower case, single spaces, trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "-", " "), r"\s+", " ")))


def blank(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")


def stripped(c: Column) -> Column:
    """Markup taken off: links to their labels, {attributes}, tags, entities, placeholders; single spaces."""
    for pattern, by in ((r"\[\[[^\]]*\]\]", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"\{[^}]*\}", " "), (r"<[^>]*>", " "), (r"&[A-Za-z]+;|&#[0-9]+;", " "), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def bridged_tokens(c: Column) -> Column:
    """Tokens, with a null wherever what lies between two is not white space or a hyphen, so that n-grams break there."""
    marked = F.regexp_replace(c, r"[^A-Za-z'\s-]+", " \u0001 ")
    both = F.regexp_extract_all(marked, F.lit(TOKEN + "|\u0001"), F.lit(0))
    return F.transform(both, lambda t: F.when(t != "\u0001", t))


def word_count(c: Column) -> Column:
    """Runs of what is not white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def stable_id(*c: Column) -> Column:
    """Ten hex digits of a hash."""
    return F.substring(F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0")), 1, 10)


def shortened(c: Column, most: int = 200, keep: int = 197) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def term_pattern(term: str, aliases: str | None = None) -> str:
    """A pattern of a term and its aliases (separated by |): longest first, spaces and hyphens alike, any case; neither
    a letter nor a digit stands before or after, so that a term may end in a punctuation mark."""
    seen: dict[str, None] = {}
    for a in (term, *(aliases or "").split("|")):
        if a.strip():
            seen.setdefault("[- ]+".join(re.escape(w) for w in re.split("[- ]+", a.strip().lower())))
    return f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(sorted(seen, key=lambda p: (-len(p), p)))})(?![A-Za-z0-9_])"


def page_url(path: Column) -> Column:
    """Source path to page path."""
    return F.regexp_replace(path, r"\.qmd$", ".html")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def resolved(base: Column, relative: Column) -> Column:
    """A relative path from a base directory, with . and .. taken out."""
    parts = F.split(F.concat_ws("/", base, relative), "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "") | (p == "."), a).when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.array_join(walked, "/")


def numbers(c: Column) -> Column:
    """Blank-separated numbers as an array of doubles."""
    return F.transform(F.filter(F.split(c, r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
