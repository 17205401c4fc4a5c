"""Translatable segments of page sources, and putting them back.

A file is one row (path, text) and is scanned from top to bottom, so this is Arrow-batched Python; files are
independent.  Spans are character offsets of the raw text, so that putting segments back without a change gives the
same bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, ordinal int, kind string, start_line int, start int, end int, text string, segment_id string"
YAML = re.compile(r"^(title|subtitle|description):[ \t]*(\"?)(.+?)\2[ \t]*$")
LITERAL = re.compile(r"\b(?:title|subtitle|x_label|y_label|label|caption|xlab|ylab)\s*=\s*\"((?:[^\"\\]|\\.)*)\"")
WIDGET = re.compile(r"\blabel:\s*\"((?:[^\"\\]|\\.)*)\"")
ATTRIBUTE = re.compile(r"\b(?:aria-label|alt|title)=\"([^\"]*)\"")
STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")


def page_segments(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order: front-matter values, prose blocks, chunk literals, widget labels, attributes."""
    out: list[tuple[str, int, int]] = []
    at, state, block = 0, "prose", None

    def close(end: int) -> None:
        nonlocal block
        if block is not None and text[block:end].strip():
            out.append(("prose", block, end))
        block = None

    for i, line in enumerate(text.splitlines(keepends=True)):
        body = line.rstrip("\r\n")
        if state == "yaml":
            if body.strip() == "---":
                state = "prose"
            elif m := YAML.match(body):
                out.append(("yaml_value", at + m.start(3), at + m.end(3)))
        elif state in ("r", "ojs", "code"):
            if body.startswith("```"):
                state = "prose"
            elif state != "code":
                kind, pattern = ("r-string", LITERAL) if state == "r" else ("ui-string", WIDGET)
                out += [(kind, at + m.start(1), at + m.end(1)) for m in pattern.finditer(body) if m[1].strip()]
        elif i == 0 and body.strip() == "---":
            state = "yaml"
        elif body.startswith("```"):
            close(at)
            state = "r" if re.match(r"```\{r\b", body) else "ojs" if re.match(r"```\{ojs\b", body) else "code"
        elif body.lstrip().startswith("<"):
            close(at)
            out += [("aria-label", at + m.start(1), at + m.end(1)) for m in ATTRIBUTE.finditer(body) if m[1].strip()]
        elif not body.strip() or body.startswith(":::"):
            close(at)
        elif block is None:
            block = at
        if block is not None:
            last = at + len(body)
        at += len(line)
        if block is not None and at >= len(text):
            close(last)
    close(at)
    return [(k, s, e if k != "prose" else s + len(text[s:e].rstrip("\r\n"))) for k, s, e in out]


def script_segments(text: str) -> list[tuple[str, int, int]]:
    """String literals with a space between letters, outside comments."""
    kept = re.sub(r"(?m)(^|[^:\"'])(#|//).*$", lambda m: m[1] + " " * (len(m[0]) - len(m[1])), text)
    out = []
    for m in STRING.finditer(kept):
        g = 1 if m[1] is not None else 2
        if re.search(r"[A-Za-z] [A-Za-z]", m[g]):
            out.append(("r-string", m.start(g), m.end(g)))
    return out


def extract(files: DataFrame) -> DataFrame:
    """files(path, text) -> segments in order; .qmd and .md as pages, others as scripts; a null text has none."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.text):
                if not isinstance(text, str):
                    continue
                found = page_segments(text) if path.endswith((".qmd", ".md")) else script_segments(text)
                for n, (kind, s, e) in enumerate(found):
                    key = xxhash.xxh64_hexdigest(f"{path}|{kind}|{n}|{text[s:e]}")[:10]
                    rows.append((path, n, kind, text.count("\n", 0, s) + 1, s, e, text[s:e], key))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def reinject(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, text) with the segments' texts (file, start, end, text) put back, from the last to the first."""
    per = segments.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("start", "end", "text")).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, parts in zip(pdf.text, pdf.parts):
                if not isinstance(text, str):
                    texts.append(None)
                    continue
                for p in sorted(parts if parts is not None else [], key=lambda p: -p["start"]):
                    text = text[: p["start"]] + p["text"] + text[p["end"] :]
                texts.append(text)
            yield pd.DataFrame({"path": pdf.path, "text": texts})

    return files.select("path", "text").join(per, "path", "left").mapInPandas(run, "path string, text string")


# What is protected inside prose, in the order in which it is looked for.
PROTECTED = {
    "shortcode": r"\{\{<.*?>\}\}",
    "math_display": r"(?s)\$\$.+?\$\$",
    "math_inline": r"(?<!\$)\$(?!\$)[^$\n]+?\$(?!\$)",
    "inline_code": r"(`+)[^`]*?\1",
    "citation": r"\[(?:[^\]]*?@[^\]]+?)\]",
    "xref": r"@[A-Za-z][A-Za-z0-9_:.-]*",
    "span_lang": r"<span\s+lang=[\"']?[a-z-]+[\"']?\s*>.*?</span>",
    "dfn": r"<dfn\s+id=[\"'][^\"']+[\"']\s*>.*?</dfn>",
    "html_label_tag": r"</?(?:summary|button)\b[^>]*>",
    "rellink_day": r"\[[^\]]*\]\(\.\.\/(?:days\/)?day-\d{2}\/[^)]*?#sec-page\d+\)",
    "inline_attr": r"\[[^\]]*\]\{#sec-page\d+\}",
    "sec_anchor": r"#sec-page\d+",
}
FIELD = re.compile(r"^([A-Za-z_][A-Za-z0-9_.-]*:[ \t]+[\"']?)(.*?)([\"']?)[ \t]*$")
OPEN, CLOSE = "\ue000", "\ue001"


def protect(text: str, field: bool = False) -> tuple[str, list[str]]:
    """A text with its protected parts as numbered tokens between private-use characters, and those parts in order.
    Such characters in the text itself are protected first; field: what is around the value of a front-matter line is
    protected too."""
    kept: list[str] = []

    def token(part: str) -> str:
        kept.append(part)
        return f"{OPEN}PH{len(kept)}{CLOSE}"

    text = re.sub(f"[{OPEN}{CLOSE}]", lambda m: token(m[0]), text)
    if field and (m := FIELD.match(text)):
        text = token(m[1]) + m[2] + (token(m[3]) if m[3] else "") + (token(text[m.end(3) :]) if m.end(3) < len(text) else "")
    for pattern in PROTECTED.values():
        p = re.compile(pattern)
        while m := p.search(text):
            text = text[: m.start()] + token(m[0]) + text[m.end() :]
    return text, kept


def masked(df: DataFrame, text: str = "text", field: bool = False) -> DataFrame:
    """Adds masked (protected parts as tokens) and kept (those parts in order)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [protect(t, field) if isinstance(t, str) else (None, None) for t in pdf[text]]
            yield pdf.assign(masked=[m for m, _ in both], kept=[k for _, k in both])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, masked string, kept array<string>")


def unmasked(df: DataFrame) -> DataFrame:
    """masked and kept back to text, as built-in expressions; the last token first, since parts may hold earlier ones."""
    last_first = F.reverse(F.transform("kept", lambda part, i: F.struct(F.concat(F.lit(f"{OPEN}PH"), (i + 1).cast("string"), F.lit(CLOSE)).alias("token"), part.alias("part"))))
    return df.withColumn("restored", F.aggregate(last_first, F.col("masked"), lambda out, t: F.replace(out, t["token"], t["part"])))
