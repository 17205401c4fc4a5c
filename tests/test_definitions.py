"""Operators on literal rows: terminology, documents, references, ledgers, sources and sinks, streams."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import audit, documents, histograms, ledger, segments, series, tables, terms
from tallyloom.sources import readers, writers
from tallyloom.streaming import activity


def one(spark, value, f, kind="string"):
    """f of one value."""
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("v")).first().v


# text


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.normalised_term, "  Common-Cause   Variation ", "common cause variation"),
        (T.stripped, "See [the page](a.qmd){.x} <b>now</b> &amp; here [[tip]]", "See the page now here"),
        (T.html_escaped, "<a href=\"x\">Tom & 'J'</a>", "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#39;J&#39;&lt;/a&gt;"),
        (T.word_count, "one  two\nthree-four", 3),
        (T.page_url, "content/a.qmd", "content/a.html"),
        (T.directory, "a/b/c.qmd", "a/b"),
        (T.directory, "c.qmd", "."),
        (T.shortened, "x" * 200, "x" * 200),
        (T.shortened, "x" * 201, "x" * 197 + "..."),
        (T.numbers, " 1 2.5  -3\n4", [1.0, 2.5, -3.0, 4.0]),
        (T.tokens, "It's 3 o'clock, x2", ["It's", "o'clock", "x"]),
        (T.bridged_tokens, "common-cause, variation here", ["common", "cause", None, "variation", "here"]),
        (T.blank, " \n\t", True),
        (documents.content_type, "Some exercises to do", "activity"),
        (documents.content_type, "Welcome all", "narrative"),
        (documents.content_type, "An Overview and a summary", "introduction"),
        (documents.content_type, "The CONCLUSIONS", "conclusion"),
        (documents.repaired, "| am a pro-\n cess that\nvaries ] think", "I am a process that varies I think"),
        (documents.line_class, "## Title", "heading"),
        (documents.line_class, "- item", "list_item"),
        (documents.line_class, " ", "blank"),
        (documents.line_class, "Some words.", "paragraph"),
        (documents.fingerprint, "The 12th of May, a day in 1950: we saw it all there and then again", ["the", "12th", "may", "day", "1950", "saw", "all", "there"]),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, given, f) == want


def test_stable_id(spark):
    a, b = one(spark, "x", T.stable_id), one(spark, "y", T.stable_id)
    assert a != b and len(a) == 10 and a == one(spark, "x", T.stable_id) and int(a, 16) >= 0


def test_resolved_paths(spark):
    rows = [("a/b", "../c/./d.qmd", "a/c/d.qmd"), (".", "x.qmd", "x.qmd"), ("a", "../../b", "../b")]
    got = spark.createDataFrame(rows, "base string, rel string, want string").select(T.resolved(F.col("base"), F.col("rel")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)


@pytest.mark.parametrize(
    "term, aliases, text, n",
    [
        ("C++", None, "C++ and c++, not C+++x", 3),
        ("P.D.S.A. (cycle)", None, "the P.D.S.A. (cycle) turns", 1),
        ("common cause", "common-cause variation", "Common  cause and common-cause variation; uncommon cause", 2),
        ("slug-name", "free text", "Slug name, free-text, FREE TEXT", 3),
        ("na", None, "NA nab", 1),
    ],
)
def test_term_patterns(spark, term, aliases, text, n):
    assert one(spark, text, lambda c: F.regexp_count(c, F.lit(T.term_pattern(term, aliases)))) == n


# terminology


def made_segments(spark, *texts, kind="prose"):
    rows = [(t, kind, "prose" if kind == "prose" else "ui", "f.qmd", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "text string, kind string, occurrence_type string, file string, start_line int")


def test_match_terms(spark):
    given = made_segments(spark, *["A common cause   variation"] * 3, *["common-cause variation"] * 2, "nothing").unionByName(made_segments(spark, "Common cause", kind="ui-string"))
    rows = terms.match_terms(given, [("common-cause", "common cause|common-cause variation"), ("absent", None)]).orderBy("ord").collect()
    assert (rows[0].term, rows[0].frequency, rows[0].occurrence_types) == ("common-cause", 6, "prose|ui")
    assert sorted(rows[0].contexts.split(" | ")) == ["A common cause variation", "Common cause", "common-cause variation"]
    assert (rows[1].frequency, rows[1].occurrence_types, rows[1].contexts) == (0, None, None)


def test_occurrence_types(spark):
    kinds = {"yaml_value": "yaml", "prose": "prose", "r-string": "r", "ui-string": "ui", "aria-label": "ui"}
    got = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", terms.occurrence_type(F.col("k")).alias("t")).collect()
    assert {r.k: r.t for r in got} == kinds
    with pytest.raises(Exception, match="unknown kind"):
        one(spark, "other", terms.occurrence_type)


def test_ngrams_and_discovery(spark):
    texts = ["Profound knowledge, system thinking and profound knowledge"] * 5 + ["Grand Prize Winner of the deadly diseases"] * 5
    got = {r.term: (r.frequency, r.display) for r in terms.counted(terms.candidate_grams(made_segments(spark, *texts))).collect()}
    assert got["profound knowledge"] == (10, "Profound knowledge") and got["deadly diseases"][0] == 5
    assert "knowledge system" not in got and "thinking and profound" not in got
    found = {r.term for r in terms.discover(made_segments(spark, *texts), [("profound-knowledge", None)]).collect()}
    assert "profound knowledge" not in found and {"system thinking", "grand prize winner"} <= found
    assert "grand prize" not in found and "prize winner" not in found  # inside a longer one, as often
    drafted = terms.draft(made_segments(spark, *texts), [("profound-knowledge", None)]).collect()
    assert [(r.term, r.frequency, r.source) for r in drafted][0] == ("profound-knowledge", 10, "seed")
    assert [-r.frequency for r in drafted] == sorted(-r.frequency for r in drafted)


def test_capitalised_runs(spark):
    got = [r.display for r in terms.capitalised_runs(made_segments(spark, "the System of Profound Knowledge and of Joy in Work here, Out of the Woods")).collect()]
    assert got == ["System of Profound Knowledge"]  # a connector stands right before a capitalised word; three words are too few


def test_review(spark):
    schema = "term_en string, fr_rendering string, decision_needed boolean"
    draft = spark.createDataFrame([("a b", "ab", False), ("c-d", None, True), ("e", None, True), ("f", " ", True)], schema)
    auto = spark.createDataFrame([("C d", "keep english", None, "auto"), ("a-b", "translate", "other", "auto")], "term_en string, decision string, approved_fr string, reviewer_notes string")
    prior = spark.createDataFrame([("e", " ", "E", "mine"), ("c-d", "Translate", "cd", None)], "term_en string, decision string, approved_fr string, reviewer_notes string")
    got = {r.term_en: (r.approved_fr, r.decision, r.reviewer_notes, r.decision_needed) for r in terms.prepared(draft, auto, prior).collect()}
    assert got == {"a b": ("ab", "translate", None, False), "c-d": ("cd", "Translate", "auto", False), "e": ("E", None, "mine", True), "f": (None, None, None, True)}
    rows = [("a", None, ""), ("b", "", "translate"), ("c", None, " Keep English "), ("d", "x", "TRANSLATE"), ("e", None, "gloss on first use")]
    review = spark.createDataFrame(rows, "term_en string, approved_fr string, decision string")
    assert sorted(r.term_en for r in terms.unresolved(review).collect()) == ["a", "b"]
    lock = {r.term_en: json.loads(r.entry) for r in terms.locked(review.where("term_en > 'b'")).collect()}
    assert lock == {"c": {"decision": "keep-english"}, "d": {"decision": "translate", "approved_fr": "x"}, "e": {"decision": "gloss-first-use"}}
    with pytest.raises(Exception, match="unresolved: a"):
        terms.locked(review).collect()


# documents


def test_pace_labels(spark):
    rows = [
        (11, 10, None, True, "~ 11 min reading"), (11, 30, None, True, "~ 11 min reading &middot; ~ 30 min at the course&rsquo;s pace"), (11, 30, 31, False, "~ 11 min reading &middot; ~ 30 min at the course&rsquo;s pace"),
        (11, 30, 40, False, "~ 11 min reading &middot; ~ 30 min at the course&rsquo;s pace (~ 40 min on the second track)"), (11, None, None, True, "~ 11 min reading + activities"), (11, None, 40, False, "~ 11 min reading"),
    ]
    df = spark.createDataFrame(rows, "m int, s int, t int, a boolean, want string")
    assert all(r.v == r.want for r in df.select(documents.pace_label(F.col("m"), F.col("s"), F.col("t"), F.col("a")).alias("v"), "want").collect())


def test_reading_time(spark):
    page = "---\ntitle: x\n---\n# Heading\n\n" + "word " * 201 + "\n```{r}\ncode here\n```\n<b>a</b>\n: caption words\n"
    words = one(spark, page, lambda c: T.word_count(documents.countable(c)))
    assert words == 202
    got = [r.m for r in spark.createDataFrame([(49,), (50,), (200,), (201,)], "w int").select(documents.minutes(F.col("w")).alias("m")).collect()]
    assert got == [None, 1, 1, 2]
    assert one(spark, "viewof x = Inputs.textarea()", documents.has_activity) and not one(spark, "plain", documents.has_activity)


def test_text_checks(spark):
    good = "---\ntitle: A\n---\n" + "Plain words here. " * 20
    texts = {"good": good, "untitled": good[3:], "short": "---\ntitle: A\n---\n" + "w " * 60, "tagged": "---\ntitle: A\n---\n" + "<b></b>" * 60, "artefact": good + "a [A] b", "broken": good + "pro-\ncess", "gaps": good + "\n\n\na" * 4, "image": good + "![](x.png)"}
    flags = documents.checks(F.col("t"))
    got = {r.k: {n for n in flags if r[n]} for r in spark.createDataFrame(list(texts.items()), "k string, t string").select("k", *[c.alias(n) for n, c in flags.items()]).collect()}
    assert got == {"good": set(), "untitled": {"no_title"}, "short": {"short"}, "tagged": {"very_short"}, "artefact": {"artefacts"}, "broken": {"broken_words"}, "gaps": {"blank_runs"}, "image": {"image_without_alt"}}


def test_structure(spark):
    schema = "file string, figures int, headings array<string>"
    expected = spark.createDataFrame([("a", 1, ["One", "It’s two"]), ("b", 2, ["x"]), ("c", 0, [])], schema)
    actual = spark.createDataFrame([("a", 1, ["One", "It's  two"]), ("b", 2, ["x", "extra"]), ("d", 0, [])], schema)
    got = {r.file: (r.passed, r.failed) for r in documents.structure(actual, expected, ["figures", "headings"]).collect()}
    assert got == {"a": (2, 0), "b": (1, 1), "c": (0, 2), "d": (0, 2)}


def test_paragraphs_and_coverage(spark):
    text = "First line of a paragraph that is\nlong enough to count as one.\n \n12 34 56 78 90 12 34 56 78 90 12 34 56 78 90 x\n\nshort"
    got = documents.paragraphs(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()
    assert [(r.paragraph, r.text) for r in got] == [(1, "First line of a paragraph that is long enough to count as one.")]
    prints = spark.createDataFrame([(1, ["alpha", "beta", "gamma", "delta", "eta", "theta"]), (2, ["alpha", "gamma", "beta", "delta", "eta"]), (3, ["zeta", "beta"]), (4, [])], "id int, words array<string>")
    corpus = spark.createDataFrame([("Alpha, beta of gamma: delta eta. Zeta beta!",)], "text string")
    found = documents.covered(prints, corpus)
    assert {r.id: r.found for r in found.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert [tuple(r) for r in documents.coverage(found.withColumn("k", F.lit("a")), ["k"]).collect()] == [("a", 4, 2, 50)]


def test_boxes(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (1, 1.0, 1.0, 9.0, 9.0), (1, 20.0, 0.0, 5.0, 5.0), (2, 1.0, 1.0, 9.0, 9.0)]
    got = documents.without_overlaps(spark.createDataFrame(rows, "page int, x double, y double, w double, h double")).collect()
    assert sorted((r.page, r.x) for r in got) == [(1, 0.0), (1, 20.0), (2, 1.0)]


def test_site(spark):
    files = spark.createDataFrame([("content/02-b-page3.qmd", "---\ntitle: \"B\"\n---"), ("content/01-a.qmd", "---\ntitle: x\npagetitle: A\n---"), ("z.qmd", "none")], "path string, text string")
    assert [tuple(r) for r in documents.page_index(files).collect()] == [("content/01-a.qmd", 0, 1, "A"), ("content/02-b-page3.qmd", 3, 2, "B"), ("z.qmd", 0, 999, "z.qmd")]
    pages = spark.createDataFrame([("p", 2, "b.qmd", "B"), ("p", 1, "a.qmd", "A")], "part string, ord int, path string, title string")
    assert documents.site_map(pages, "/site/").first().bullets == "- [A](/site/a.html)\n- [B](/site/b.html)"
    current = spark.createDataFrame([("p", "old"), ("q", "gone")], "part string, bullets string")
    assert sorted(r.part for r in documents.stale(documents.site_map(pages, "/site/"), current).collect()) == ["p", "q"]
    assert [r.path for r in documents.orphans(pages, pages.where("ord = 1")).collect()] == ["b.qmd"]
    entries = spark.createDataFrame([("Other", 1, "o"), ("Fixed", 2, "f2"), ("Fixed", 1, "f1"), ("Added", 1, "a")], "section string, ord int, entry string")
    assert [tuple(r) for r in documents.changelog(entries, ["Added", "Changed", "Fixed"]).orderBy("place").collect()] == [(1, "Added", "- a"), (2, "Fixed", "- f1\n- f2"), (3, "Other", "- o")]
    log = spark.createDataFrame([("d/2026-01-02-x.md", "# T\nx"), ("d/2026-03-01-y.md", "y"), ("d/notes.md", "n")], "path string, text string")
    assert [tuple(r) for r in documents.dated_log(log).collect()] == [("d/2026-03-01-y.md", "y\n\n---\n"), ("d/2026-01-02-x.md", "## T\nx\n\n---\n")]
    html = '<meta name="description" content="cost $5"><meta property="og:description" content="old">'
    assert one(spark, html, documents.with_social_tags) == html.replace("old", "cost $5")
    a = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("z", b"3")], "path string, content binary")
    b = spark.createDataFrame([("x", b"1"), ("y", b"9")], "path string, content binary")
    assert {r.path: r.state for r in documents.compared(a, b).collect()} == {"x": "ok", "y": "differs", "z": "missing"}


def test_smoothing(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x * x - x) for x in range(12)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    rows = documents.smoothed(df, ["k"]).collect()
    assert all(abs(r.fit - r.y) < 1e-8 for r in rows if r.k == "a") and [r.fit for r in rows if r.k == "b"][0] is None or rows[-1].fit != rows[-1].fit


# segments

PAGE = '---\ntitle: "A page"\nformat: html\n---\n\n# Heading\n\nProse with `code` and\na second line.\n\n```{r}\nplot(x, title = "A plot")\n```\n\n```{ojs}\nviewof y = Inputs.range([0, 1], {label: "How many"})\n```\n\n<button aria-label="Press"></button>\n\nLast.'


def test_segments_round_trip(spark):
    files = spark.createDataFrame([("a.qmd", PAGE), ("b.R", 'x <- "two words" # "not this one"\ny <- "one"\n'), ("c.qmd", None), ("d.qmd", "")], "path string, text string")
    found = segments.extract(files)
    kinds = [(r.file, r.kind, r.text) for r in found.orderBy("file", "ordinal").collect()]
    assert ("a.qmd", "yaml_value", "A page") in kinds and ("a.qmd", "r-string", "A plot") in kinds and ("a.qmd", "ui-string", "How many") in kinds and ("a.qmd", "aria-label", "Press") in kinds
    assert ("a.qmd", "prose", "Prose with `code` and\na second line.") in kinds and [k for k in kinds if k[0] == "b.R"] == [("b.R", "r-string", "two words")]
    same = {r.path: r.text for r in segments.reinject(files, found).collect()}
    assert same == {r.path: r.text for r in files.collect()}
    shouted = {r.path: r.text for r in segments.reinject(files, found.withColumn("text", F.upper("text"))).collect()}
    assert shouted["b.R"] == 'x <- "TWO WORDS" # "not this one"\ny <- "one"\n'


def test_masking(spark):
    texts = [
        "See `x <- 1`, $a+b$, $$c$$, {{< meta x >}}, [@cite `k`] and @fig-x; plain.", "<span lang=fr>mot</span> <dfn id='a'>b</dfn> <button type=x>c</button>", "[p](../day-02/x.qmd#sec-page3) [q]{#sec-page4} #sec-page5",
        "\ue000PH1\ue001 `\ue000`", "", "no parts", "``a`b``",
    ]
    rows = segments.unmasked(segments.masked(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))).collect()
    assert [r.restored for r in rows] == [*texts, None]
    assert all(c not in rows[0].masked for c in "`$@{") and len(rows[0].kept) == 7 and [len(r.kept) for r in rows[1:3]] == [4, 3]
    title = segments.unmasked(segments.masked(spark.createDataFrame([('title: "A `page`"  ',)], "text string"), field=True)).first()
    assert title.restored == 'title: "A `page`"  ' and "title" not in title.masked


def test_corpus_segments(spark):
    files = spark.createDataFrame([("a.qmd", PAGE), ("b.R", 'x <- "two words"')], "path string, text string")
    got = {(r.kind, r.occurrence_type) for r in terms.corpus_segments(files).collect()}
    assert got == {("yaml_value", "yaml"), ("prose", "prose"), ("r-string", "r"), ("ui-string", "ui"), ("aria-label", "ui")}


# references

LINES = [
    ("content/day-01/a.qmd", 1, "---"), ("content/day-01/a.qmd", 2, "title: page 9"), ("content/day-01/a.qmd", 3, "---"), ("content/day-01/a.qmd", 4, "## One {#sec-page3}"),
    ("content/day-01/a.qmd", 5, "See Day 2 page 7 and [Day 1 page 3](x), also Appendix page 4 and Day 3 overall."), ("content/day-01/a.qmd", 6, "On pages 3-4 and page 99; [page 3](#sec-page3). Out of the Woods page 12."),
    ("content/day-01/a.qmd", 7, "```"), ("content/day-01/a.qmd", 8, "page 3 in code"), ("content/day-01/a.qmd", 9, "```"), ("content/day-02/b.qmd", 1, "{#sec-page7}"), ("content/day-02/c.qmd", 1, "{#sec-page7} [up](../day-01/a.qmd#sec-page3) [gone](b.qmd#sec-page8)"),
    ("content/appendix/x.qmd", 1, "{#sec-page4}"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "source_file string, source_line int, text string")


def test_anchors_and_references(lines):
    known = audit.anchors(lines)
    got = {(r.day_dir, r.page): (r.files, r.n) for r in known.collect()}
    assert got == {("day-01", 3): ("content/day-01/a.qmd", 1), ("day-02", 7): ("content/day-02/b.qmd | content/day-02/c.qmd", 2), (None, 4): ("content/appendix/x.qmd", 1)}
    concrete = {r.match: r.status for r in audit.concrete_references(lines, known).collect()}
    assert concrete == {"Day 2 page 7": "ambiguous", "Day 1 page 3": "ok"}
    appendix = audit.appendix_references(lines, known.where("day_dir is null")).collect()
    assert [(r.page, r.kind, r.files) for r in appendix] == [(4, "anchor-needed", "content/appendix/x.qmd")]


def test_bare_references(lines):
    rows = audit.bare_references(lines, audit.anchors(lines), ("Out of the Woods",), 20).collect()
    got = sorted((r.source_line, r.match, r.page, r.status, r.is_range) for r in rows)
    assert got == [(6, "page 12", 12, "external", False), (6, "page 99", 99, "unknown", False), (6, "pages 3-4", 3, "internal", True)]


def test_integrity(lines, spark):
    links = audit.links(lines)
    assert {(r.target_file, r.anchor) for r in links.collect()} == {("content/day-01/a.qmd", "sec-page3"), ("content/day-02/b.qmd", "sec-page8")}
    defined = audit.extract_matches(lines, audit.ANCHOR, ["page"]).select(F.col("source_file").alias("target_file"), F.concat(F.lit("sec-page"), "page").alias("anchor"))
    assert [r.anchor for r in audit.violations(links, defined).collect()] == ["sec-page8"]
    files = lines.select("source_file").distinct()
    more = lines.unionByName(spark.createDataFrame([("content/day-02/c.qmd", 2, "[x](none.qmd#sec-page1) [y](https://x.org/#sec-page1) [z](#sec-extra)")], lines.schema))
    wrong = {(r.target_file, r.anchor): r.reasons for r in audit.section_violations(more, files).collect()}
    assert wrong == {
        ("content/day-01/a.qmd", "sec-page3"): ["path needed"], ("content/day-02/b.qmd", "sec-page8"): ["no such anchor"], ("content/day-02/none.qmd", "sec-page1"): ["no such file"], ("content/day-02/c.qmd", "sec-extra"): ["no such anchor"],
    }
    both = audit.bound(files, spark.createDataFrame([(1,)], "n int"))
    assert both.columns == ["source_file", "n"] and both.where("n is null").count() == files.count()
    swept = audit.with_links(spark.createDataFrame([("Day 1 and [Day 1](x)",), (None,)], "text string"), "Day [0-9]", "d.qmd").collect()
    assert [r.text for r in swept] == ["[Day 1](d.qmd) and [Day 1](x)", None]
    assert [r.source_line for r in audit.fuzzy_sample(lines).collect()] == [5]


# ledgers


def test_ledgers(spark):
    a = ("2026-01-02", {"a": 1000}, ["d1"], ["1.1"], {"a": 1}, 5)
    b = ("2026-01-01", {"b": 500, "a": 1500}, ["d1", "d2"], ["1.2"], {"a": 3}, 3)
    struct = "firstSeen string, activeMsByDevice map<string,bigint>, days array<string>, chapters array<string>, actsByDevice map<string,bigint>, maxDay int"
    df = spark.createDataFrame([(a, b)], f"a struct<{struct.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array').replace(' int', ':int')}>, b struct<{struct.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array').replace(' int', ':int')}>")
    for x, y in (("a", "b"), ("b", "a")):
        m = df.select(*[c.alias(n) for n, c in ledger.merged_ledgers(x, y).items()]).first()
        assert (m.firstSeen, m.activeMsByDevice, sorted(m.days), sorted(m.chapters), m.actsByDevice, m.maxDay) == ("2026-01-01", {"a": 1500, "b": 500}, ["d1", "d2"], ["1.1", "1.2"], {"a": 3}, 5)
    assert df.select(ledger.counter_total(F.col("b.activeMsByDevice")).alias("n")).first().n == 2000


def test_ledger_documents(spark):
    new = '{"firstSeen":"2026-01-01","activeMsByDevice":{"x":5},"days":["d"],"chapters":[],"actsByDevice":{"x":1},"maxDay":2}'
    old = '{"firstSeen":"2025-01-01","activeMs":7,"acts":2,"days":[],"chapters":[],"maxDay":1}'
    rows = readers.ledgers(spark.createDataFrame([("a", new), ("b", old), ("c", "{broken"), ("d", None)], "device string, document string")).orderBy("device").collect()
    assert [(r.ledger.firstSeen, r.ledger.activeMsByDevice, r.ledger.actsByDevice) for r in rows] == [("2026-01-01", {"x": 5}, {"x": 1}), ("2025-01-01", {"b": 7}, {"b": 2}), (None, {}, {}), (None, {}, {})]


def test_active_time(spark):
    ticks = [(1, 0), (1, 5_000), (1, 20_000), (1, 90_000), (1, 91_000), (2, 0)]
    df = spark.createDataFrame([(u, i, ms) for i, (u, ms) in enumerate(ticks)], "u int, i int, ms long").withColumn("ts", F.expr("cast(timestamp_millis(ms) as timestamp_ntz)"))
    assert {r.u: r.active_ms for r in ledger.active_time(df, ["u"], "ts", ["ts", "i"]).collect()} == {1: 5_000 + 7_500 + 1_000, 2: 0}


def test_states(spark):
    rows = [(1, "a", "2026-01-02 10:00:00", 2, 1, True), (1, "a", "2026-01-01 10:00:00", 2, None, False), (1, "b", "2026-01-02 11:00:00", None, None, True)]
    df = spark.createDataFrame(rows, "u int, d string, s string, day int, chapter int, act boolean").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    states = ledger.state(df, "u", "d", "ts", F.col("day"), F.col("chapter"), F.col("act"))
    got = {r.d: (r.first_seen, r.days, r.chapters, r.max_day, r.acts) for r in states.collect()}
    assert got == {"a": ("2026-01-01", ["2026-01-01", "2026-01-02"], ["2.1"], 2, 1), "b": ("2026-01-02", ["2026-01-02"], [], 0, 1)}
    assert [tuple(r) for r in ledger.joined_states(states, "u").collect()] == [(1, "2026-01-01", 2, 1, 2, 2)]


def test_prompt(spark):
    enough, rows = 30 * 60_000, []
    for state, dismissals, since, active, days, acts, want in [
        (None, 0, 0, enough, 2, 1, True), ("none", 0, 0, enough, 2, 1, True), (None, 0, 0, enough - 1, 2, 1, False), (None, 0, 0, enough, 1, 1, False), (None, 0, 0, enough, 2, 0, False),
        ("dismissed", 1, 44, enough, 2, 1, False), ("dismissed", 1, 45, enough, 2, 1, True), ("dismissed", 2, 99, enough, 2, 1, False), ("pending", 0, 99, enough, 2, 1, False), ("submitted", 0, 99, enough, 2, 1, False),
    ]:
        rows.append((active, days, acts, state, dismissals, since, want))
    df = spark.createDataFrame(rows, "a long, d int, k int, s string, n int, x int, want boolean")
    assert all(r.v == r.want for r in df.select(ledger.should_prompt(*[F.col(c) for c in "adksnx"]).alias("v"), "want").collect())


def test_ratings_and_pages(spark):
    df = spark.createDataFrame([(1, 3, "up", 1), (1, 3, "down", 2), (1, 3, "maybe", 3), (2, 3, "maybe", 1)], "u int, c int, r string, t int")
    assert [tuple(r) for r in ledger.rated(df, "u", "c", "r", ["t"]).collect()] == [(1, 3, "down", 1)]
    events = spark.createDataFrame([("/content/days/day-03/07-a.html", "funnel"), ("/content/days/day-10/index.html", "notes"), ("/x", "scroll")], "path string, kind string")
    assert [(r.name, r.day, r.chapter) for r in ledger.page_events(events, "path", "kind").collect()] == [("funnel-run", 3, 7), ("notes-downloaded", None, None)]


# ratings


def test_rating_tables(spark):
    schema = "area int, option int, col int, rating string"
    first = spark.createDataFrame([(0, 1, 0, "+++"), (0, 1, 1, "++"), (1, 1, 0, "-"), (1, 1, 1, "+")], schema)
    assert sorted((r.area, r.col) for r in tables.own_hidden(first).collect()) == [(0, 1), (1, 0)]
    nets = {(r.area, r.option, r.col): r.effect for r in tables.net_effects(first).collect()}
    assert nets[0, 1, None] == "+++++" and nets[1, 1, None] == "0" and nets[None, None, 0] == "++"
    assert one(spark, -2, tables.shown, "int") == "−−"
    own = spark.createDataFrame([(0, 1, 0, "+"), (0, 1, 1, ""), (1, 1, 0, ""), (1, 1, 1, "+")], schema)
    added = spark.createDataFrame([(0, 1, 0, "++"), (1, 1, 0, "--"), (1, 2, 0, "+")], schema)
    made = tables.cascade(first, own, added)
    assert sorted((r.area, r.col, r.rating) for r in made["second"].collect()) == [(0, 0, "+"), (0, 1, "++"), (1, 0, "-"), (1, 1, "+")]
    assert [(r.area, r.option, r.number) for r in made["third"].collect()] == [(0, 1, 1)]
    assert sorted((r.area, r.origin, r.option, r.number) for r in made["fifth"].collect()) == [(0, 0, 1, 1), (0, 1, 1, 2), (1, 1, 2, 1)]
    cycle = ["+", "++", "+++", "0", "-", "--", "---", "+"]
    assert [one(spark, c, tables.next_rating) for c in cycle[:-1]] == cycle[1:]


# series


def test_toggles_islands_halves(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "```", "b", "```", "c", "```", "d"])], "i int, t string").withColumn("k", F.lit(0))
    inside = [r.inside for r in series.toggled(df, ["k"], ["i"], F.col("t") == "```").orderBy("i").collect()]
    assert inside == [False, True, True, False, False, True, True]
    assert [r.island for r in series.islands(df, ["k"], ["i"], F.col("t") == "```").orderBy("i").collect()] == [0, 1, 1, 2, 2, 3, 3]
    a = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0)], "k int, t long, value double")
    assert [(r.t, r.value) for r in series.concatenated(a, a, ["k"]).orderBy("t").collect()] == [(1, 5.0), (2, 6.0), (3, 5.0), (4, 6.0)]
    assert histograms.expanded(spark.createDataFrame([(3, 2), (4, 0)], "position int, count int")).count() == 2


# sources and sinks


def test_csv_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# a comment\nx,y\n1,2.5\n# more\n3,4\n")
    assert [tuple(r) for r in readers.commented_csv(spark, str(tmp_path / "c.csv"), "x int, y double").collect()] == [(1, 2.5), (3, 4.0)]
    (tmp_path / "q.csv").write_text('a,b\n"x, ""y""","two\nlines é"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.quoted_csv(spark, str(tmp_path / "q.csv"), "a string, b string").collect()] == [('x, "y"', "two\nlines é")]
    assert readers.quoted_csv(spark, str(tmp_path / "none.csv"), "a string", optional=True).count() == 0
    with pytest.raises(Exception):
        readers.quoted_csv(spark, str(tmp_path / "none.csv"), "a string").count()


def test_file_sources_and_sink(spark, tmp_path):
    texts = {"a.qmd": "one\n\ntwo\n", "sub/b.qmd": "no newline at the end é", "c.R": "x <- 1\n"}
    writers.text(spark.createDataFrame([*texts.items(), ("null.qmd", None)], "path string, text string"), f"file://{tmp_path}/out")
    assert {os.path.relpath(p, tmp_path / "out"): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/out/**/*.*", recursive=True)} == {k: v.encode() for k, v in texts.items()}
    read = {os.path.basename(r.path): (r.text, r.trailing_newline) for r in readers.whole_files(spark, str(tmp_path / "out"), "*.qmd").collect()}
    assert read == {"a.qmd": (texts["a.qmd"], True), "b.qmd": (texts["sub/b.qmd"], False)}
    rows = readers.line_table(spark, str(tmp_path / "out"), "*.qmd").collect()
    assert sorted((os.path.basename(r.source_file), r.source_line, r.text) for r in rows) == [("a.qmd", 1, "one"), ("a.qmd", 2, ""), ("a.qmd", 3, "two"), ("a.qmd", 4, ""), ("b.qmd", 1, "no newline at the end é")]
    assert [(r.corpus, os.path.basename(r.path)) for r in readers.corpora(spark, str(tmp_path / "out"), ("*.qmd", "*.R")).collect()] == [("qmd", "a.qmd"), ("qmd", "b.qmd"), ("R", "c.R")]
    page = spark.createDataFrame([("---\ntitle: 'T'\ndescription: \"D\"\n---\nx", "p"), ("none", "q")], "text string, path string")
    got = page.select(*[c.alias(n) for n, c in readers.front_matter(F.col("text"), F.col("path")).items()]).collect()
    assert [tuple(r) for r in got] == [("T", "D"), ("q", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ('b "q"', "x,y", 2)], "k string, v string, n int").coalesce(1)
    read = lambda name: "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/{name}/part-*")))
    writers.csv(df, f"{tmp_path}/csv")
    assert read("csv") == 'k,v,n\na,,1\n"b ""q""","x,y",2\n'
    writers.csv_with_mark(df, f"{tmp_path}/mark")
    assert read("mark").startswith('﻿"k","v","n"\n"a","","1"\n')
    entries = spark.createDataFrame([("b", '{"x":"1"}'), ("a", '{"y":"2"}')], "k string, e string")
    assert json.loads(writers.json_document(entries, "k", "e").first().value) == {"a": {"y": "2"}, "b": {"x": "1"}}
    assert writers.download(df, ["n", "k"], ["n"]).first().text == '1\ta\n2\tb "q"'
    writers.json_lines(df, f"{tmp_path}/json")
    assert [json.loads(x)["n"] for x in read("json").splitlines()] == [1, 2]


def test_simulated_sources(spark):
    dice = readers.process(spark, "dice", 2000, 3)
    r = dice.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m")).first()
    assert 2 <= r.lo and r.hi <= 12 and abs(r.m - 7) < 0.3 and dice.collect() == readers.process(spark, "dice", 2000, 3).collect()
    beads = readers.process(spark, "beads", 300, 3).agg(F.avg("value").alias("m"), F.max("value").alias("hi")).first()
    assert abs(beads.m - 10) < 0.7 and beads.hi <= 50
    for kind, mean in (("normal", 0), ("uniform", 0), ("exponential", 1)):
        assert abs(readers.samples(spark, kind, 20_000, 5).agg(F.avg("value")).first()[0] - mean) < 0.05


# streams


def test_streams(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", 1.0), (1, "2026-01-01 00:00:30", 2.0), (1, "2026-01-01 00:05:00", 3.0), (2, "2026-01-01 00:00:10", 4.0), (9, "2026-01-02 12:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user_id int, s string, value double").select("user_id", F.to_timestamp("s").alias("ts"), "value")
    df.write.parquet(f"{tmp_path}/in")

    def run(make, name):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.user_id, r.events) for r in run(activity.sessions, "sessions")) == [(1, 1), (1, 2), (2, 1)]
    latest = run(lambda s: activity.latest_values(s, ["user_id"], "value", quiet="60 seconds"), "latest")
    assert sorted((r.user_id, r.value) for r in latest) == [(1, 2.0), (1, 3.0), (2, 4.0)]
    limits = run(lambda s: activity.running_limits(s, "user_id", "value"), "limits")
    assert sorted((r.user_id, r.n, r["mean"]) for r in limits) == [(1, 3, 2.0), (2, 1, 4.0)]
