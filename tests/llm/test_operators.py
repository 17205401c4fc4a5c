"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import math
import random
import re
import zlib

import pytest

from tallyloom.llm import embedding_dedup, language_id, minhash_dedup, packing, quality_rules, source_mixing, substring_dedup, token_counts, toxicity, url_filter
from tallyloom.llm.queries import URL_RULES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def roots(n, links):
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    return least


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ünï", "x y"]
    base = [r.choice(vocabulary) for _ in range(90)]
    out = [None, "", " \n\t ", "one", "Two words", "a b c d e"]
    for _ in range(25):
        w = list(base)
        for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append(" ".join(w))
    out += [" ".join(r.choices(vocabulary, k=40)) + "\n" + " ".join(base[20:50]) for _ in range(6)]
    return [*out, out[-1], " ".join(r.choices(vocabulary, k=9000)), "z" * 100_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "a" if i % 3 else None, 0, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, texts, none):
    split = [WORDS.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(split):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for hot in (2000, 1):
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, hot=hot).collect()}
        for i, w in enumerate(split):
            gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for j in range(13)}
            assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
            assert got[i].kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(docs, texts, none, percent):
    sets = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, percent).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]
    if percent == 80:
        assert minhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("few", [None, 0])
def test_minhash_divided_buckets(spark, monkeypatch, few):
    """Copies that are near to a base, few of them near to each other; few = 0: buckets are divided whatever their size."""
    if few is not None:
        monkeypatch.setattr(minhash_dedup, "FEW", few)
        monkeypatch.setattr(minhash_dedup, "FEW_DIVIDED", few)
        monkeypatch.setattr(minhash_dedup, "TURNS", 2)
    r = random.Random(1)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 2, 4, 5])):
            at = r.randrange(200)
            w[at : at + r.choice([0, 1, 1])] = [] if r.random() < 0.2 else [f"x{r.randrange(40)}"]
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, bands=20).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_embeddings(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        rows.append([r.gauss(0, 1) for _ in range(8)] if i % 3 else [x + r.gauss(0, 0.3) for x in (1.0, 2.0, 0.0, -1.0, 0.5, 0.0, 1.0, 3.0)])
    rows += [rows[0], rows[0], None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")

    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    links = [(i, j) for i in range(len(rows)) for j in range(i) if fine(rows[i]) and fine(rows[j]) and cosine(rows[i], rows[j]) >= 0.9]
    want = roots(len(rows), links)
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df, 0.9, tile_bytes=1024).collect()}
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), want[i], want[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_packing_round_trip(docs, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    rows = packing.pack(docs, "byte_bpe_50k.json", open_windows=2).collect()
    starts, sequences = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r.ids_crc32
        starts.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held, whole in [*((starts[i], len(x)) for i, x in enumerate(ids)), *((s, None) for s in sequences.values())]:
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end == whole if whole is not None else end <= 1024
    assert packing.pack(none, "byte_bpe_50k.json").count() == 0


def test_token_counts(docs, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, "word_bpe_49k.json", batch_bytes=500).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    assert token_counts.count_tokens(none, "word_bpe_49k.json").count() == 0


def test_quality_measures(docs, texts, none):
    extra = docs.sparkSession.createDataFrame([(1000, "# a|b\n# a|b\n\n# a|b <x>"), (1001, "a b c d e a b c d e f")], "doc_id long, text string")
    all_texts = {**dict(enumerate(texts)), 1000: "# a|b\n# a|b\n\n# a|b <x>", 1001: "a b c d e a b c d e f"}
    voted = quality_rules.with_votes(docs.select("doc_id", "text").unionByName(extra)).drop("text")
    for r in quality_rules.judge(voted, quality_rules.fit(voted)).collect():
        text = all_texts[r.doc_id] or ""
        w = WORDS.findall(text)
        windows = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        again = {p + j for p, g in enumerate(windows) if len(w) < 500 and windows.count(g) > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if len(w) < 500:
            assert r.n_repeat_words == len(again)
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
        assert not (r.base_failed and r.kept)
    empty = quality_rules.with_votes(none.select("doc_id", "text"))
    assert quality_rules.judge(empty, quality_rules.fit(empty)).count() == 0


def test_mixing(docs, texts, none):
    one, two = ({r.doc_id: r for r in source_mixing.mix(docs).collect()} for _ in range(2))
    assert one == two and len(one) == len(texts)
    for r in one.values():
        assert r["size"] == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
    assert source_mixing.mix(none).count() == 0


def test_mixing_includes_by_weight(spark):
    """Documents of a weight are taken as often as their inclusion probabilities say, which add up to the target; many
    sources, ranges of a few ranks, repeated rows."""
    rows = [(i, f"s{i % 40:02}", "w " * (60 if i % 3 else 20)) for i in range(2400)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, source string, text string")
    taken, n = {60: 0, 20: 0}, 4
    for seed in range(n):
        got = source_mixing.mix(df, weights=(1,), share=0.6, seed=f"s{seed}", range_rows=16).collect()
        words = {}
        for r in got:
            taken[r["size"]] += r.copies
            words[r.source] = words.get(r.source, 0) + r.taken
        assert len(got) == 2401 and all(abs(w - r.target) <= 30 for r in got for w in [words[r.source]])
    # of a source with 40 long and 20 short documents: c (40 * 60 + 0.5 * 20 * 20) = 0.6 * 2800
    c = 0.6 * 2800 / 2600
    assert taken[60] / n / 1600 == pytest.approx(c, abs=0.03) and taken[20] / n / 800 == pytest.approx(c / 2, abs=0.06)


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.com", "https://www.example.com/en/a?x", "http://a.example.com/en/", "http://b.net/es/x#y", "http://notcom/", "ftp://b.net?x=/es/", "http://hub.org/"]
    html = [None] * 9 + ['<a href="http://b.net/es/x">x</a>']
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string"), URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [("", "", None), ("", "", None), ("", "", None), ("a.com", "", None), ("www.example.com", "/en/a", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("b.net", "/es/x", "net/es/"), ("notcom", "/", None), ("b.net", "", None), ("hub.org", "/", None)]
    assert [got[i].verdict for i in (4, 5, 6, 9)] == ["allow", "block", "block", "block"]


def test_language_id(spark):
    r = random.Random(2)
    made = {"aa": ["bado", "kiru", "mela", "tona"], "bb": ["schwe", "pflug", "icht", "ung"], "cc": ["ção", "lho", "nha", "em"]}
    rows = [(i, " ".join(r.choices(made[lang], k=12)), lang) for i, lang in enumerate(r.choices(list(made), k=90))]
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "12 34", "aa"), (92, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 <> 1"))
    got = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(got[i].lang_pred == "und" for i in (90, 91, 92))
    assert language_id.fit(df.limit(0)) is None


@pytest.mark.parametrize("toxic", [lambda a, b: a & b, lambda a, b: 1 - (a ^ b)], ids=["both", "alike"])
def test_toxicity_learns_a_pair(spark, toxic):
    """Neither term alone is toxic; alike: nor does either say anything by itself."""
    r = random.Random(4)
    rows = []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        w = r.choices([f"n{k}" for k in range(50)], k=8) + ["insult"] * a + ["group"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w), toxic(a, b)))
    df = spark.createDataFrame([*rows, (5000, None, None), (5001, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id % 5 <> 0").select("doc_id", "toxic"), df.select("doc_id", "text"))
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert sum(right) / len(right) > 0.95 and all(0 <= s <= 1 for s in got.values())
