"""The corpus pipeline against brute force, each stage on what the stage before it kept."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8))) for _ in range(400)]
    passage = r.choices(vocabulary, k=60)
    base = r.choices(vocabulary, k=150)
    texts = [None, "", " \n ", "too short", "# $ | " * 30, "same line here\n" * 20, "SHOUT LOUD! " * 3]
    for i in range(40):
        w = r.choices(vocabulary, k=r.randrange(20, 200))
        if i % 4 == 0:
            w[10:10] = passage
        texts.append(" ".join(w))
    for edits in (0, 0, 1, 2, 3):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
        texts.append(" ".join(w))
    texts.append(" ".join(passage))
    texts.append(" ".join(r.choices(vocabulary, k=4000)))
    return [(i, t, None, ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and returned, and what run() returned."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, given, folder)
        made.write.parquet(f"{folder}/stage{i}")
        made = spark.read.parquet(f"{folder}/stage{i}")
        assert name == corpus_pipeline.STAGES[-1][0] or made.columns == COLUMNS
        out.append(([tuple(x) for x in given.collect()], [tuple(x) for x in made.collect()]))
        given = made
    return out, [tuple(x) for x in corpus_pipeline.run(spark, folder).collect()]


def votes(text):
    """The votes of all rules, and whether the base check fails."""
    text = text or ""
    w = WORDS.findall(text)
    solid = SPACES.sub("", text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
    found = Counter(windows)
    again = len({p + j for p, g in enumerate(windows) if found[g] > 1 for j in range(5)})
    n, c = len(w), len(solid)
    symbols = sum(x in "#*$%&|<>" for x in solid)
    part = lambda a, b: a / b if b else None
    values = [
        (n, lambda v: v < 15, lambda v: v >= 40),
        (part(c, n), lambda v: v < 2.5 or v > 13, lambda v: 3.5 <= v <= 10),
        (part(symbols, n), lambda v: v > 0.2, lambda v: v < 0.05),
        (part(symbols, c), lambda v: v > 0.04, lambda v: v < 0.01),
        (part(again, n), lambda v: v > 0.2, lambda v: v < 0.1),
        (part(len(lines) - len(set(lines)), len(lines)), lambda v: v > 0.3, lambda v: v < 0.1),
        (part(sum("A" <= x <= "Z" for x in solid), c), lambda v: v > 0.4, lambda v: v < 0.15),
        (part(solid.count("!"), n), lambda v: v > 0.5, lambda v: v < 0.1),
    ]
    return [0 if v is None else -1 if bad(v) else 1 if good(v) else 0 for v, bad, good in values], n < 10 or 100 * again > 20 * n


def test_quality(steps):
    given, made = steps[0][0]
    voted = [votes(d[1])[0] for d in given]

    def good(v, bad, rules):
        odds = math.log((1 - bad) / bad)
        for x, (hit, false) in zip(v, rules):
            odds += math.log(false / hit) if x == -1 else math.log((1 - false) / (1 - hit)) if x == 1 else 0
        return 1 / (1 + math.exp(-odds))

    bad, rules = 0.1, [(0.3, 0.01)] * 8
    weight = 0.2 * len(given)
    for _ in range(15):
        p = [good(v, bad, rules) for v in voted]
        new = []
        for k in range(8):
            rates = []
            for q, prior, share in (([1 - x for x in p], 0.3, 0.1), (p, 0.01, 0.9)):
                hits, held = (sum(x for x, v in zip(q, voted) if v[k] in of) for of in ((-1,), (-1, 1)))
                rates.append(min(0.999, max(0.001, (hits + prior * weight * share) / (held + weight * share))))
            new.append(tuple(rates))
        bad, rules = min(0.9, max(0.01, (sum(1 - x for x in p) + 0.1 * weight) / (len(given) + weight))), new
    want = [d for d, v in zip(given, voted) if not votes(d[1])[1] and good(v, bad, rules) >= 0.5]
    assert sorted(made) == sorted(want)
    assert 0 < len(made) < len(given)


def test_near_duplicates(steps):
    given, made = steps[0][1]
    given = sorted(given)
    sets = []
    for d in given:
        w = WORDS.findall(d[1].lower())
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))})
    least, changed = list(range(len(given))), True
    while changed:
        changed = False
        for i in range(len(given)):
            for j in range(i):
                if least[i] != least[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    assert sorted(made) == [d for i, d in enumerate(given) if least[i] == i]
    assert len(made) < len(given)


def test_repeats(steps):
    given, made = steps[0][2]
    first, want = {}, []
    for d in sorted(given):
        w = WORDS.findall(d[1])
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), d[0])
    for d in given:
        w = WORDS.findall(d[1])
        gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < d[0] for j in range(13)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone)
        if text:
            want.append((d[0], text, d[2], d[3], len(text)))
    assert sorted(made) == sorted(want)
    assert sum(d[4] for d in made) < sum(d[4] for d in given)


def test_mixture(steps):
    given, made = steps[0][3]
    by_source = {}
    for d in given:
        by_source.setdefault((d[3] is None, d[3]), []).append((d, len(WORDS.findall(d[1]))))
    keys = sorted(by_source, key=lambda k: (k[0], k[1] or ""))
    words = {k: sum(n for _, n in by_source[k]) for k in keys}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    total, target = 1.5 * sum(words.values()), {}
    while len(target) < len(keys):
        left = [k for k in keys if k not in target]
        level = (total - sum(target.values())) / sum(weight[k] for k in left)
        over = [k for k in left if level * weight[k] > 2 * words[k]]
        target |= {k: 2.0 * words[k] for k in over} if over else {k: level * weight[k] for k in left}
    want = Counter()
    for k in keys:
        whole = int(target[k] // words[k])
        rest = target[k] - whole * words[k]

        long, short = (sum(n for _, n in by_source[k] if (n >= 50) == x) for x in (True, False))
        c = rest / (long + 0.5 * short) if long + short else 0
        if c > 1:
            c = (rest - long) / (0.5 * short)
            chance = lambda n, c=c: 1.0 if n >= 50 else 0.5 * c
        else:
            chance = lambda n, c=c: max(1e-9, c * (1.0 if n >= 50 else 0.5))

        def rank(row):
            u = (int(hashlib.md5(f"mix:{row[0][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
            p = chance(row[1])
            return u / (1 - u) / (p / (1 - p)) if p < 1 else 0.0, row[0][0]

        before, drawn, other = 0, [], []
        for d, n in sorted(by_source[k], key=rank):
            (drawn if before + n <= rest else other).append((d, n))
            before += n
        gap = rest - sum(n for _, n in drawn)
        nearer = [(abs(n - gap), i) for i, (_, n) in enumerate(other) if abs(n - gap) < gap]
        if nearer:
            drawn.append(other[min(nearer)[1]])
        taken = {d[0] for d, _ in drawn}
        for d, _ in by_source[k]:
            want[d] += whole + (d[0] in taken)
    assert Counter(made) == +want


def test_packed(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    given, made = steps[0][4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies = Counter(d[0] for d in given)
    ids = {d[0]: t.encode(d[1], add_special_tokens=False).ids + [0] for d in given}
    covered, sequences = {i: [0] * len(x) for i, x in ids.items()}, {}
    for doc_id, start, length, crc, total, sequence, offset in made:
        piece = ids[doc_id][start : start + length]
        assert len(piece) == length > 0 and total == len(ids[doc_id])
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == crc
        for p in range(start, start + length):
            covered[doc_id][p] += 1
        sequences.setdefault(sequence, []).append((offset, length))
    assert all(set(c) == {copies[i]} for i, c in covered.items())
    for held in sequences.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end == 1024 or end < 1024 and end & (end - 1) == 0


def test_run_is_the_stages(steps):
    """Which pieces there are depends on the order of rows; what they hold does not."""
    stages, whole = steps
    tokens = lambda rows: sorted(Counter({i: sum(r[2] for r in rows if r[0] == i) for i in {r[0] for r in rows}}).items())
    assert tokens(whole) == tokens(stages[-1][1])
