"""Substring dedup of different texts under one id, against brute force."""

from collections import Counter

import pytest

from tallyloom.llm import substring_dedup


@pytest.mark.parametrize("hot", [2000, 1])
def test_texts_that_share_an_id(spark, hot):
    passage = [f"p{i}" for i in range(30)]
    own = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(1, passage), (2, own("a", 40) + passage + own("b", 5)), (2, own("c", 60)), (2, own("d", 3)), (2, []), (2, passage[:20] + own("e", 20)), (2, own("c", 60)), (3, own("c", 20))]
    first, want = {}, []
    for i, w in rows:
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    for i, w in rows:
        gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), w[0] if w else "-"))
    docs = spark.createDataFrame([(i, " ".join(w) if w else None, w[0] if w else "-") for i, w in rows], "doc_id long, text string, lang string").repartition(3)
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs, hot=hot, carry=("lang",)).collect())) == Counter(want)
