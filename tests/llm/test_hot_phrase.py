"""Substring dedup of a document in which one phrase stands 100,000 times, each time in other company."""

import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import substring_dedup
from tallyloom.llm.hashing import Words, grams


def test_phrase_in_many_contexts(spark):
    r = random.Random(9)
    tried = [[f"p{i}_{j}" for j in range(6)] for i in range(3000)]
    hashes = [int(grams(Words(pa.array([" ".join(t).encode()], pa.binary())).hashes(), 6)[0]) for t in tried]
    phrase = " ".join(tried[int(np.argmin(np.array(hashes, np.uint64)))])  # so small a hash that it is its windows' phrase
    units = [f"{phrase} x{r.randrange(300)}" for _ in range(100_000)]
    texts = {2: " ".join(units), 1: " ".join(units[500:520] + ["between"] + units[90_000:90_003]), 3: f"new words then {' '.join(units[7:10])} end"}
    split = {i: t.split() for i, t in texts.items()}
    keys = {i: [" ".join(w[p : p + 13]) for p in range(len(w) - 12)] for i, w in split.items()}
    owner = {}
    for i in sorted(keys):
        for k in keys[i]:
            owner.setdefault(k, i)
    want = {}
    for i, w in split.items():
        gone = np.zeros(len(w), bool)
        for p, k in enumerate(keys[i]):
            if owner[k] < i:
                gone[p : p + 13] = True
        want[i] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))
    assert want[2][1] > 280 and want[3][1] == 21
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want
