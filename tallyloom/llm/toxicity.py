"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the distinct known terms of a text: the
pairwise part learns what a linear model cannot, such as an insult together with the mention of a group.  Terms are
hashed into `buckets`.  Known are those in `least` training documents or more that tell something about the label, by
themselves or with another: terms whose log odds ratio between the labels is at least `screen` standard errors from 0,
and terms of a pair whose interaction with the label (the log odds ratio of the two terms' log odds ratios) is at least
`pair_screen` standard errors from 0, for all pairs of terms in a share of `pair_share` of the training documents or
more.  All others count nothing, so that long clean texts gather no noise.

Training reads about `per_label` labelled documents of each label, chosen by a hash of the id against a threshold that
follows from the label's count; their term hashes are made on the executors.  Scoring reads every whole text and
shuffles nothing.

Nulls and odd cases: null labels are not learned from; null and empty texts have no terms and get the base score;
without rows of both labels every score is the share of label 1 among the rows (0 without rows); repeated rows and null
ids are returned as they are; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_bytes, sampled

TERM = re.compile(r"\w+")


class Terms(dict):
    """Buckets of terms; keeps the first `limit` it meets."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, term: str) -> int:
        h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % self.buckets
        if len(self) < self.limit:
            self[term] = h
        return h


_TERMS: dict[int, Terms] = {}


def terms(text: str | None, buckets: int) -> np.ndarray:
    """The distinct buckets of a text's lower-cased terms, sorted."""
    seen = set(TERM.findall((text or "").lower()))
    of = _TERMS.setdefault(buckets, Terms(buckets)).__getitem__
    return np.unique(np.fromiter(map(of, seen), np.int64, len(seen)))


def train(rows: list[np.ndarray], y: np.ndarray, size: int, factors: int, rounds: int, rate: float = 0.1, decay: float = 2e-4, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """(w0, w, v) by AdaGrad over shuffled batches; labels weigh the same in total."""
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, factors))
    s0, sw, sv = 1e-8, np.full(size, 1e-8), np.full((size, factors), 1e-8)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for first in range(0, len(y), 64):
            pick = order[first : first + 64]
            at = np.concatenate([rows[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            vs = v[at]
            total = np.zeros((len(pick), factors))
            np.add.at(total, doc, vs)
            square = np.bincount(doc, (vs * vs).sum(1), len(pick))
            z = w0 + np.bincount(doc, w[at], len(pick)) + 0.5 * ((total * total).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            used, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, g[doc], len(used)) + decay * w[used] / len(pick)
            gv = np.zeros((len(used), factors))
            np.add.at(gv, back, g[doc][:, None] * (total[doc] - vs))
            gv += decay * v[used]
            s0 += g.sum() ** 2
            sw[used] += gw**2
            sv[used] += gv**2
            w0 -= rate * g.sum() / s0**0.5
            w[used] -= rate * gw / np.sqrt(sw[used])
            v[used] -= 0.5 * rate * gv / np.sqrt(sv[used])
    return w0, w, v


def screened(rows: list[np.ndarray], y: np.ndarray, buckets: int, least: int, screen: float) -> np.ndarray:
    """The buckets to know by themselves: frequent enough, with a log odds ratio of at least `screen` standard errors."""
    counts = []
    for label in (1, 0):
        n = np.bincount(np.concatenate([t for t, v in zip(rows, y) if v == label]), minlength=buckets)
        counts.append((n + 0.5, (y == label).sum() - n + 0.5))
    (a, b), (c, d) = counts
    z = (np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.nonzero((a + c - 1 >= least) & (abs(z) >= screen))[0]


def paired(rows: list[np.ndarray], y: np.ndarray, buckets: int, least: float, screen: float, block: int = 256) -> np.ndarray:
    """The buckets to know for a pair: of two that are in `least` documents or more and whose three-way interaction with
    the label is at least `screen` standard errors from 0.  Counted by products of 0/1 matrices, block by block."""
    often = np.nonzero(np.bincount(np.concatenate(rows), minlength=buckets) >= least)[0]
    if len(often) < 2:
        return often[:0]
    place = np.full(buckets, -1, np.int32)
    place[often] = np.arange(len(often))
    x = np.zeros((len(rows), len(often)), np.float32)
    for i, t in enumerate(rows):
        t = place[t]
        x[i, t[t >= 0]] = 1
    top = np.zeros(len(often), np.float32)
    for low in range(0, len(often), block):
        effect, spread = 0.0, 0.0
        for label, sign in ((1, 1), (0, -1)):
            of = x[y == label]
            both, one, other = of[:, low : low + block].T @ of, of[:, low : low + block].sum(0)[:, None], of.sum(0)[None]
            for n, s in ((both, sign), (one - both, -sign), (other - both, -sign), (len(of) - one - other + both, sign)):
                effect = effect + s * np.log(n + 0.5)
                spread = spread + 1 / (n + 0.5)
        z = abs(effect) / np.sqrt(spread)
        z[np.arange(z.shape[0]), low + np.arange(z.shape[0])] = 0
        top = np.maximum(top, z.max(0))
    return often[top >= screen]


def _term_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([terms(t, buckets) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["label", "terms"])

    return run


def fit(labels: DataFrame, docs: DataFrame, per_label: int = 3000, buckets: int = 1 << 20, factors: int = 4, least: int = 5, screen: float = 3.0, pair_share: float = 0.02, pair_screen: float = 8.0, rounds: int = 20) -> dict:
    """A model from labels(doc_id, toxic 0/1) of docs(doc_id, text).

    The sample is chosen among the labels, before texts are read; it is broadcast: about 2 * per_label rows at most.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = sampled(rows, "doc_id", "label", per_label)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = sample.mapInArrow(_term_rows(buckets), "label int, terms array<bigint>").toPandas()
    texts, y = [np.asarray(t, np.int64) for t in got["terms"]], got["label"].to_numpy(float)
    order = sorted(range(len(y)), key=lambda i: (y[i], texts[i].tobytes()))  # whatever the order of tasks
    return learned([texts[i] for i in order], y[order], buckets, factors, least, screen, pair_share, pair_screen, rounds)


def learned(texts: list[np.ndarray], y: np.ndarray, buckets: int, factors: int = 4, least: int = 5, screen: float = 3.0, pair_share: float = 0.02, pair_screen: float = 8.0, rounds: int = 20) -> dict:
    """The model of texts as distinct buckets, with labels 0 and 1."""
    if len(set(y)) < 2:
        return {"buckets": buckets, "base": float(y.mean()) if len(y) else 0.0}
    known = np.union1d(screened(texts, y, buckets, least, screen), paired(texts, y, buckets, max(least, pair_share * len(y)), pair_screen))
    place = np.full(buckets, -1, np.int32)
    place[known] = np.arange(len(known))
    inside = [place[t] for t in texts]
    w0, w, v = train([t[t >= 0] for t in inside], y, len(known), factors, rounds)
    return {"buckets": buckets, "known": known, "w0": w0, "w": w, "v": v}


def _score_rows(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = model["buckets"]
        if "known" in model:
            place = np.full(buckets, -1, np.int32)
            place[model["known"]] = np.arange(len(model["known"]))
        for batch in by_bytes(batches, "text", 2 << 20):
            scores = []
            for text in batch.column("text").to_pylist():
                if "base" in model:
                    scores.append(model["base"])
                    continue
                t = place[terms(text, buckets)]
                t = t[t >= 0]
                v = model["v"][t]
                total = v.sum(0)
                z = model["w0"] + model["w"][t].sum() + 0.5 * float(total @ total - (v * v).sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_score_rows(model), f"doc_id {kind}, score double")
