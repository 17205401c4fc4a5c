"""Language ID: error-correcting output codes over character n-grams.

Each language has a codeword of `bits` bits; a binary linear classifier over hashed character n-grams (of letters,
lower-cased, a space between words) is trained for every bit.  A text's language is the one whose codeword has the
smallest loss-weighted distance (logistic loss of the bit margins); texts whose two nearest codewords are about as
near are flagged.

Training reads about `per_language` labelled documents of each language, chosen by a hash of the id against a threshold
that follows from the language's count; their n-gram counts are made on the executors, and the classifiers are trained
from the sparse rows, a mini-batch of them dense at a time.  Prediction reads every whole text, as a stream of numbers; nothing is
shuffled.

Nulls and odd cases: texts that are null or have no letter are `und` with score 0; null labels are not learned from;
without any labelled row all is `und`; with one language all texts with a letter are of it; repeated rows and null ids
are returned as they are; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_bytes, sampled

BUCKETS = 1 << 13
NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray | None:
    """Square roots of hashed counts of the 2- and 3-grams of letters, of length 1; None if there is no letter."""
    s = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not s:
        return None
    c = np.frombuffer(f" {s} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F) + np.uint64(1)
    x = np.concatenate([two, three]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)
    v = np.sqrt(np.bincount(x.astype(np.int64), minlength=BUCKETS).astype(np.float32))
    return v / np.sqrt((v * v).sum())


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1: of many random codes the one with the largest smallest distance between codewords, no bit
    being the same for all."""
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice([-1, 1], (n, bits))
        for b in np.nonzero(abs(code.sum(0)) == n)[0]:
            code[rng.integers(n), b] *= -1
        far = (code[:, None] != code[None]).sum(2)
        least = far[~np.eye(n, dtype=bool)].min() if n > 1 else bits
        if least > most:
            best, most = code, least
    return best


def train(at: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, n: int, bits: int, rounds: int = 30, rate: float = 0.03, decay: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias, codewords) of logistic bit classifiers by AdaGrad over mini-batches of sparse rows (at, value);
    languages weigh the same in total."""
    code = codewords(n, bits)
    goal = code[y].astype(np.float32)
    weight = (len(y) / n / np.bincount(y, minlength=n).clip(1))[y].astype(np.float32)
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    sw, sb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for first in range(0, len(y), 64):
            pick = order[first : first + 64]
            used, back = np.unique(np.concatenate([at[i] for i in pick]), return_inverse=True)
            x = np.zeros((len(pick), len(used)), np.float32)
            x[np.repeat(np.arange(len(pick)), [len(at[i]) for i in pick]), back] = np.concatenate([value[i] for i in pick])
            g = -goal[pick] / (1 + np.exp(np.clip(goal[pick] * (x @ w[used] + b), -30, 30))) * (weight[pick] / len(pick))[:, None]
            gw, gb = x.T @ g + decay * w[used] / len(pick), g.sum(0)
            sw[used] += gw * gw
            sb += gb * gb
            w[used] -= rate * gw / np.sqrt(sw[used])
            b -= 0.1 * rate * gb / np.sqrt(sb)
    return w, b, code


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 2 << 20):
        label, at, value = [], [], []
        for lang, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            v = features(text)
            if v is not None:
                i = np.nonzero(v)[0]
                label.append(lang)
                at.append(i.astype(np.int32))
                value.append(v[i])
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["label", "at", "value"])


def fit(docs: DataFrame, label: str = "lang", per_language: int = 300, bits: int = 15) -> dict | None:
    """A model from the labelled rows of docs(doc_id, text, label); None without any that has a letter."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias("label"))
    got = sampled(rows, "doc_id", "label", per_language).select("text", "label").mapInArrow(_feature_rows, "label string, at array<int>, value array<float>").toPandas()
    if not len(got):
        return None
    got = got.sort_values("label", kind="stable")
    names = sorted(set(got["label"]))
    y = np.array([names.index(v) for v in got["label"]])
    w, b, code = train([np.asarray(x, np.int64) for x in got["at"]], [np.asarray(x, np.float32) for x in got["value"]], y, len(names), bits)
    return {"names": names, "weights": w, "bias": b, "code": code}


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Probabilities of the codewords from bit margins: softmax of minus the loss-weighted distances."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def _predict_rows(model: dict | None, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            names, scores, flags = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for first in range(0, len(texts), 256):
                rows, found = [], []
                for i, text in enumerate(texts[first : first + 256], first):
                    v = features(text) if text and model else None
                    if v is not None:
                        rows.append(i)
                        found.append(v)
                if rows:
                    p = decode(np.stack(found) @ model["weights"] + model["bias"], model["code"])
                    order = np.sort(p, 1)
                    for i, j, q in zip(rows, p.argmax(1).tolist(), order):
                        names[i], scores[i], flags[i] = model["names"][j], float(q[-1]), bool(len(q) > 1 and q[-1] - q[-2] < ambiguous)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(flags)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: dict | None, ambiguous: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of docs(doc_id, text)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_predict_rows(model, ambiguous), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
