"""Word and n-gram hashes in numpy, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes of text hashed at a time.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes; empty if it is shorter than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, p = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(p)
        p = p * BASE & MASK
    return mix(out)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a batch of texts (a binary array; null: none), as places in one buffer: word i
    is data[start[i]:end[i]], text k has the words first[k] to first[k + 1]; lower: A-Z are lower-cased.  Vectorised over the batch's bytes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, b"").cast(pa.binary())
        edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.edge = edge - edge[0]
        self.space = (self.data == 32) | (self.data - np.uint8(9) < 5)
        inner = np.zeros(len(self.data) + 1, bool)
        inner[self.edge] = True
        before = np.append(True, self.space) | inner
        after = np.append(self.space, True) | inner
        self.start = np.nonzero(~self.space & before[:-1])[0]
        self.end = np.nonzero(~self.space & after[1:])[0] + 1
        self.first = np.searchsorted(self.start, self.edge)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit polynomial hashes of the words; equal words have equal ones."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = self.start[at]
            to = max(int(np.searchsorted(self.start, low + (4 << 20))), at + 1)
            n = int(self.end[to - 1] - low)
            up, down = _powers(n)
            sums = np.append(np.uint64(0), np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n]))
            s, e = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
        return out

    def single_spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(buffer, starts, ends) of the words with at most one space, and nothing else, between words of a text."""
        kept = ~self.space
        kept[self.end[self.end < len(self.data)]] = True
        place = np.append(0, np.cumsum(kept))
        return np.where(self.space, np.uint8(32), self.data)[kept].tobytes(), place[self.start], place[self.end]


#: A-Z to a-z.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and their inverses, kept for the usual size."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, CHUNK + 4096)
    made = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (BASE, pow(BASE, -1, MASK + 1))]
    if size <= 8 * CHUNK:
        _POWERS[:] = made
    return made[0], made[1]
