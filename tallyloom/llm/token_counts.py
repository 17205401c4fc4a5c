"""Token counts: batch encoding in Arrow functions that return lengths only.

Record batches are cut so that each has about `batch_bytes` of text, however long single texts are.  A text is split at
safe boundaries and only the lengths of the pieces are added up.  The distinct pieces of a batch that the worker does
not remember are encoded in calls of about `call_bytes` each; a worker remembers the last `remember` to twice as many
pieces, none of more than LONGEST characters.

Safe boundaries: before white space, and between a letter and an ASCII punctuation mark other than the apostrophe.
They hold for byte-level BPE with the usual split into words, where a word takes the space before it along, and for
tokenizers that drop white space and split words from marks; the tokenizer's own file tells (`splitting`).  For all
others (sentencepiece may join pieces across spaces) whole texts are encoded.  Special strings inside texts stay in one
piece; they count as the library has them by default.  A run without a safe boundary is encoded whole, whatever its
length.

Nulls and odd cases: a null text counts as empty; an empty text has no tokens; repeated rows and null ids are returned
as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_bytes

_W = " \\t\\n\\r\\x0b\\x0c"
_WIDE = "\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A piece of a text: ASCII white space and what stands behind it.  Where other white space than ASCII's stands before a
#: space, the piece goes on.
PIECE = re.compile(f"[{_W}]*[^{_W}]+(?:(?<=[{_WIDE}])[{_W}]+[^{_W}]*)*|[{_W}]+")
SPACE, LETTER, MARK, LEAD, MORE, ODD = 1, 2, 4, 8, 16, 32
#: Classes of bytes.  LEAD: first of a letter U+00C0-U+023F (two bytes); ODD: perhaps of other white space than ASCII's.
KIND = np.zeros(256, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = MARK
KIND[0xC3:0xC9] = LEAD
KIND[0x80:0xC0] = MORE
KIND[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = ODD
#: Pieces of more bytes are not remembered.
LONGEST = 64
_STATE: dict[str, object] = {}


class Remembered(dict):
    """What is known of pieces, in two generations of `most` each: the older goes when the younger is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older, self.long = most, {}, []

    def __missing__(self, piece):
        self[piece] = value = self.older[piece]
        return value

    def unknown(self, pieces: list) -> list:
        older = self.older
        return [p for p in pieces if p not in self and p not in older]

    def add(self, new: dict) -> None:
        self.update(new)
        self.long = [p for p in new if len(p) > LONGEST]

    def trim(self) -> None:
        """To be called when a batch is done."""
        for piece in self.long:
            del self[piece]
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


def split(texts: pa.Array, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, distinct, first) of a binary array: its texts cut at safe boundaries, piece by piece an index into the
    distinct pieces; text i has the pieces from first[i] to first[i + 1].  Vectorised over the bytes of the batch; only
    texts with white space other than ASCII's or special strings are cut one by one."""
    texts = pc.fill_null(texts, b"").cast(pa.binary())
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge -= edge[0]
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        space, letter, lead = kind == SPACE, kind == LETTER, kind == LEAD
        letter[1:] |= lead[:-1] & (kind[1:] == MORE) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        cut[1:-1] = space[1:] & ~space[:-1] | (kind[1:] == MARK) & letter[:-1]
        odd = np.nonzero(kind == ODD)[0]
        raw = data.tobytes() if special else b""
        found = [m.start() for s in special for m in re.finditer(re.escape(s), raw)]
        for i in np.unique(np.searchsorted(edge, np.concatenate([odd, np.array(found, np.int64)]), "right") - 1).tolist():
            text = data[edge[i] : edge[i + 1]].tobytes().decode()
            if any(s.decode() in text for s in special) or re.search(f"[{_WIDE}]", text):
                cut[edge[i] : edge[i + 1]] = False
                cut[edge[i] + np.cumsum([len(p.encode()) for p in PIECE.findall(text)])] = True
    cut[edge] = True
    at = np.nonzero(cut[:-1])[0]
    first = np.searchsorted(at, edge)
    offsets = np.append(at, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_pylist(), first


@lru_cache(maxsize=None)
def splitting(path: str) -> tuple[bytes, ...] | None:
    """The special strings of the tokenizer of a file if texts may be cut for it, else None; see the module's docstring."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    if any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t["added_tokens"]):
        return None
    special = tuple(a["content"].encode() for a in t["added_tokens"])
    normal, pre = t.get("normalizer"), t.get("pre_tokenizer") or {"type": None}
    if normal is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return special
    first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
    plain = all(n["type"] in ("NFC", "NFD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in (normal.get("normalizers", [normal]) if normal else []))
    # a split that keeps only runs without white space
    removes = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (
        first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and not re.search(r"(?<!\[\^)\\s|\.| ", first["pattern"].get("Regex", " "))
    )
    return special if plain and removes else None


def tokenizer(path: str):
    """The tokenizer of a file on this worker, loaded once; one thread, without truncation or padding."""
    import os

    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            if hasattr(t.model, "_resize_cache"):  # pieces are remembered here
                t.model._resize_cache(0)
        else:
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
        _STATE[path] = t
    return _STATE[path]


def local_file(path: str) -> str:
    """A vocabulary file's place on this machine: a path, or the name of a file of the public_tokenizers package."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def encoded(path: str, pieces: list[str], call_bytes: int) -> Iterator[np.ndarray]:
    """Token ids (unsigned 32-bit) of each piece, encoded in calls of about call_bytes."""
    t = tokenizer(path)
    start = held = 0
    for i in range(len(pieces) + 1):
        if i == len(pieces) or held >= call_bytes:
            if i > start and path.endswith(".json"):
                # pieces as words of one text: each is split and encoded by itself
                e = t.encode(pieces[start:i], is_pretokenized=True, add_special_tokens=False)
                ids, of = np.array(e.ids, np.uint32), np.array([-1 if w is None else w for w in e.word_ids], np.int64)
                if (of < 0).any():  # special strings
                    yield from (np.array(e.ids, np.uint32) for e in t.encode_batch_fast(pieces[start:i], add_special_tokens=False))
                else:
                    at = np.searchsorted(of, np.arange(i - start + 1)).tolist()
                    yield from (ids[a:b] for a, b in zip(at, at[1:]))
            elif i > start:
                yield from (np.array(x, np.uint32) for x in t.encode(pieces[start:i], num_threads=1))
            start, held = i, 0
        if i < len(pieces):
            held += len(pieces[i])


def _count_rows(file: str, batch_bytes: int, call_bytes: int, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = local_file(file)
        special = splitting(path)
        known: Remembered = _STATE.setdefault(f"lengths {path}", Remembered(remember))
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = batch.column("text")
            if special is None:
                counts = [len(ids) for ids in encoded(path, [(t or b"").decode() for t in texts.to_pylist()], call_bytes)]
            else:
                codes, distinct, first = split(texts, special)
                fresh = known.unknown(distinct)
                known.add(dict(zip(fresh, map(len, encoded(path, [p.decode() for p in fresh], call_bytes)))))
                n = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
                total = np.append(0, np.cumsum(n[codes]))
                counts = total[first[1:]] - total[first[:-1]]
                known.trim()
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, file: str, batch_bytes: int = 4 << 20, call_bytes: int = 64 << 10, remember: int = 300_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs(doc_id, text); no shuffle.  See the module's docstring."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_count_rows(file, batch_bytes, call_bytes, remember), f"doc_id {kind}, n_bytes long, n_tokens long")
