"""Substring dedup: repeated-phrase automata.

A window is `window` consecutive words of one document.  A word goes if a window over it also starts in a document
with a smaller id.  Windows are judged on the input.

1. Phrases.  Of the `window - anchor + 1` runs of `anchor` words in a window, the one with the smallest hash is its
   phrase.  It depends on the window's words alone, so that equal windows have equal phrases.  Phrases that start in at
   least two documents recur; a window whose phrase does not is unique.
2. Passages.  The documents that hold recurring phrases are read with the list of theirs; each run of windows around
   one recurring phrase is a passage.  A passage is dealt to its phrase's shard, and to no other: the windows of another
   shard have other phrases and cannot occur in it.  Equal passages are summed up before they move on (smallest id).
3. Automata.  Each shard compiles Aho-Corasick automata of its passages' windows, a bounded number of windows at a time,
   larger ids first, so that the smallest id that holds a window stays with it.  All the shard's passages are streamed
   through the automaton, one character a word, which locates every window word for word and gives its owner.
4. Windows whose owner is a smaller id are joined to their documents and the words that they cover go.

Skew: a phrase of more than `hot` occurrences is dealt by window instead, where equal windows are summed up before the
shuffle; joins have both sides shuffled so that adaptive execution can split them.  Only numbers and passages that may
repeat are shuffled, the text twice.  Nothing is capped.

Nulls and odd cases: a null or empty text has no words and nothing is removed; rows with a null id keep all words and
remove none elsewhere; rows that repeat an id are all returned and do not remove each other's words; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, by_bytes
from tallyloom.llm.hashing import Words, grams, mix

#: Windows that one automaton holds, about; one shard is not divided.  Small ones stay in the processor's cache.
AUTOMATON = 2_000
BATCH_BYTES = 1 << 20


def anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a sequence of word hashes: its anchor's hash, and the anchor's place in the sequence."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    a = grams(h, anchor)
    n = len(h) - window + 1
    best, at = a[:n].copy(), np.arange(n)
    for j in range(1, window - anchor + 1):
        other = a[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.nonzero(less)[0] + j
    return best, at


class Windows:
    """The windows of a batch of texts: text number, anchor and its place for every word at which one starts."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.words = Words(texts)
        self.hash = self.words.hashes()
        self.best, self.at = anchors(self.hash, window, anchor)
        self.text = self.words.text_of()[: len(self.best)]
        self.inside = np.arange(len(self.best)) + window <= self.words.first[1:][self.text]

    def runs(self, keep: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and last windows of runs of kept windows of a text with one anchor; single ones stand alone."""
        keep = keep & self.inside
        begin = keep.copy()
        same = (self.at[1:] == self.at[:-1]) & (self.text[1:] == self.text[:-1]) & keep[:-1]
        if single is not None:
            same &= ~single[1:] & ~single[:-1]
        begin[1:] &= ~same
        return np.nonzero(begin)[0], np.nonzero(keep & np.append(begin[1:] | ~keep[1:], True)[: len(keep)])[0]


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            w = Windows(batch.column("text"), window, anchor)
            first = w.runs(np.ones(len(w.best), bool))[0]
            # an anchor of a text once, with the number of its passages
            order = first[np.lexsort((w.best[first], w.text[first]))]
            new = np.append(True, (w.best[order][1:] != w.best[order][:-1]) | (w.text[order][1:] != w.text[order][:-1]))[: len(order)]
            at = np.nonzero(new)[0]
            n = np.diff(np.append(at, len(order))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w.best[order[at]].view(np.int64)), batch.column("doc_id").take(pa.array(w.text[order[at]])), pa.array(n)], names=["anchor", "doc_id", "n"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array of lists of longs, and the row that each is of."""
    values = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.view(np.uint64), pa.compute.list_parent_indices(lists).to_numpy().astype(np.uint64)


def _passage_rows(window: int, anchor: int):
    """(shard, passage, doc_id, version, start): the runs of windows around a recurring anchor; for hot ones each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            w = Windows(batch.column("text"), window, anchor)
            # an anchor of a text as one number; should two fall together, a passage too many is looked at
            of = lambda value, row: mix(value + (row + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            mine = of(w.best, w.text.astype(np.uint64))
            keep = np.isin(mine, of(*_flat(batch.column("anchors"))))
            single = np.isin(mine, of(*_flat(batch.column("hot"))))
            first, last = w.runs(keep, single)
            shard = np.where(single[first], grams(w.hash, window)[first], w.best[first]).view(np.int64)
            text, start, end = w.words.single_spaced()
            passage = [text[a:b] for a, b in zip(start[first].tolist(), end[last + window - 1].tolist())]
            row = pa.array(w.text[first])
            at = pa.array((first - w.words.first[:-1][w.text[first]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(passage, pa.binary()), batch.column("doc_id").take(row), batch.column("version").take(row), at], names=["shard", "passage", "doc_id", "version", "start"])

    return run


def located(passages: list[bytes], owners: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, values): for the windows of each passage, in order, the smallest owner of a passage that holds them.

    An automaton of all windows, larger owners first, through which the passages are streamed as one text of a
    character a word; passages are single-spaced."""
    import ahocorasick

    joined = b" ".join(passages) + b" "
    space = np.frombuffer(joined, np.uint8) == 32
    offsets = np.append(0, np.nonzero(space)[0] + 1).astype(np.int32)
    code = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode().indices.to_numpy().astype(np.uint32)
    # characters from 1 on, without the surrogates
    code += np.where(code >= 0xD7FF, 2049, 1).astype(np.uint32)
    size = np.array([p.count(b" ") + 1 for p in passages])
    begin = np.cumsum(size) - size
    stream = code.tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton()
    add = automaton.add_word
    for i in np.argsort(-np.array(owners), kind="stable").tolist():
        owner, low = owners[i], int(begin[i])
        for at in range(low, low + int(size[i]) - window + 1):
            add(stream[at : at + window], owner)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(stream)), np.int64).reshape(-1, 2)
    # the stream's windows that cross from one passage to the next are none
    of = np.repeat(np.arange(len(size)), size)[hits[:, 0]]
    inside = hits[:, 0] - window + 1 >= begin[of]
    return size - window + 1, hits[inside, 1]


def _owner_rows(window: int, most: int):
    """Rows (shard, passage, owner, key, key2) sorted by shard -> (key, key2, owners): for each window of the
    passage the smallest owner of a passage that holds it."""

    def put(held: list[list]) -> pa.RecordBatch:
        _, passage, owner, key, key2 = held
        counts, values = located(passage, owner, window)
        owners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(key2, pa.int32()), owners], names=["key", "key2", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        n = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "passage", "owner", "key", "key2")]
            shards = np.array(columns[0], np.int64)
            edges = [0, *(np.nonzero(shards[1:] != shards[:-1])[0] + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:]):
                if n >= most and held[0][-1] != columns[0][a]:
                    yield put(held)
                    held, n = [[], [], [], [], []], 0
                for h, c in zip(held, columns):
                    h.extend(c[a:b])
                n += sum([p.count(b" ") + 2 - window for p in columns[1][a:b]])
        if held[0]:
            yield put(held)

    return run


def _kept_rows(window: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            words = Words(batch.column("text"))
            text, start, end = words.single_spaced()
            value, row = _flat(pa.compute.if_else(pa.compute.is_null(batch.column("starts")), pa.scalar([], batch.column("starts").type), batch.column("starts")))
            edge = np.zeros(len(words.start) + 1, np.int64)
            value, row = value.astype(np.int64), row.astype(np.int64)
            at = (value + words.first[row])[value + window <= words.count[row]]
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + window, 1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.append(0, np.cumsum(gone))
            removed = total[words.first[1:]] - total[words.first[:-1]]
            kept = []
            for n, r, a, b in zip(words.count.tolist(), removed.tolist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                if not r:
                    kept.append(text[start[a] : end[b - 1]] if n else b"")
                else:
                    kept.append(b" ".join([text[start[i] : end[i]] for i in (np.nonzero(~gone[a:b])[0] + a).tolist()]))
            columns = [batch.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carry], names=["doc_id", "n_words", "n_removed", "kept_text", *carry])

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = 13, anchor: int = 6, hot: int = 2000) -> DataFrame:
    """(doc_id, version, starts): for each document the first words of its windows that also start in a smaller id;
    version is the hash of the text, for rows that share an id."""
    if not 0 < anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    pairs = scratch.keep(texts.mapInArrow(_anchor_rows(window, anchor), "anchor long, doc_id long, n int"), "pairs")
    recurring = pairs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    recurring = scratch.keep(recurring.select("anchor", (F.col("n") > hot).alias("hot")), "recurring")
    lists = pairs.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    lists = scratch.keep(lists, "lists")
    scratch.drop("pairs")
    scratch.drop("recurring")
    passages = texts.withColumn("version", F.hash("text")).join(lists, "doc_id").mapInArrow(_passage_rows(window, anchor), "shard long, passage binary, doc_id long, version int, start int")
    passages = scratch.keep(passages, "passages", "zstd")
    scratch.drop("lists")
    # 96 bits stand for a passage's words, which tell its shard, on the way back
    keys = [F.xxhash64("passage").alias("key"), F.hash("passage").alias("key2")]
    distinct = passages.groupBy("shard", "passage").agg(F.min("doc_id").alias("owner")).select("shard", "passage", "owner", *keys)
    distinct = distinct.repartition("shard").sortWithinPartitions("shard")
    owners = distinct.mapInArrow(_owner_rows(window, AUTOMATON), "key long, key2 int, owners array<long>")
    found = passages.select(*keys, "doc_id", "version", "start").join(owners, ["key", "key2"])
    found = found.select("doc_id", "version", F.expr("filter(transform(owners, (o, i) -> if(o < doc_id, start + i, -1)), x -> x >= 0)").alias("at")).where("size(at) > 0")
    found = scratch.keep(found.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("at")).alias("starts")), "starts")
    scratch.drop("passages")
    return found


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = 6, hot: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, *carry) for every row of docs(doc_id, text, *carry); see the module's
    docstring."""
    scratch = Scratch(docs.sparkSession, "repeats")
    starts = repeated_windows(docs, scratch, window, anchor, hot)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carry)
    joined = texts.join(starts, (texts["doc_id"] == starts["doc_id"]) & (F.hash(texts["text"]) == starts["version"]), "left").select(*[texts[c] for c in texts.columns], "starts")
    kinds = "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(_kept_rows(window, carry), f"doc_id long, n_words long, n_removed long, kept_text string{kinds}")
