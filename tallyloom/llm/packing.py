"""Packing: bounded-space online packing of token sequences.

Each input partition keeps at most `open_windows` open windows.  A document's tokens (and its end id) are cut into
full windows and a rest; the rest goes to the open window that it fills best; if it fits none, the fullest is emitted,
filled up with the head of the rest if `cut` allows it.  Windows still open at a partition's end travel on with their
token ids, at most open_windows * size ids a partition, and are merged by the same rule, `fan_in` partitions at a
time, until one task holds the last of them.  What is left then is cut into windows of power-of-two lengths, which
need no padding.

Every id lies in exactly one piece, and pieces of a sequence follow each other without gaps.  Token ids are not
shuffled, but for those of open windows.  Sequence ids are (round, task, counter) packed into a long, the same when a
task is run again.

Nulls and odd cases: a null text is an empty document, which is its end id alone; repeated rows are packed as often as
they occur; a null id is kept as it is; a text of any length is packed whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, by_bytes
from tallyloom.llm.token_counts import _STATE, Remembered, encoded, local_file, split, splitting

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, window int, ids binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 8 + [pa.int32(), pa.binary()]


class Packer:
    """Best fit into a bounded number of open windows.  Pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, size: int, open_windows: int, first_id: int, cut: int):
        self.size, self.most, self.next, self.cut = size, open_windows, first_id, cut
        self.room: list[tuple[int, int]] = []  # (free tokens, key), sorted
        self.windows: dict[int, list[tuple]] = {}
        self.key = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, None, None, None))
            offset += n
        self.next += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        whole = len(ids) // (4 * self.size)
        for i in range(whole):
            self.emit([(doc_id, start + i * self.size, total, ids[4 * i * self.size : 4 * (i + 1) * self.size])])
        if whole:
            start, ids = start + whole * self.size, ids[4 * whole * self.size :]
        if ids:
            self.place([(doc_id, start, total, ids)])

    def place(self, pieces: list[tuple]) -> None:
        """Put pieces, together shorter than a window, into the open window that leaves least room."""
        n = sum(len(p[3]) for p in pieces) // 4
        while True:
            i = bisect_left(self.room, (n, -1))
            if i < len(self.room):
                free, key = self.room.pop(i)
                held = self.windows.pop(key) + pieces
                if free == n:
                    self.emit(held)
                else:
                    self.keep(held, free - n)
                return
            if len(self.room) < self.most:
                self.keep(pieces, self.size - n)
                return
            free, key = self.room.pop(0)
            held = self.windows.pop(key)
            if self.cut and free >= self.cut:
                head, pieces = divide(pieces, free)
                n -= free
                held += head
            self.emit(held)

    def keep(self, pieces: list[tuple], free: int) -> None:
        self.windows[self.key] = pieces
        insort(self.room, (free, self.key))
        self.key += 1

    def open_rows(self, task: int) -> list[tuple]:
        return [(doc_id, start, len(ids) // 4, None, total, None, None, task, w, ids) for w, pieces in enumerate(self.windows.values()) for doc_id, start, total, ids in pieces]

    def close(self) -> None:
        """Fill windows to the brim from what is open and cut the last rest into powers of two."""
        pieces = [p for w in self.windows.values() for p in w]
        left = sum(len(p[3]) for p in pieces) // 4
        while left:
            n = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            head, pieces = divide(pieces, n)
            self.emit(head)
            left -= n
        self.windows, self.room = {}, []


def divide(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    """The first n tokens of pieces, and the rest."""
    head = []
    for i, (doc_id, start, total, ids) in enumerate(pieces):
        m = len(ids) // 4
        if m > n:
            if n:
                head.append((doc_id, start, total, ids[: 4 * n]))
            return head, [(doc_id, start + n, total, ids[4 * n :]), *pieces[i + 1 :]]
        head.append((doc_id, start, total, ids))
        n -= m
        if not n:
            return head, pieces[i + 1 :]
    return head, []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(NAMES), TYPES)], names=NAMES)


def _pack_rows(file: str, end: int, size: int, open_windows: int, cut: int, batch_bytes: int, remember: int):
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = local_file(file)
        special = splitting(path)
        known: Remembered = _STATE.setdefault(f"ids {path}", Remembered(remember))
        task = TaskContext.get().partitionId()
        packer = Packer(size, open_windows, task << 32, cut)
        for batch in by_bytes(batches, "text", batch_bytes):
            if special is None:
                made = [ids.tobytes() + stop for ids in encoded(path, [(t or b"").decode() for t in batch.column("text").to_pylist()], 64 << 10)]
            else:
                codes, distinct, first = split(batch.column("text"), special)
                fresh = known.unknown(distinct)
                known.add(dict(zip(fresh, [ids.tobytes() for ids in encoded(path, [p.decode() for p in fresh], 64 << 10)])))
                own = [known[p] for p in distinct]
                known.trim()
                # the ids of all pieces in order, taken from those of the distinct ones
                flat, n = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
                end_of = np.cumsum(n[codes])
                place = np.repeat((np.cumsum(n) - n)[codes] - (end_of - n[codes]), n[codes]) + np.arange(end_of[-1] if len(end_of) else 0)
                ids, at = flat[place].tobytes(), (4 * np.append(0, end_of)[first]).tolist()
                made = [ids[a:b] + stop for a, b in zip(at, at[1:])]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), made):
                packer.add(doc_id, 0, len(ids) // 4, ids)
            if len(packer.out) > 5000:
                yield _batch(packer.out)
                packer.out = []
        yield _batch(packer.out + packer.open_rows(task))

    return run


def _merge_rows(size: int, open_windows: int, cut: int, turn: int, last: bool):
    """Sorted rows of open windows -> pieces, and the windows then open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(size, open_windows, (turn << 56) + (task << 32), cut)
        now, held = None, []
        for batch in batches:
            for doc_id, start, total, key, window, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "task", "window", "ids"))):
                if (key, window) != now:
                    if held:
                        packer.place(held)
                    now, held = (key, window), []
                held.append((doc_id, start, total, ids))
            if packer.out:
                yield _batch(packer.out)
                packer.out = []
        if held:
            packer.place(held)
        if last:
            packer.close()
        yield _batch(packer.out + packer.open_rows(task))

    return run


def pack(docs: DataFrame, file: str, end: int = 0, size: int = 1024, open_windows: int = 64, cut: int = 1, fan_in: int = 64, batch_bytes: int = 4 << 20, remember: int = 200_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of docs(doc_id, text).

    cut: the fewest tokens of room that a document is cut for when it fits no open window; 0: never, such windows are
    padded.
    """
    if size & (size - 1) or size < 2:
        raise ValueError("size must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = scratch.keep(texts.mapInArrow(_pack_rows(file, end, size, open_windows, cut, batch_bytes, remember), SCHEMA), "packed")
    done, waiting, turn = [made.where("ids is null")], made.where("ids is not null"), 0
    tasks = made.where("ids is not null").agg(F.max("task")).first()[0]
    groups = (tasks or 0) + 1
    while True:
        groups, turn = -(-groups // fan_in), turn + 1
        dealt = waiting.withColumn("task", F.col("task").cast("long")).repartitionByRange(groups, F.floor(F.col("task") / fan_in)) if groups > 1 else waiting.coalesce(1)
        dealt = dealt.sortWithinPartitions("task", "window", "doc_id", "start")
        made = scratch.keep(dealt.mapInArrow(_merge_rows(size, open_windows, cut, turn, groups == 1), SCHEMA), f"merged{turn}")
        done.append(made.where("ids is null"))
        waiting = made.where("ids is not null")
        if groups == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*NAMES[:7])
