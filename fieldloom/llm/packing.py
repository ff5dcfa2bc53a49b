"""Sum-of-squares online packing of tokenized documents into sequences of a fixed length.

Two steps with one shuffle between: texts become ids where they lie; then packers, each for so many
documents, take what is left of a document after its whole windows and place it by the rule.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_map, settled
from .tokens import vocabulary

#: Documents for one packer: the packers grow with the corpus, what each holds does not.
PER_PACKER = 32_768
#: Documents a packer has at least, where there are more cores than packers of PER_PACKER.
LEAST = 1024
#: Tasks that packers are dealt to, at most: a shuffle has no more partitions, however many documents there are.
TASKS = 16_384
#: Sequence ids of a packer start at its number times this; so do the numbers of a partition's rows.
STRIDE = 1 << 36
FIELDS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))


class SumOfSquares:
    """Windows of `size` ids; `levels[h]` counts the open windows filled to h.

    An item of s ids (s < size) goes to the level h, h + s <= size, that leaves the sum of the
    squared counts least: moving a window from h to h + s changes it by 2 (N[h+s] - N[h] + 1), or by
    1 - 2 N[h] if that fills it, and a new window by 2 N[s] + 1. Ties go to the fullest window.
    A full window closes.
    """

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]

    def place(self, item, s: int):
        """Puts the item of s ids; the contents of the window that it fills, or None."""
        n, size = self.levels, self.size
        cost = 2 * (n[s:size] - n[: size - s] + 1)  # old level h = 0 .. size - s - 1
        cost[0] = 2 * n[s] + 1
        cost[1:][n[1 : size - s] == 0] = 1 << 40
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        full = size - s
        if n[full] and 1 - 2 * n[full] <= cost[h]:
            h = full
        if h:
            window = self.windows[h].pop()
            n[h] -= 1
        else:
            window = []
        window.append(item)
        if h + s == size:
            return window
        self.windows[h + s].append(window)
        n[h + s] += 1
        return None

    def rest(self) -> list[list]:
        """Takes the open windows out, the fullest first."""
        out = [w for h in range(self.size - 1, 0, -1) for w in self.windows[h]]
        self.windows = [[] for _ in range(self.size)]
        self.levels[:] = 0
        return out


def topped_up(windows: list[list], size: int) -> list[list]:
    """The windows open at the end, the fullest first, made whole: a gap takes ids of the emptiest window
    left, cut where the gap ends, so only the emptiest are cut. What remains at last is laid end to end
    in falling powers of two. Items are (key, start, ids)."""
    out, todo = [], deque(windows)
    spare: list = []  # pieces of the window that is being cut, the next one last

    def fill(current: list, goal: int) -> bool:
        filled = sum(len(x[2]) for x in current)
        while filled < goal and (spare or todo):
            if not spare:
                spare.extend(reversed(todo.pop()))
            key, start, ids = spare.pop()
            take = min(goal - filled, len(ids))
            current.append((key, start, ids[:take]))
            filled += take
            if take < len(ids):
                spare.append((key, start + take, ids[take:]))
        return filled == goal

    while todo:
        current = todo.popleft()
        if fill(current, size):
            out.append(current)
        else:
            spare = current[::-1]
    left = sum(len(x[2]) for x in spare)
    for k in range(size.bit_length(), -1, -1):
        if left >> k & 1:
            out.append(current := [])
            fill(current, 1 << k)
    return out


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The file's ids by rank merging, which gives those of its own library (tests compare them)."""
    v = vocabulary(path)
    return tiktoken.Encoding("file", pat_str=v.pattern.pattern, mergeable_ranks=v.ranks(), special_tokens=dict(v.special))


def encode(path: str, texts: list[str]) -> list[list[int]]:
    e = encoder(path)
    special = set(e._special_tokens)
    return [e.encode(t, allowed_special=special) if any(s in t for s in special) else e.encode_ordinary(t) for t in texts]


class Splitter:
    """Texts to rows: whole windows without their ids, and the rest of a document with them."""

    def __init__(self, tokenizer: str, size: int, eos: int, packers: int, partition: int, id_type: pa.DataType, whole_ids: bool):
        self.tokenizer, self.size, self.eos, self.packers, self.id_type, self.whole_ids = tokenizer, size, eos, packers, id_type, whole_ids
        self.item, self.partition = partition * STRIDE, partition

    def __call__(self, batch: pa.RecordBatch):
        docs, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            of, rows = [], []
            for i, ids in enumerate(encode(self.tokenizer, [t or "" for t in texts.slice(at, 256).to_pylist()])):
                ids.append(self.eos)
                ids = np.array(ids, "<u4")
                packer = (self.partition + self.item % STRIDE) % self.packers
                whole = len(ids) - len(ids) % self.size
                for start in [*range(0, whole, self.size), *[whole] * (whole < len(ids))]:
                    part = ids[start : start + self.size]
                    short = part.astype("<u2") if part.max() < 65536 else part
                    of.append(at + i)
                    rows.append((packer, self.item, start, len(part), crc32(part.tobytes()), len(ids), short.tobytes() if self.whole_ids or len(part) < self.size else None))
                self.item += 1
            types = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(of)), *cols], names=["doc_id", "packer", "item", "start", "length", "crc", "doc_tokens", "ids"])


class Packer:
    """Rows of Splitter, sorted by packer, to pieces; each packer has its own level array."""

    def __init__(self, size: int, id_type: pa.DataType, keep_ids: bool):
        self.size, self.id_type, self.keep_ids = size, id_type, keep_ids
        self.now, self.next, self.squares = None, 0, SumOfSquares(size)

    def emit(self, window: list, rows: list) -> None:
        offset = 0
        for (doc, total), start, ids in window:
            rows.append((doc, start, len(ids), crc32(ids.tobytes()), total, self.next, offset) + ((ids.tolist(),) if self.keep_ids else ()))
            offset += len(ids)
        self.next += 1

    def batch(self, rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        arrays = [pa.array(cols[0], self.id_type), *(pa.array(c, t) for c, (_, t) in zip(cols[1:7], FIELDS))]
        names = ["doc_id", *(n for n, _ in FIELDS)]
        if self.keep_ids:
            arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def __call__(self, batch: pa.RecordBatch):
        rows: list = []
        for doc, packer, start, length, crc, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packer", "start", "length", "crc", "doc_tokens", "ids"))):
            if packer != self.now:
                self.close(rows)
                self.now, self.next = packer, packer * STRIDE
            if length == self.size and not self.keep_ids:
                rows.append((doc, start, length, crc, total, self.next, 0))
                self.next += 1
                continue
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")
            if length == self.size:
                self.emit([((doc, total), start, ids)], rows)
            elif full := self.squares.place(((doc, total), start, ids), length):
                self.emit(full, rows)
        if rows:
            yield self.batch(rows)

    def close(self, rows: list) -> None:
        for window in topped_up(self.squares.rest(), self.size):
            self.emit(window, rows)

    def finish(self):
        rows: list = []
        self.close(rows)
        if rows:
            yield self.batch(rows)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, eos: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all rows.

    A document is its ids and `eos`. Whole windows of it are sequences of their own; the ids of its
    rest are shuffled, once, to one packer for every PER_PACKER documents (fewer documents, but LEAST, where
    that leaves cores idle), and placed there online by SumOfSquares. Up to TASKS packers have a task each;
    more follow each other in a task. What is open when a packer has placed all its documents is topped up: the emptiest
    windows are cut to fill the others, the last ids go to sequences of falling powers of two, so no
    sequence has padding. Rows have numbers by partition and place, packers take them in that order:
    a task that is run again gives the same rows; docs that come out of a shuffle are written first.
    Memory: a packer's open windows, at most PER_PACKER of them.

    Null and empty texts are one `eos`. Null ids stay null, repeated rows are packed each for
    itself. An empty table gives no rows. Other columns are not read, whatever their names.
    `size` must be a power of two; sequence_id is unique, not gapless.
    """
    if size & (size - 1) or size < 2:
        raise ValueError("size must be a power of two")
    docs = settled(docs.select(id_col, text_col), "pack")
    field = docs.schema[id_col]
    count = docs.count()
    packers = max(1, -(-count // PER_PACKER), min(docs.sparkSession.sparkContext.defaultParallelism, count // LEAST))
    tasks = min(packers, TASKS)
    id_type = field.dataType.simpleString()

    def splitter():
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        return Splitter(tokenizer, size, eos, packers, TaskContext.get().partitionId(), to_arrow_type(field.dataType), with_ids)

    def packer():
        from pyspark.sql.pandas.types import to_arrow_type

        return Packer(size, to_arrow_type(field.dataType), with_ids)

    rests = arrow_map(docs, splitter, f"doc_id {id_type}, packer int, item bigint, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary")
    dealt = rests.repartitionById(tasks, (F.col("packer") * F.lit(tasks).cast("bigint") / packers).cast("int")).sortWithinPartitions("packer", "item", "start")
    return arrow_map(dealt, packer, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)


def materialize(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): each sequence's ids in order, from pack(..., with_ids=True).

    A sequence has at most its size of pieces, so no group is large. A piece of a null doc_id keeps
    it in doc_ids; repeated rows are pieces of their own; an empty table gives no rows.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))
