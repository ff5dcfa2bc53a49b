"""SentencePiece encoding by streaming Viterbi, and decoding.

Boundaries of a text form a lattice whose edges are pieces. Only the boundaries within the longest
piece's length of the current one can still be reached from, so only they survive; as soon as the paths
from all survivors run through one boundary, the ids before it are final and leave. A boundary that no
piece reaches across is always such a one.

Edge weights depend on the model. Unigram: a piece's score, the best sum wins. BPE: a piece may follow
another only if merging would leave the two as they are; each boundary then has one path, which is
the one that merging gives (adding up a BPE model's scores would give other ids than its library).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map

SPACE = "▁"
#: Chunks and pairs a worker remembers before it starts afresh.
CACHE = 600_000
#: Fewer texts of one length than this are streamed one by one: arrays cost more than they save.
FEW = 8
#: Slots, as a power of two, of the table of pairs met before, and of that of pieces.
PAIR_BITS, PIECE_BITS = 21, 20
BASE, SPREAD, MASK = 0x100000001B3, 0x9E3779B97F4A7C15, (1 << 64) - 1
POWERS = [np.uint64(pow(BASE, i, 1 << 64)) for i in range(1024)]


class Model:
    """Pieces, scores and kinds out of a model file; the kind (`bpe` or `unigram`) is told by the scores' law."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.bytes = {}
        self.index: dict[str, int] = {}
        self.score = np.zeros(n)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.index[self.pieces[i]] = i
                self.score[i] = sp.get_score(i)
        self.longest = max(map(len, self.index), default=1)
        known = self.score[list(self.index.values())]
        # merge models number their pieces 0, -1, -2 ...; unigram scores are log probabilities
        self.kind = kind or ("bpe" if len(known) and (known == np.round(known)).all() else "unigram")
        self.unknown_score = float(known.min() if len(known) else 0) - 10.0
        self.by_id = [p.encode("utf-8").replace(SPACE.encode(), b" ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.by_id[i] = bytes([b])
        # a text may be cut before a space, and around a line break, if no piece reaches across
        self.cut_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.index)
        self.cut_lines = not any("\n" in p for p in self.index)
        # pairs of pieces met before, a slot each: (pair, whether the second may follow)
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        # pieces by hash, for looking up many substrings at once: the slot of the top bits, a sorted list behind it
        hashes = {self._hash(p): i for p, i in self.index.items()}
        self.keys = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([hashes[k] for k in sorted(hashes)], np.int64)
        self.exact = len(hashes) == len(self.index) and self.longest < len(POWERS)
        self.slots = np.searchsorted(self.keys, np.arange((1 << PIECE_BITS) + 1, dtype=np.uint64) << np.uint64(64 - PIECE_BITS)).astype(np.int32)
        self.slots[-1] = len(self.keys)
        self.depth = int(np.diff(self.slots).max()) if len(self.keys) else 0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) & MASK
        return (h * SPREAD) & MASK

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashed substrings, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - PIECE_BITS)).astype(np.int64)
        first = self.slots[slot]
        some = np.flatnonzero(first < self.slots[slot + 1])
        for i in range(self.depth):
            at = np.minimum(first[some] + i, len(self.keys) - 1)
            hit = self.keys[at] == hashes[some]
            out[some[hit]] = self.ids[at[hit]]
            some = some[~hit]
            if not len(some):
                break
        return out

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored joinable neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.index.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def allowed(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: the text's start, or a character without piece)."""
        return bool(self.all_allowed(np.array([(a + 1) * (len(self.pieces) + 1) + b + 1]))[0])

    def all_allowed(self, keys: np.ndarray) -> np.ndarray:
        """allowed() of pairs (a + 1) * (pieces + 1) + b + 1; pairs met before are found in a table."""
        slot = ((keys.astype(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(new):
            size = len(self.pieces) + 1
            unseen, back = np.unique(keys[new], return_inverse=True)
            fits = np.array([self._fits(k // size - 1, k % size - 1) for k in unseen.tolist()], bool)
            out[new] = fits[back]
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = keys[new], out[new]
        return out

    def _fits(self, a: int, b: int) -> bool:
        if b < 0:
            return True
        right = self.pieces[b]
        if a < 0:
            return self.merged(right) == [right]
        left = self.pieces[a]
        return left + right not in self.index and self.merged(left + right) == [left, right]

    def unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unk]

    def decode(self, ids: Iterable[int]) -> str:
        """The text, without the space that encoding puts first."""
        raw = b"".join(map(self.by_id.__getitem__, ids))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


class Stream:
    """Characters in, final ids out, one text. Holds the boundaries that a piece can still start from, the
    survivors, and the steps back from them that are not yet common to all."""

    def __init__(self, model: Model):
        self.model = model
        self.tail = ""  # the last `longest` characters
        self.at = 0
        self.back: dict[int, tuple[int, int, str]] = {}  # boundary -> (boundary before, id or -1, its character)
        self.hop: dict[int, int] = {0: 0}  # survivor -> the first boundary after `base` on its path
        self.best = {0: 0.0}
        self.base, self.before = 0, -1  # what lies before is committed; the piece that ends there

    def push(self, char: str) -> list[int]:
        m = self.model
        self.at += 1
        self.tail = (self.tail + char)[-m.longest :]
        found = None
        for n in range(min(len(self.tail), self.at), 0, -1):
            start = self.at - n
            if start not in self.best:
                continue
            j = m.index.get(self.tail[-n:], -1)
            if j < 0 and n > 1:
                continue
            if m.kind == "bpe":
                if m.allowed(self.back[start][1] if start > self.base else self.before, j):
                    found = (0.0, start, j)
                    break
            else:
                value = self.best[start] + (m.score[j] if j >= 0 else m.unknown_score)
                if found is None or value > found[0]:
                    found = (value, start, j)
        if found:
            self.best[self.at], self.back[self.at] = found[0], (found[1], found[2], char)
            self.hop[self.at] = self.at if found[1] == self.base else self.hop[found[1]]
        gone = self.at - m.longest
        self.best.pop(gone, None)
        self.hop.pop(gone, None)
        if self.base <= gone and len(set(self.hop.values())) == 1:
            return self.commit()
        return []

    def commit(self) -> list[int]:
        """Ids up to the last boundary that the paths from all survivors share."""
        out: list[int] = []
        while self.base not in self.hop and len(meet := set(self.hop.values())) == 1:
            (at,) = meet
            _, j, char = self.back[at]
            out += [j] if j >= 0 else self.model.unknown(char)
            self.base, self.before = at, j
            for b in self.hop:
                step = b
                while step > at and self.back[step][0] != at:
                    step = self.back[step][0]
                self.hop[b] = step
        # paths that no survivor is on are gone
        alive, todo = set(), list(self.hop)
        while todo:
            b = todo.pop()
            if b > self.base and b not in alive:
                alive.add(b)
                todo.append(self.back[b][0])
        self.back = {b: self.back[b] for b in alive}
        return out

    def finish(self) -> list[int]:
        """The text's end is the only survivor."""
        if self.at == self.base:
            return []
        at = self.at
        hop = at
        while self.back[hop][0] != self.base:
            hop = self.back[hop][0]
        self.hop, self.best = {at: hop}, {at: self.best[at]}
        return self.commit()


def stream(model: Model, characters: Iterable[str]) -> Iterator[int]:
    """Ids of a text given as characters, of any length."""
    s = Stream(model)
    for c in characters:
        yield from s.push(c)
    yield from s.finish()


class Lanes:
    """Stream for many BPE texts of one length, a character of each at a time.

    Arrays have a row for each boundary that is kept: the last `longest` and what is not yet committed.
    They are rings; a ring that is full doubles. Ids leave by `commit` alone: `left` counts them, `kept`
    is the most boundaries that were held.
    """

    def __init__(self, model: Model, words: list[str]):
        self.model, self.words, self.count = model, words, len(words)
        self.rows = model.longest + 2
        self.last = np.full((self.rows, self.count), -2, np.int64)  # the piece that ends here: -2 none, -1 a character without one
        self.came = np.zeros((self.rows, self.count), np.int64)
        self.hop = np.zeros((self.rows, self.count), np.int64)  # the first boundary after base on the path
        self.head = np.zeros((self.rows, self.count), np.uint64)  # hash of all before
        self.last[0] = -1
        self.base = np.zeros(self.count, np.int64)
        self.oldest = 0  # no lane's base is before it
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (lanes, pieces, where they end), in order
        self.left = self.kept = 0

    def grow(self, at: int) -> None:
        held = np.arange(self.oldest, at)
        old, self.rows = held % self.rows, 2 * self.rows
        for name, empty in (("last", -2), ("came", 0), ("hop", 0), ("head", 0)):
            ring = getattr(self, name)
            new = np.full((self.rows, self.count), empty, ring.dtype)
            new[held % self.rows] = ring[old]
            setattr(self, name, new)

    def commit(self, lanes: np.ndarray, at: np.ndarray) -> None:
        """The piece that ends at boundary `at` of each lane is final."""
        self.out.append((lanes, self.last[at % self.rows, lanes], at))
        self.base[lanes] = at
        self.left += len(lanes)

    def converge(self, end: int) -> None:
        """Commits, in each lane, while the paths of all survivors begin with one piece."""
        m = self.model
        alive = np.arange(max(0, end + 1 - m.longest), end + 1)
        lanes = np.flatnonzero(self.base < alive[0])
        while len(lanes):
            sub = np.ix_(alive % self.rows, lanes)
            there = self.last[sub] > -2
            hops = self.hop[sub]
            at = np.where(there, hops, 0).max(0)
            same = np.where(there, hops, 1 << 62).min(0) == at
            lanes, at = lanes[same], at[same]
            if not len(lanes):
                return
            self.commit(lanes, at)
            # the next piece of each survivor's path
            for b in alive:
                step = np.full(len(lanes), b)
                while True:
                    far = (step > at) & (self.last[step % self.rows, lanes] > -2)
                    before = self.came[step % self.rows, lanes]
                    far &= before > at
                    if not far.any():
                        break
                    step[far] = before[far]
                self.hop[b % self.rows, lanes] = step
            lanes = lanes[self.base[lanes] < alive[0]]

    def run(self) -> list[bytes]:
        m, n = self.model, len(self.words[0])
        size = len(m.pieces) + 1
        cp = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4").reshape(self.count, n).astype(np.uint64)
        for end in range(1, n + 1):
            low = max(0, end - m.longest)
            if end - min(self.oldest, low) >= self.rows:
                self.oldest = min(int(self.base.min()), low)
                if end - self.oldest >= self.rows:
                    self.grow(end)
            self.kept = max(self.kept, end - min(self.oldest, low))
            row = end % self.rows
            self.head[row] = self.head[(end - 1) % self.rows] * np.uint64(BASE) + cp[:, end - 1] + np.uint64(1)
            self.last[row] = -2
            open_ = np.ones(self.count, bool)
            for start in range(low, end):
                old = start % self.rows
                idx = np.flatnonzero(open_ & (self.last[old] > -2))
                piece = m.look_up((self.head[row, idx] - self.head[old, idx] * POWERS[end - start]) * np.uint64(SPREAD))
                if end - start > 1:
                    hit = np.flatnonzero(piece >= 0)
                    idx, piece = idx[hit], piece[hit]
                if not len(idx):
                    continue
                fits = m.all_allowed((self.last[old, idx] + 1) * size + piece + 1)
                idx, piece = idx[fits], piece[fits]
                self.last[row, idx], self.came[row, idx] = piece, start
                self.hop[row, idx] = np.where(self.base[idx] == start, end, self.hop[old, idx])
                open_[idx] = False
            if end > m.longest and end < n:
                self.converge(end)
        # the end is the only survivor: its path is final, piece by piece
        lanes = np.arange(self.count)
        while len(lanes):
            self.commit(lanes, self.hop[n % self.rows, lanes])
            lanes = lanes[self.base[lanes] < n]
            step = np.full(len(lanes), n)
            while True:
                before = self.came[step % self.rows, lanes]
                far = before > self.base[lanes]
                if not far.any():
                    break
                step[far] = before[far]
            self.hop[n % self.rows, lanes] = step
        return self.ids()

    def ids(self) -> list[bytes]:
        lanes, pieces, at = (np.concatenate(x) for x in zip(*self.out))
        order = np.argsort(lanes, kind="stable")
        lanes, pieces, at = lanes[order], pieces[order], at[order]
        ends = np.cumsum(np.bincount(lanes, minlength=self.count))
        raw = pieces.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        for lane in np.unique(lanes[pieces < 0]).tolist():
            part = slice(int(ends[lane - 1]) if lane else 0, int(ends[lane]))
            ids = [[j] if j >= 0 else self.model.unknown(self.words[lane][b - 1]) for j, b in zip(pieces[part].tolist(), at[part].tolist())]
            out[lane] = np.array([i for one in ids for i in one], "<u4").tobytes()
        return out


class Encoder:
    """Ids of texts. A text is cut where every path must cross: before spaces and around line breaks, if
    the model's pieces allow. What lies between two cuts is streamed, many of one length in Lanes, few by
    a Stream each: both commit ids out of a window."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        line = r"\n|" if model.cut_lines else ""
        other = r"[^ \n]" if model.cut_lines else "[^ ]"
        self.chunks = re.compile(f"{line} *{other}+| +") if model.cut_spaces else None

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        groups: dict[int, list[str]] = {}
        for c in chunks:
            if c not in self.known:
                groups.setdefault(len(c), []).append(c)
        for same in groups.values():
            if self.model.kind != "bpe" or not self.model.exact or len(same) < FEW:
                for c in same:
                    self.known[c] = np.fromiter(stream(self.model, c.replace(" ", SPACE)), "<u4").tobytes()
                continue
            for a in range(0, len(same), 4096):
                part = same[a : a + 4096]
                self.known.update(zip(part, Lanes(self.model, [c.replace(" ", SPACE) for c in part]).run()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. An empty text has none; any other gets a space before it."""
        if self.chunks is None:
            return [np.fromiter(stream(self.model, f" {t}".replace(" ", SPACE)), "<u4").tobytes() if t else b"" for t in texts]
        cut = [self.chunks.findall(f" {t}".replace(SPACE, " ")) if t else [] for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(Model(path))


def encode(docs: DataFrame, model: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, round_trip[, ids]) of every row: one map, no shuffle; whole texts.

    ids_crc32 is over little-endian unsigned 32-bit ids. round_trip: decoding the ids gives the text;
    false for a text that holds the model's space sign U+2581 itself, which comes back as a space.
    Null and empty texts have no ids and come back empty. Null ids and repeated rows stay; an empty
    table gives no rows; other columns aren't read.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids

    def make():
        encode_all = encoder(model)
        decode = encode_all.model.decode

        def one(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                ids = encode_all(texts)
                lists = [np.frombuffer(i, "<u4").tolist() for i in ids]
                columns = [
                    batch.column(0).slice(at, 256), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([crc32(i) for i in ids], pa.int64()), pa.array([decode(i) == t for i, t in zip(lists, texts)], pa.bool_()),
                ]
                names = ["doc_id", "n_bytes", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return one

    return arrow_map(docs.select(id_col, text_col), make, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) out of (doc_id, ids). Null ids give a null text, no ids an empty one; null
    doc_ids and repeated rows stay; an empty table gives no rows; other columns aren't read."""

    def make():
        m = encoder(model).model

        def one(batch: pa.RecordBatch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else m.decode(i) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

        return one

    return arrow_map(encoded.select(id_col, ids_col), make, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")
