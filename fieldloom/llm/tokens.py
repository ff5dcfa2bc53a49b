"""Byte-level vocabulary files: ranks, pieces of a text, ids; and counting by heap-and-list merging.

The file is that of the `tokenizers` library (`model.vocab`, `model.merges`, `added_tokens`);
its path is a parameter everywhere.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import arrow_map

#: Entries a worker remembers before it starts afresh.
CACHE = 800_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Settings of a vocabulary file that this module implements, by the file's names; any other raises.
SETTINGS = {"normalizer": (None,), "truncation": (None,), "padding": (None,)}
MODEL = {"type": ("BPE",), "dropout": (None, 0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "fuse_unk": (None, False), "byte_fallback": (None, False), "ignore_merges": (None, False)}
SPLIT = {"type": ("ByteLevel",), "add_prefix_space": (False,), "use_regex": (None, True)}
ADDED = {"single_word": (None, False), "lstrip": (None, False), "rstrip": (None, False)}


def checked(spec: dict) -> dict:
    """The file's contents; ValueError if a setting would give ids that this module does not give."""
    parts = [("", spec, SETTINGS), ("model", spec["model"], MODEL), ("pre_tokenizer", spec.get("pre_tokenizer") or {}, SPLIT), *((f"added token {t['content']!r}", t, ADDED) for t in spec["added_tokens"])]
    for where, found, known in parts:
        for name, values in known.items():
            if found.get(name) not in values:
                raise ValueError(f"vocabulary file: {where} {name} = {found.get(name)!r} is not supported")
    return spec


class Vocabulary:
    """A byte-level vocabulary file; settings other than those of SETTINGS, MODEL, SPLIT and ADDED raise."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        of = {b: c for c, b in self.letters.items()}
        self.letter_of = [of[b] for b in range(256)]
        self.vocab = spec["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[a, b] = rank
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # GPT-2 style pre-tokens; the vocabularies in use name no other split
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def ranks(self) -> dict[bytes, int]:
        """Ids by bytes, for merging by least id: ValueError where that isn't the order of the merges."""
        made = [self.vocab[a + b] for a, b in self.merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("vocabulary file: ids do not rise with the merges")
        return {bytes(map(self.letters.__getitem__, t)): i for t, i in self.vocab.items() if t not in self.special}

    def spans(self, text: str) -> tuple[list[str], list[str]]:
        """The stretches between special strings, and the special strings."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text], []
        return self.split_special.split(text), self.split_special.findall(text)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after byte-pair merging.

    A doubly linked list holds the symbols, a heap the adjacent pairs by (rank, position): pop the
    lowest, skip it if either side has changed since, else merge and push the two new pairs. No ids
    are looked up; the count is the initial symbols minus the merges.
    """
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j >= n or sym[i] != a or sym[j] != b:
            continue  # one of the two has been merged away
        joined = a + b
        sym[i], sym[j] = joined, None
        merges += 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := get((joined, sym[k]))) is not None:
                heapq.heappush(heap, (r, i, joined, sym[k]))
        h = left[i]
        if h >= 0 and (r := get((sym[h], joined))) is not None:
            heapq.heappush(heap, (r, h, sym[h], joined))
    return n - merges


class Counter(dict):
    """Piece -> tokens; a piece not met before is merged by merged_length."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        letters = [self.vocab.letter_of[b] for b in piece.encode("utf-8")]
        n = merged_length(letters, self.vocab.merges)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts, specials = self.vocab.spans(text)
        return len(specials) + sum(sum(map(self.__getitem__, self.vocab.pattern.findall(p))) for p in parts)


@lru_cache(2)
def counter_of(path: str) -> Counter:
    """One for each worker process: later tasks find its pieces."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, by heap-and-linked-list byte-pair merging.

    Only a map over the rows: no shuffle, memory bounded by one Arrow batch and the piece cache.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows stay, each
    counted; an empty table gives no rows; other columns of the input are not read, whatever their
    names. Special strings in a text count one token, as the library's default has it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = counter_of(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n_tokens = [counter.count(t) if t else 0 for t in texts]
            n_bytes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return one

    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
