"""Sets of word shingles as 64-bit hashes, out of UTF-8 bytes, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), _U)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


class Shingler:
    """Distinct shingle hashes of texts: words are runs of bytes other than blanks, A-Z made lower."""

    def __init__(self, words: int = 5):
        self.words = words
        self.power, self.inverse = _powers(CHUNK, _BASE), _powers(CHUNK, _INVERSE)

    def word_hashes(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in order and the text of each; a text's start also starts a word."""
        if len(raw) + 1 > len(self.power):
            self.power, self.inverse = _powers(len(raw) + 1, _BASE), _powers(len(raw) + 1, _INVERSE)
        raw = _LOWER[raw]
        text = ~_BLANK[raw]
        begin = text.copy()
        begin[1:] &= ~text[:-1]
        inside = starts[starts < len(raw)]
        begin[inside] = text[inside]
        first = np.flatnonzero(begin)
        end = text.copy()
        end[:-1] &= ~text[1:] | begin[1:]
        last = np.flatnonzero(end)
        total = np.cumsum((raw.astype(_U) + _U(1)) * self.power[: len(raw)])
        value = total[last]
        value[first > 0] -= total[first[first > 0] - 1]
        value *= self.inverse[first]
        return mix(value + (last - first + 1).astype(_U) * _U(0xA0761D6478BD642F)), np.searchsorted(starts, first, side="right") - 1

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """A sorted array of distinct hashes for each text; of null or no words an empty one."""
        out: list[np.ndarray] = []
        if not len(texts):
            return out
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            out += self._part(data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], to - at)
            at = to
        return out

    def _part(self, raw: np.ndarray, starts: np.ndarray, count: int) -> list[np.ndarray]:
        none = np.empty(0, _U)
        if not len(raw):
            return [none] * count
        # texts without bytes share a start with their successor: searchsorted gives the last of them
        word, owner = self.word_hashes(raw, starts)
        n = np.bincount(owner, minlength=count)
        k = self.words
        value = word.copy() if len(word) >= k else none
        for i in range(1, k):
            value = mix(value[: len(word) - k + 1] * _U(0xD6E8FEB86659FD93) + word[i : len(word) - k + 1 + i])
        ends = np.cumsum(n)
        result = []
        for d in range(count):
            a, b = int(ends[d] - n[d]), int(ends[d])
            if b - a >= k:
                result.append(np.unique(value[a : b - k + 1]))
            elif b > a:
                short = _U(b - a)
                with np.errstate(over="ignore"):
                    for w in word[a:b]:
                        short = mix(np.array([short * _U(0xD6E8FEB86659FD93) + w]))[0]
                result.append(np.array([short], _U))
            else:
                result.append(none)
        return result
