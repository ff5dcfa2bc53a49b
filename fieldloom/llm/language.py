"""Language of words and texts by a linear-chain conditional random field.

Each line is a chain of words, each language a state. A word's affixes, letter runs and itself (the
lexicon) give its weight in every state; learned transitions tie neighbours; forward-backward gives
each word's language. Words that switch language inside a line keep their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_map, by_characters, fold, sample_rows

BITS = 18
#: The bounded sample it is fitted on: labelled rows, and characters of all of them together.
FIT_TEXTS, FIT_TOTAL = 1000, 50_000_000
#: Words of a chain that are walked in one go; longer chains are walked block by block, exactly.
BLOCK = 256
#: Letters of words, and characters of texts, that are worked on at a time; a longer one alone.
LETTERS, CHARACTERS = 1 << 17, 1 << 20
EPOCHS, RATE = 4, 0.3
CACHE = 600_000
EDGES = ".,;:!?\"'()[]{}<>«»…#$%&*|-_/\\0123456789"
UND = "und"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: list[str]) -> np.ndarray:
    """Hashed features of words of one length: runs of 1 to 4 letters, prefixes and suffixes of 1 to 4
    (the runs at either edge, marked), and the word."""
    n = len(words[0])
    cp = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in range(1, min(4, n) + 1):
            h = np.zeros((len(words), n - k + 1), np.uint64)
            for i in range(k):
                h = _mix(h + cp[:, i : i + n - k + 1], k)
            out += [h, _mix(h[:, :1], 101), _mix(h[:, -1:], 103)]
        whole = np.zeros((len(words), 1), np.uint64)
        for i in range(n):
            whole = _mix(whole + cp[:, i : i + 1], 107)
        out.append(whole)
    return (np.hstack(out) >> np.uint64(64 - BITS)).astype(np.int64)


def cleaned(word: str) -> str:
    """Lower case without signs at the edges; empty if no letter is left."""
    word = word.lower().strip(EDGES)
    return word if any(map(str.isalpha, word)) else ""


def forward_backward(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray, block: int = BLOCK):
    """State probabilities of each word of each chain, expected transitions, log-likelihood's normalizer.

    emit: [word, state] log weights, chains one after another, `lengths` words each, none of them 0.
    Chains are walked in blocks, all blocks a step together; those that have ended drop out, so they
    are sorted by length first. A block's words as one matrix say what a state before it gives after
    it: with these, what comes into each block from before and from behind is known beforehand, so
    cutting changes nothing.
    """
    states = emit.shape[1]
    trans = np.exp(step)
    weight = np.exp(emit - emit.max(1, keepdims=True))
    parts = -(-lengths // block)
    size = np.full(int(parts.sum()), block, np.int64)
    ends = np.cumsum(parts) - 1
    size[ends] = lengths - (parts - 1) * block
    begin = np.cumsum(size) - size
    lead = np.empty((len(size), states))  # a block's states before its first word
    lead[ends - parts + 1] = np.exp(start)
    tail = np.ones((len(size), states))  # and what follows its last
    if len(size) > len(lengths):
        long = np.flatnonzero(np.repeat(parts > 1, parts))
        whole = _matrices(weight, begin[long], size[long], trans)
        at = np.cumsum(np.repeat(parts > 1, parts)) - 1
        for e, n in zip(ends[parts > 1].tolist(), parts[parts > 1].tolist()):
            for p in range(e - n + 1, e):
                after = lead[p] @ whole[at[p]]
                lead[p + 1] = (after / after.sum()) @ trans
            for p in range(e - 1, e - n, -1):
                tail[p] = trans @ (whole[at[p + 1]] @ tail[p + 1])
                tail[p] /= tail[p].sum()
    order = np.argsort(-size, kind="stable")
    begin, size, lead, tail = begin[order], size[order], lead[order], tail[order]
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # blocks with more than t words
    alpha, beta = np.empty_like(weight), np.empty_like(weight)
    scale = np.empty(len(weight))
    now = None
    for t in range(longest):
        at = begin[: alive[t]] + t
        now = (lead if t == 0 else now[: alive[t]] @ trans) * weight[at]
        total = now.sum(1)
        now = now / total[:, None]
        alpha[at], scale[at] = now, total
    expected = np.zeros((states, states))
    last = begin + size - 1
    tail /= (alpha[last] * tail).sum(1, keepdims=True)  # forward times backward is 1 everywhere
    for t in range(longest - 1, -1, -1):
        at = begin[: alive[t]] + t
        now = tail[: alive[t]].copy()
        if t + 1 < longest and alive[t + 1]:
            nxt = begin[: alive[t + 1]] + t + 1
            flow = weight[nxt] * beta[nxt] / scale[nxt][:, None]
            now[: alive[t + 1]] = flow @ trans.T
            expected += alpha[at[: alive[t + 1]]].T @ flow * trans
        beta[at] = now
    chain = np.cumsum(lengths) - lengths
    nxt = np.setdiff1d(begin, chain)  # first words of blocks that go on a chain
    if len(nxt):
        expected += alpha[nxt - 1].T @ (weight[nxt] * beta[nxt] / scale[nxt][:, None]) * trans
    return alpha * beta, expected, float(np.log(scale).sum() + emit.max(1).sum())


def _matrices(weight: np.ndarray, begin: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """[block, state before, state at its last word], up to a factor a block."""
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(size), *trans.shape))
    now = np.eye(len(trans))[None] * weight[begin[order]][:, None, :]
    for t in range(1, int(size.max()) + 1):
        alive = int(np.searchsorted(-size[order], -t, side="left"))
        out[order[alive : len(now)]] = now[alive:]
        if not alive:
            break
        now = (now[:alive] @ trans) * weight[begin[order[:alive]] + t][:, None, :]
        now /= now.max((1, 2), keepdims=True)
    return out


class Field:
    def __init__(self, states: list[str]):
        self.states = states
        self.weights = np.zeros((1 << BITS, len(states)), np.float32)
        self.step = np.zeros((len(states), len(states)))
        self.start = np.zeros(len(states))
        self.prior = np.zeros(len(states))

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.states)))
        for idx, f in by_length(words):
            out[idx] = self.weights[f].sum(1)
        return out


def by_length(words: list[str]):
    """Indices and features of words of one length, whole words, about LETTERS letters at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            groups.setdefault(len(w), []).append(i)
    for n, idx in groups.items():
        take = max(1, LETTERS // n)
        for a in range(0, len(idx), take):
            part = idx[a : a + take]
            yield part, features([words[i] for i in part])


def fit(rows: list[tuple[str, str]]) -> Field:
    """rows: (text, language). By gradient steps on the chains' log-likelihood, AdaGrad.

    Texts carry one language each; to learn what a switch looks like, a third of the chains join
    pieces of two texts.
    """
    states = sorted({lang for _, lang in rows}) or [UND]
    field = Field(states)
    rng = np.random.default_rng(5)
    pieces: list[tuple[list[str], int]] = []
    counts = np.zeros(len(states))
    for text, lang in rows:
        counts[states.index(lang)] += 1
        words = [w for w in map(cleaned, text.split()) if w]
        pieces += [(words[a : a + 12], states.index(lang)) for a in range(0, len(words), 12)]
    if not pieces or len(states) < 2:
        return field
    types: dict[str, int] = {}
    chains = []
    perm = rng.permutation(len(pieces))
    at = 0
    while at < len(perm):
        take = 2 if rng.random() < 1 / 3 and at + 1 < len(perm) else 1
        ids, ys = [], []
        for p in perm[at : at + take]:
            ids += [types.setdefault(w, len(types)) for w in pieces[p][0]]
            ys += [pieces[p][1]] * len(pieces[p][0])
        chains.append((ids, ys))
        at += take
    words = list(types)
    where: list = [None] * len(words)
    for idx, f in by_length(words):
        for i, row in zip(idx, f):
            where[i] = np.unique(row)
    # one weight for each feature of each word, as a flat list: sums by reduceat
    balance = (counts.sum() / np.maximum(counts, 1) / len(states)) ** 0.5
    g2w, g2s, g2b = np.full(field.weights.shape, 1e-2, np.float32), np.full(field.step.shape, 1e-2), np.full(len(states), 1e-2)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), 256):
            batch = [chains[i] for i in order[a : a + 256]]
            ids = np.concatenate([c[0] for c in batch]).astype(np.int64)
            y = np.concatenate([c[1] for c in batch]).astype(np.int64)
            lengths = np.array([len(c[0]) for c in batch])
            kinds, back = np.unique(ids, return_inverse=True)
            flat = np.concatenate([where[k] for k in kinds])
            ends = np.cumsum([len(where[k]) for k in kinds])
            emit = np.add.reduceat(field.weights[flat].astype(float), np.r_[0, ends[:-1]], axis=0)[back]
            gamma, expected, _ = forward_backward(emit, lengths, field.step, field.start)
            gold = np.zeros_like(gamma)
            gold[np.arange(len(y)), y] = 1
            diff = (gold - gamma) * balance[y][:, None]
            first = np.r_[0, np.cumsum(lengths)[:-1]]
            inner = np.ones(len(y), bool)
            inner[first] = False
            seen = np.zeros_like(field.step)
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            by_kind = np.stack([np.bincount(back, diff[:, s], len(kinds)) for s in range(len(states))], 1)
            spread = np.repeat(by_kind, np.diff(np.r_[0, ends]), axis=0)
            rows_w, inv = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inv, spread[:, s], len(rows_w)) for s in range(len(states))], 1) - 1e-3 * field.weights[rows_w]
            g2w[rows_w] += (grad * grad).astype(np.float32)
            field.weights[rows_w] += (RATE * grad / np.sqrt(g2w[rows_w])).astype(np.float32) * 0.3
            grad = (seen - expected) / len(batch)
            g2s += grad * grad
            field.step += RATE * grad / np.sqrt(g2s) * 0.3
            grad = diff[first].sum(0) / len(batch)
            g2b += grad * grad
            field.start += RATE * grad / np.sqrt(g2b) * 0.3
    return field


def train(docs: DataFrame, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fits on a sample of the rows of known language outside the held-out fold: the first FIT_TEXTS in
    hash order of id and text, as many of them as have FIT_TOTAL characters together, whole texts.
    Without such rows every text is `und`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held_out))
    return fit([(r["text"], r["lang"]) for r in sample_rows(known, FIT_TEXTS, FIT_TOTAL)])


class Tagger:
    """Languages of texts; what words weigh is remembered."""

    def __init__(self, field: Field):
        self.field = field
        self.ids: dict[str, int] = {}
        self.next = 1
        self.table = np.zeros((1024, len(field.states)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.next = 1
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        plain = [cleaned(w) for w in new]
        emit = self.field.emissions(plain)
        base = self.next
        letters = [i for i, p in enumerate(plain) if p]
        while base + len(letters) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[base : base + len(letters)] = emit[letters]
        at = base
        for w, p in zip(new, plain):
            if p:
                self.ids[w] = at
                at += 1
            else:
                self.ids[w] = 0  # no letter: no word
        self.next = at

    def words(self, texts: list[str | None]):
        """Word ids of all texts in turn, chain lengths, and each chain's text."""
        lines = [[line.split() for line in t.split("\n")] if t else [] for t in texts]
        need = set()
        for doc in lines:
            for line in doc:
                need.update(line)
        self.learn(need)
        get = self.ids.__getitem__
        flat, lengths, owner = [], [], []
        for d, doc in enumerate(lines):
            for line in doc:
                if ids := [i for i in map(get, line) if i]:
                    flat += ids
                    lengths.append(len(ids))
                    owner.append(d)
        return np.array(flat, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ids, lengths, owner = self.words(texts)
        share = np.zeros((len(texts), len(self.field.states)))
        if len(ids):
            gamma, _, _ = forward_backward(self.table[ids].astype(float), lengths, self.field.step, self.field.start)
            of = np.repeat(owner, lengths)
            # a word that a text repeats n times weighs as the root of n: boilerplate does not outvote prose
            _, back, often = np.unique(of * len(self.table) + ids, return_inverse=True, return_counts=True)
            weight = often[back] ** -0.5
            for s in range(share.shape[1]):
                share[:, s] = np.bincount(of, gamma[:, s] * weight, len(texts))
        total = share.sum(1)
        best = share.argmax(1)
        return [self.field.states[b] if n else UND for b, n in zip(best, total)], [float(min(1.0, share[i, b] / n)) if n else 0.0 for i, (b, n) in enumerate(zip(best, total))]


def identify(docs: DataFrame, field: Field, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: one map, no shuffle; whole texts.

    lang_pred is the state with most expected words, score its share of them; a word that a text
    holds n times weighs as the root of n. A text that is null
    or has no letter: `und`, 0. A null id is in no fold (held_out false); repeated rows are each
    told; an empty table gives no rows; other columns aren't read. Ties go to the first state by name.
    """
    field_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2 ** BITS weights a state

    def make():
        tag = Tagger(shared.value)

        def one(batch: pa.RecordBatch):
            lang, score = [], []
            for texts in by_characters(batch.column(2).to_pylist(), CHARACTERS):
                a, b = tag(texts)
                lang += a
                score += b
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return one

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, modulus) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"doc_id {field_type}, held_out boolean, lang_pred string, score double")
