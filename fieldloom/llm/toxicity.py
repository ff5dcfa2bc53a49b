"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A text is scored by its worst unit: a blank-separated word, or a run of single spaced-out letters.
The kernel of two units counts the three-symbol subsequences they share, gaps allowed, each weighted
by DECAY to the length it spans; so an insult keeps its likeness when characters are put in between.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_map, by_characters, fold, give_back, sample_rows, written
from .shingles import Shingler, mix

DECAY = 0.6
#: Symbols: 26 letters, 10 classes of other characters, digits, signs, start, end.
SYMBOLS, OTHER, DIGIT, SIGN, START, END = 40, 26, 36, 37, 38, 39
#: A unit longer than WINDOW symbols is as bad as the worst of its half-overlapping windows, in fitting and scoring.
WINDOW = 24
#: The bounded sample a machine is fitted on: rows of either label, and characters of each label's rows together.
FIT_TOXIC, FIT_CLEAN, FIT_TOTAL = 1500, 2500, 20_000_000
#: Landmarks of either side, rounds of fitting, the G statistic from which a letter run names units.
LANDMARKS, ROUNDS, WITNESS = 96, 5, 15.0
#: The score at which a text is as likely toxic as not.
EVEN = 0.7
#: Units a worker remembers before it starts afresh; characters of texts scored at a time, a longer text alone.
CACHE, CHARACTERS = 400_000, 1 << 20
SPACED = regex.compile(r"(?<!\S)\w(?:[ \t]\w){3,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>«»…"


def symbols(units: list[str]) -> np.ndarray:
    """Units of one length as rows of symbols, with start and end."""
    n = len(units[0])
    if not n:
        return np.tile([[START, END]], (len(units), 1))
    cp = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(len(units), n).astype(np.int64)
    out = np.full((len(units), n + 2), SIGN, np.int64)
    body = np.where(cp >= 128, OTHER + cp % 10, SIGN)
    body = np.where((cp >= 97) & (cp <= 122), cp - 97, body)
    out[:, 1:-1] = np.where((cp >= 48) & (cp <= 57), DIGIT, body)
    out[:, 0], out[:, -1] = START, END
    return out


def _triples(n: int) -> tuple[np.ndarray, ...]:
    i, j, k = (a.ravel() for a in np.meshgrid(*(np.arange(n),) * 3, indexing="ij"))
    ok = (i < j) & (j < k)
    i, j, k = i[ok], j[ok], k[ok]
    return i, j, k, (DECAY ** (k - i + 1.0))


TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def triples(n: int) -> tuple[np.ndarray, ...]:
    if n not in TRIPLES:
        TRIPLES[n] = _triples(n)
    return TRIPLES[n]


def self_kernel(s: np.ndarray) -> np.ndarray:
    """K(x, x) of each row, by the kernel's dynamic program over positions."""
    rows, n = s.shape
    same = s[:, :, None] == s[:, None, :]
    inner = np.ones((rows, n + 1, n + 1))
    for _ in range(2):
        nxt = np.zeros_like(inner)
        for m in range(1, n + 1):
            run = np.zeros(rows)
            for q in range(1, n + 1):
                run = DECAY * run + same[:, m - 1, q - 1] * (DECAY * DECAY) * inner[:, m - 1, q - 1]
                nxt[:, m, q] = DECAY * nxt[:, m - 1, q] + run
        inner = nxt
    return (same * inner[:, :-1, :-1]).sum((1, 2)) * DECAY * DECAY


def codes(s: np.ndarray) -> np.ndarray:
    i, j, k, _ = triples(s.shape[1])
    return (s[:, i] * SYMBOLS + s[:, j]) * SYMBOLS + s[:, k]


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[a : a + WINDOW] for a in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def grouped(units: list[str]):
    """Indices and symbol rows of units of one length, so many that their triples stay few megabytes."""
    by: dict[int, list[int]] = {}
    for at, u in enumerate(units):
        by.setdefault(len(u), []).append(at)
    for n, idx in by.items():
        step = max(64, 500_000 // (1 + math.comb(n + 2, 3)))
        for a in range(0, len(idx), step):
            part = idx[a : a + step]
            yield part, symbols([units[x] for x in part])


def feature_table(unit: str) -> np.ndarray:
    """The unit's subsequence weights over all SYMBOLS ** 3 triples, of unit norm."""
    s = symbols([unit])
    out = np.bincount(codes(s)[0], weights=triples(s.shape[1])[3], minlength=SYMBOLS**3)
    return out / max(np.linalg.norm(out), 1e-12)


class Machine:
    """Decision values. The kernel is a sum over shared subsequences, so landmarks and their
    coefficients fold into one weight for each subsequence; nothing is approximated by that."""

    def __init__(self, weights: np.ndarray, bias: float, layer: np.ndarray | None = None):
        self.weights, self.bias, self.known = weights, bias, frozenset()
        self.layer = np.array([0, 0, 0, 0, 0, 0, -3.0]) if layer is None else layer

    def units(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), -1.0)
        for part, s in grouped(units):
            if s.shape[1] >= 5:  # two letters or fewer say nothing
                raw = self.weights[codes(s)] @ triples(s.shape[1])[3]
                out[part] = raw / np.sqrt(np.maximum(self_kernel(s), 1e-12)) + self.bias
        return out

    def words(self, words: list[str]) -> list[float]:
        cut = [windows("" if (x := w.strip(EDGES)) in self.known else x) for w in words]
        values = iter(self.units([x for c in cut for x in c]).tolist())
        return [max([next(values) for _ in c]) for c in cut]

    def probability(self, profiles: list[tuple[float, ...]]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(np.array(profiles) @ self.layer[:-1] + self.layer[-1], -40, 40)))).tolist()


def units_of(text: str | None) -> Counter:
    text = (text or "").lower()
    found = Counter(text.split())
    for m in SPACED.findall(text):
        found["".join(m.split())] += 1
    return found


def nystrom(units: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows K(x, L) K(L, L)^-1/2, the root, and the landmarks' tables."""
    tables = np.empty((len(landmarks), SYMBOLS**3), np.float32)
    for m, u in enumerate(landmarks):
        tables[m] = feature_table(u)
    gram = np.zeros((len(units), len(landmarks)))
    for part, s in grouped(units):
        c, w, norm = codes(s), triples(s.shape[1])[3], np.sqrt(np.maximum(self_kernel(s), 1e-12))
        for m, t in enumerate(tables):
            gram[part, m] = t[c] @ w / norm
    value, vector = np.linalg.eigh((tables @ tables.T).astype(float))
    root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
    return gram @ root, root, tables


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the support vectors; the last entry is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.eye(z.shape[1]) / c
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    active = np.ones(len(z), bool)
    for _ in range(30):
        zs = z[active] * weight[active, None]
        new = np.linalg.solve(ridge + zs.T @ z[active], zs.T @ y[active])
        now = y * (z @ new) < 1
        w, same, active = new, (now == active).all(), now
        if same or not now.any():
            break
    return w


def profile(margins: list[float], counts: list[int], words: int) -> tuple[float, ...]:
    """A text by its units: the four worst margins, how many tokens are above 0, and their part."""
    top = heapq.nlargest(4, margins)
    top += [-1.0] * (4 - len(top))
    hits = sum(n for m, n in zip(margins, counts) if m > 0)
    return (*(max(-1.0, min(m, 2.0)) for m in top), math.log1p(hits), math.sqrt(hits / max(words, 1)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps on targets damped as in Platt's scaling."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - t) + penalty @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[Counter], clean: list[Counter]) -> Machine:
    """Multiple-instance fitting: a toxic text holds toxic units somewhere, a clean one hardly any.

    Toxic units are first those of toxic texts with a letter run that toxic texts hold more often
    than chance; then fit, drop those the machine denies, and fit again, with the clean texts' worst
    units among the negatives. Units count by the root of their texts; one of both sides stands on
    both. Last, a logistic layer over the profile of each text gives probabilities.
    """
    if not toxic or not clean:
        return Machine(np.zeros(SYMBOLS**3), -1.0)
    one: dict[str, str] = {}  # one string for each unit, whichever texts hold it
    parts = {u: [one.setdefault(v, v) for v in windows(u.strip(EDGES)) if len(v) >= 3] for u in set().union(*toxic, *clean)}
    bags = [[sorted({v for u in d for v in parts[u]}) for d in docs] for docs in (clean, toxic)]
    del one, parts
    sizes = [len(clean), len(toxic)]
    grams = lambda u: {f"^{u}$"[i : i + k] for k in (4, 5) for i in range(len(u) + 3 - k)}
    own, runs = [[Counter(u for d in side for u in d) for side in bags], [Counter(), Counter()]]
    for d in bags[1]:
        runs[1].update(set().union(*map(grams, d)) if d else ())
    runs[1] = Counter({g: n for g, n in runs[1].items() if n > 3})  # fewer texts cannot pass the test below
    for d in bags[0]:
        runs[0].update(g for g in set().union(*map(grams, d)) if g in runs[1]) if d else None

    def telling(key: str) -> bool:
        """Whether toxic texts hold the run at over three times the clean ones' share, by a G-test."""
        t, c = runs[1][key], runs[0][key]
        if t * sizes[0] <= 3 * c * sizes[1]:
            return False
        share = (t + c) / sum(sizes)
        part = lambda n, size: sum(2 * o * math.log(o / e) for o, e in ((n, size * share), (size - n, size * (1 - share))) if o)
        return part(t, sizes[1]) + part(c, sizes[0]) > WITNESS

    signs = {g for g in runs[1] if telling(g)}
    witness = {u for u in own[1] if own[1][u] * sizes[0] > 2 * own[0][u] * sizes[1] and not signs.isdisjoint(grams(u))}
    value = dict.fromkeys(witness, 0.0)
    rng = np.random.default_rng(11)
    plain = sorted(own[0]) or ["   "]
    plain = [plain[i] for i in rng.permutation(len(plain))[:2000]] + [u for u, _ in own[0].most_common(500)]
    everything = sorted({*own[0], *own[1]})
    hard: list[str] = []
    machine = Machine(np.zeros(SYMBOLS**3), -1.0)
    for _ in range(ROUNDS):
        chosen = Counter(u for d in bags[1] for u in d if u in witness and value[u] > -0.8)
        if not chosen:
            return machine
        good = [u for u, _ in chosen.most_common(1200)]
        neg = list(dict.fromkeys(hard + [u for u in good if own[0][u]] + plain))[:4500]
        marks = list(dict.fromkeys(good[:LANDMARKS] + neg[: LANDMARKS // 2] + plain[: LANDMARKS // 2]))
        z, root, tables = nystrom(good + neg, marks)
        y = np.r_[np.ones(len(good)), -np.ones(len(neg))]
        weight = np.array([*(chosen[u] for u in good), *(max(own[0][u], 1) for u in neg)], float) ** 0.5
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w = svm(z, y, weight)
        machine = Machine((root @ w[:-1]).astype(np.float32) @ tables, w[-1])
        del z, tables
        value = dict(zip(everything, machine.units(everything).tolist()))
        worst = {u for d in bags[0] for u in heapq.nlargest(2, d, key=lambda u: (value[u], u))}
        hard = sorted({*worst, *hard}, key=lambda u: (-value[u], u))[:2000]
    # units that clean texts hold about as often are harmless by themselves, however like an insult
    often = {u: n for u, n in own[0].items() if 3 * n * sizes[1] >= own[1][u] * sizes[0] and value[u] > -1}
    at = dict(zip(raw := list(set().union(*toxic, *clean)), machine.words(raw)))
    x = []
    for label, bags in ((1, toxic), (0, clean)):
        for bag in bags:
            # a clean text's own copy of a unit doesn't count for it
            m = [-1.0 if often.get(u.strip(EDGES), 0) > 1 - label else at[u] for u in bag]
            x.append(profile(m, list(bag.values()), bag.total()))
    machine.known = frozenset(often)
    x = np.array(x)
    machine.layer = logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    machine.layer[-1] += math.log(EVEN / (1 - EVEN))
    return machine


def first_of_kin(texts: list[str]) -> list[bool]:
    """Whether a text is the first to hold its least word shingles, by any of three hashes.

    A family of copies would count as many witnesses for whatever its texts share; one is enough.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    shingler = Shingler()
    for part in by_characters(texts, CHARACTERS):
        for s in shingler.sets(pa.array(part, pa.string())):
            keys = {(k, int((mix(s ^ np.uint64(k * 0x9E3779B9)) if k else s).min())) for k in range(3)} if len(s) else set()
            out.append(seen.isdisjoint(keys))
            seen |= keys
    return out


def bags_of(rows: list[tuple[str, bool]]) -> tuple[list[Counter], list[Counter]]:
    """The units of toxic and of clean texts, one of each family of copies. Units that texts share are one string;
    rows are emptied on the way, so that texts and their units are not held together."""
    one: dict[str, str] = {}
    bags: tuple[list[Counter], list[Counter]] = [], []
    first = first_of_kin([t for t, _ in rows])
    for at, (text, toxic) in enumerate(rows):
        rows[at] = None
        if first[at]:
            bags[not toxic].append(Counter({one.setdefault(u, u): n for u, n in units_of(text).items()}))
    return bags


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on a sample of labelled rows outside the held-out fold: the first FIT_TOXIC and FIT_CLEAN rows
    in hash order of id and text, as many of them as have FIT_TOTAL characters together, whole texts.

    Several labels of an id: their mean, 0.5 is toxic. Null ids and null texts are not fitted on; repeated
    rows count once, families of copies nearly so. Without rows of both labels nothing is toxic. The
    driver holds the sample: 2 x FIT_TOTAL characters at most.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic")).where(fold("doc_id", modulus) != held_out)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    known = written(known, "labels")
    rows = [(r["text"], toxic) for toxic, limit in ((True, FIT_TOXIC), (False, FIT_CLEAN)) for r in sample_rows(texts, limit, FIT_TOTAL, 3, known.where(F.col("toxic") == toxic))]
    machine = fit(*bags_of(rows))
    rows.clear()
    give_back()  # the driver goes on for long after this
    return machine


class scorer:
    """Scores of texts; the margins of units met before are remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.margins = machine, {}

    def learn(self, bags: list[Counter]) -> None:
        if len(self.margins) > CACHE:
            self.margins.clear()
        new = list(set().union(*bags).difference(self.margins))
        self.margins.update(zip(new, self.machine.words(new)))

    def __call__(self, texts: list[str | None]) -> list[float]:
        bags = [units_of(t) for t in texts]
        self.learn(bags)
        at = self.margins.__getitem__
        return self.machine.probability([profile(list(map(at, b)), list(b.values()), b.total()) for b in bags])


def toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.7, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: one map, no shuffle; whole texts.

    A text is scored by its units' margins, a unit of over WINDOW symbols by the worst of its windows.
    Null and empty texts score as a text without a toxic unit. A null id is in no fold (held_out
    false); repeated rows are scored each; an empty table gives no rows; other columns aren't read.
    The score depends on the text alone.
    """
    field = docs.schema[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one table of SYMBOLS ** 3 weights

    def make():
        score = scorer(shared.value)

        def one(batch: pa.RecordBatch):
            out = []
            for texts in by_characters(batch.column(2).to_pylist(), CHARACTERS):
                out += score(texts)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return one

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, modulus) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"doc_id {field.dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, whose text scores below the threshold: one map.

    Null and empty texts score as a text without a toxic unit. Null ids stay like others, repeated rows
    stay or go together; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        score = scorer(shared.value)

        def one(batch: pa.RecordBatch):
            keep = [s < threshold for texts in by_characters(batch.column(at).to_pylist(), CHARACTERS) for s in score(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

        return one

    return arrow_map(docs, make, docs.schema)
