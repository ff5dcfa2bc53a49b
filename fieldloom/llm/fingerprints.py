"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases by deterministic coin tossing, the phrases get names from their
content, and the names are parsed again, level by level. Where a phrase ends depends on a few symbols
around it alone, so equal substrings have the same phrases inside, wherever they stand. The names of
the upper levels are the text's signatures; the fingerprint holds the smallest of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import arrow_map

#: Levels parsed; names of levels from FIRST on are signatures (a phrase holds about 3 of the level below).
LEVELS, FIRST = 4, 2
#: Signatures in a fingerprint, 32 bits each.
KEEP = 64
#: Bytes parsed at a time; a text is never cut, so one above this is parsed alone.
CHUNK = 1 << 20
#: An id of so few rows is never cut; ranges that an id may be cut into.
HOT, PARTS = 10_000, 1 << 16
_U = np.uint64
_POWER = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


def _toss_table(symbols: int) -> np.ndarray:
    """[x, previous] -> 2 * k + bit k of x, where k is the lowest bit in which the two differ."""
    x, p = np.meshgrid(np.arange(symbols), np.arange(symbols), indexing="ij")
    d = x ^ p
    k = np.zeros_like(d)
    for bit in range(symbols.bit_length(), -1, -1):
        k[(d >> bit) & 1 == 1] = bit
    return (2 * k + ((x >> k) & 1)).astype(np.uint8)


_TOSS = _toss_table(128)


def toss(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, neighbours distinct, each a function of the symbol and four before it.

    first: where texts begin; a symbol without predecessor tosses on its lowest bit.
    """
    prev = np.empty_like(sym)
    prev[1:] = sym[:-1]
    prev[first] = sym[first] ^ _U(1)
    d = sym ^ prev
    k = np.bitwise_count((d & (~d + _U(1))) - _U(1)).astype(_U)
    label = (k.astype(np.uint8) << 1) | ((sym >> k) & _U(1)).astype(np.uint8)
    before = np.empty_like(label)
    for _ in range(3):
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS[label, before]
    return label


def level(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases that the symbols fall into, and where texts begin among them; the symbols
    that stand in runs, and the text of each."""
    repeated, owner = sym[:0], first[:0]
    keep = np.empty(len(sym), bool)  # runs of one symbol become one symbol of its own
    keep[0] = True
    np.not_equal(sym[1:], sym[:-1], out=keep[1:])
    keep[first] = True
    at = np.flatnonzero(keep)
    if len(at) < len(sym):
        run = np.diff(at, append=len(sym)).astype(_U)
        first = np.searchsorted(at, first)
        sym = sym[at]
        long = np.flatnonzero(run > 1)
        repeated, owner = sym[long], np.searchsorted(first, long, side="right") - 1
        sym[long] = mix(sym[long] + run[long] * _U(0xA24BAED4963EE407))
    label = toss(sym, first)
    start = np.empty(len(sym), bool)  # a phrase starts at each local maximum of the labels
    start[1:] = label[1:] > label[:-1]
    falls = label[:-1] > label[1:]
    falls[first[1:] - 1] = True  # a text's last symbol has nothing after it
    start[:-1] &= falls
    start[first] = True
    at = np.flatnonzero(start)
    place = np.arange(len(sym)) - np.repeat(at, np.diff(at, append=len(sym)))
    names = mix(np.add.reduceat(sym * _POWER[place & 63], at))
    return names, np.searchsorted(at, first), repeated, owner


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """The KEEP smallest distinct 32-bit signatures of each text; of an empty one none."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    raw = np.frombuffer(b"".join(texts[i] for i in full), np.uint8)
    first = np.cumsum([0] + [len(texts[i]) for i in full[:-1]])
    sym, keys = _BYTES[raw], []
    for depth in range(1, LEVELS + 1):
        sym, first, repeated, of = level(sym, first)
        if depth > 1:  # what a run repeats counts too: runs of any length share it
            keys.append((of.astype(_U) << _U(32)) | (mix(repeated + _U(100 + depth)) >> _U(32)))
        if depth >= FIRST:
            owner = np.repeat(np.arange(len(full), dtype=_U), np.diff(first, append=len(sym)))
            keys.append((owner << _U(32)) | (mix(sym + _U(depth)) >> _U(32)))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    ends = np.searchsorted(keys >> _U(32), np.arange(len(full), dtype=_U), side="right")
    begin = 0
    for i, end in zip(full, ends.tolist()):
        out[i] = keys[begin : min(end, begin + KEEP)].astype(np.uint32)
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard index of the signature sets: among the KEEP smallest of both together, those in
    both. Two empty ones are alike (1), an empty and another not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twin = np.zeros(len(both), bool)
    twin[1:] = both[1:] == both[:-1]
    rank = np.cumsum(~twin)
    top = rank <= KEEP
    return float(twin[top].sum() / rank[top][-1])


def printed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


class Chain:
    """Rows (doc_id, text, bucket, ghost) in order: each gets the next one's text."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.held = None  # the last row: its successor isn't known yet

    def __call__(self, batch: pa.RecordBatch):
        rows, size = [], 0
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows.append(row)
            size += 2 * len(row[1] or "")
            if size > CHUNK:
                yield from self.part(rows)
                rows, size = [], 0
        if rows:
            yield from self.part(rows)

    def part(self, rows: list[tuple]):
        rows = ([self.held] if self.held else []) + rows
        self.held = rows[-1]
        texts = [r[1] or "" for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        if not pairs:
            return
        edited = []
        for i in pairs:
            half = len(texts[i]) // 2
            edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode("utf-8"))
        found = signatures([t.encode("utf-8") for t in texts] + edited)
        own, new = found[: len(texts)], found[len(texts) :]
        cols = [
            pa.array([rows[i][0] for i in pairs], self.id_type),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([printed(own[i]) for i in pairs]),
            pa.array([printed(s) for s in new]),
            pa.array([likeness(own[i], s) for i, s in zip(pairs, new)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _between(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are <= key; two short scans instead of one long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.size(F.filter(array([p[0] for p in parts]), lambda x: x <= key))
    fine = F.element_at(F.array(*map(array, parts)), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda x: x <= key))).cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text's last floor(n_chars / 2) code points are replaced by the next document's first,
    by descending id, the first after the last. Rows are dealt once, into ranges of ids cut at the
    ids' quantiles; an id, or null, that holds more rows than a range should is cut by its texts' hash.
    The head of each range also goes to the range before it, so every row meets its successor without
    a global sort in one task. The driver holds the quantiles and heads: a few numbers for each
    shuffle partition.

    Null text: empty; its fingerprint is the empty string. Null ids come last; rows of equal ids
    follow each other by their text's hash, equal rows in any order. One row is its own next. An
    empty table gives no rows. Other columns aren't read. Memory: about 50 bytes a byte of the
    longest text.
    """
    spark = docs.sparkSession
    field = docs.schema[id_col]
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    # rows go by descending key, then ascending hash: descending (key, nh)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", key).withColumn("nh", F.bitwise_not(F.xxhash64("text")))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select("key").where(F.col("key") != lowest).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)
    counts = rows.groupBy("key").agg(F.count("*").alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    share = max(1, total // n)
    hot = {r["key"]: -(-r["rows"] // share) for r in counts.where(F.col("rows") > max(HOT, 2 * share)).collect()}  # fewer than n of them
    top = (1 << 63) - 1  # quantiles are rounded
    bounds = sorted({min(int(b), top) for b in bounds} | set(hot) | {k + 1 for k in hot if k < top})
    base = (F.lit(len(bounds)) - _between(bounds, F.col("key"))).cast("long") * PARTS
    if hot:
        parts = F.broadcast(spark.createDataFrame(sorted(hot.items()), "key bigint, parts bigint"))
        rows = rows.join(parts, "key", "left")
        place = F.floor((F.bitwise_not("nh") / F.lit(2.0**64) + 0.5) * F.least("parts", F.lit(PARTS - 1)))
        base = base + F.when(F.col("parts").isNull(), 0).otherwise(F.least(place, F.col("parts") - 1, F.lit(PARTS - 1)))
    rows = rows.withColumn("bucket", base.cast("long"))
    heads = sorted((r["bucket"], r["h"]["key"], r["h"]["nh"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("key", "nh")).alias("h")).collect())
    ghosts = [(k, h, heads[i - 1][0]) for i, (_, k, h) in enumerate(heads)]  # the first range's head follows the last range
    ghosts = spark.createDataFrame(ghosts, "key bigint, nh bigint, ghost bigint")
    both = F.filter(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost")), F.struct(F.col("ghost").alias("to"), F.lit(True).alias("ghost"))), lambda x: x["to"].isNotNull())
    dealt = rows.join(F.broadcast(ghosts), ["key", "nh"], "left").select("doc_id", "text", "key", "nh", F.explode(both).alias("b"))  # a row for each range
    dealt = dealt.select("doc_id", "text", "key", "nh", F.col("b.to").alias("bucket"), F.col("b.ghost").alias("ghost"))
    ordered = dealt.repartitionByRange("bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), F.desc("nh")).select("doc_id", "text", "bucket", "ghost")

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        return Chain(to_arrow_type(field.dataType))

    schema = f"doc_id {field.dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(ordered, make, schema)
