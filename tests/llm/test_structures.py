"""Fingerprints, resharding, vectors, near-duplicates and the pipeline against brute force."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import _common, fingerprints as fp, jaccard, pivots, resharding, shingles
from fieldloom.llm._common import written
from fieldloom.llm.components import components
from fieldloom.llm.oracles import COSINE, JACCARD


# --- fingerprints


def test_fingerprints_follow_the_chain(documents, odd, empty):
    for df in (documents, odd):
        rows = fp.fingerprints(df).collect()
        docs = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        assert len(rows) == len(docs)
        got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
        repeated = {i for i, n in Counter(i for i, _ in docs).items() if n > 1}
        for at, (doc, text) in enumerate(docs):
            after = docs[(at + 1) % len(docs)]
            if doc not in repeated and after[0] not in repeated:
                half = len(text) // 2
                edited = text[: len(text) - half] + after[1][:half]
                assert got[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] == 1
        by_text = defaultdict(set)
        for r in rows:
            if r["doc_id"] not in repeated:
                by_text[dict(docs)[r["doc_id"]]].add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert all(len(v) == 1 for v in by_text.values())
    assert fp.fingerprints(empty).count() == 0


def plain_signatures(text):
    """The definition, symbol by symbol: runs, coin tossing, phrases, names, level by level."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & mask
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & mask
        return x ^ x >> 33

    def toss(x, before):
        k = ((x ^ before) & -(x ^ before)).bit_length() - 1
        return 2 * k + (x >> k & 1)

    power = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]
    symbols = [mix((b + 1) * 0xD1B54A32D192ED03 & mask) for b in text]
    found = set()
    for depth in range(1, 5):
        collapsed = []
        for x, run in ((x, len(list(g))) for x, g in itertools.groupby(symbols)):
            if run > 1 and depth > 1:
                found.add(mix(x + 100 + depth & mask) >> 32)
            collapsed.append(x if run == 1 else mix(x + run * 0xA24BAED4963EE407 & mask))
        symbols = collapsed
        label = [toss(x, p) for x, p in zip(symbols, [symbols[0] ^ 1, *symbols])]
        for _ in range(3):
            label = [toss(x, p) for x, p in zip(label, [label[0] ^ 1, *label])]
        n = len(symbols)
        starts = [i for i in range(n) if i == 0 or (label[i] > label[i - 1] and (i == n - 1 or label[i] > label[i + 1]))]
        symbols = [mix(sum(x * power[j & 63] for j, x in enumerate(symbols[a:b])) & mask) for a, b in zip(starts, [*starts[1:], n])]
        if depth >= 2:
            found |= {mix(x + depth & mask) >> 32 for x in symbols}
    return sorted(found)[:64]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    top = sorted({*a, *b})[:64]
    return sum(x in set(a) and x in set(b) for x in top) / len(top)


def test_fingerprints_are_brute_force(documents, odd):
    for df in (documents, odd.where("doc_id is null or doc_id <> 43")):
        rows = df.select("doc_id", "text").collect()
        ids = Counter(r["doc_id"] for r in rows)
        order = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        sign = lambda t: plain_signatures(t.encode()) if t else []
        shown = lambda s: "".join(f"{x:08x}" for x in s)
        got = {r["doc_id"]: r for r in fp.fingerprints(df).collect()}
        tried = 0
        for at, (doc, text) in enumerate(order):
            following = order[(at + 1) % len(order)]
            if ids[doc] == ids[following[0]] == 1 and len(text) < 6000 and len(following[1]) < 6000:
                tried += 1
                half = len(text) // 2
                own, edited, near = sign(text), sign(text[: len(text) - half] + following[1][:half]), sign(following[1])
                r = got[doc]
                assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(edited))
                assert (r["near_edited"], r["near_next"]) == (plain_likeness(own, edited), plain_likeness(own, near))
        assert tried > 20


def test_hot_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(fp, "HOT", 5)
    rows = [(i, f"text {i}") for i in range(40)] + [(None, f"none {i} " * 3) for i in range(60)] + [(7, f"seven {i}") for i in range(50)] + [((1 << 63) - 1, f"top {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fp.fingerprints(df).collect()
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), hashed[r]))
    want = Counter()
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want


def test_one_row_is_its_own_next(documents):
    row = fp.fingerprints(documents.limit(1)).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1


def test_edited_texts_are_nearer(documents):
    rows = [r for r in fp.fingerprints(documents).collect() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97
    assert np.mean([r["near_next"] for r in rows]) < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc déz\n", max_size=200), min_size=1, max_size=6))
def test_signatures_do_not_depend_on_the_batch(texts):
    raw = [t.encode() for t in texts]
    together = fp.signatures(raw)
    for t, s in zip(raw, together):
        assert np.array_equal(s, fp.signatures([t])[0])
        assert len(s) == 0 if not t else len(s) > 0


def test_interiors_agree_at_any_offset():
    rng = np.random.default_rng(2)
    body = rng.choice(list(b"abcdefghijklmnop qrst"), 3000).astype(np.uint8).tobytes()

    def names(text):
        sym, first = fp._BYTES[np.frombuffer(text, np.uint8)], np.array([0])
        for _ in range(2):
            sym, first, *_ = fp.level(sym, first)
        return set(sym.tolist())

    a, b = names(body), names(b"another beginning!" + body[7:] + b"xyz")
    assert len(a & b) > 0.95 * len(a)


def test_labels_of_neighbours_differ():
    sym = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    label = fp.toss(sym, np.array([0, 700]))
    assert label.max() < 6
    assert all(label[i] != label[i - 1] for i in range(1, 5000) if i != 700)


# --- resharding


def test_flow_moves_the_least():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        supply = [int(x) for x in rng.integers(0, 50, a)]
        capacity = resharding.equal_parts(sum(supply), b)
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert all(sum(v for (i, _), v in flow.items() if i == k) == supply[k] for k in range(a))
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(b))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))
    with pytest.raises(ValueError):
        resharding.min_cost_flow([2], [1], lambda i, j: 0)


def test_flow_with_costs_is_linear_programming():
    """Small cases by trying all integer flows."""
    supply, capacity, cost = [2, 2], [1, 2, 1], [[3, 1, 4], [1, 5, 2]]
    flow = resharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
    best = min(
        sum(f[i][j] * cost[i][j] for i in range(2) for j in range(3))
        for f in ([[a, b, 2 - a - b], [c, d, 2 - c - d]] for a in range(3) for b in range(3 - a) for c in range(3) for d in range(3 - c))
        if all(f[0][j] + f[1][j] <= capacity[j] for j in range(3))
    )
    assert sum(v * cost[i][j] for (i, j), v in flow.items()) == best


def test_reshard(documents, odd, empty):
    for df in (documents, odd):
        rows = resharding.reshard(df, resharding.hashed_layout(16), 16, 24).collect()
        sizes = lambda r: (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(map(sizes, df.collect()), key=repr)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    rows = resharding.reshard(documents, resharding.hashed_layout(16), 16, 24).collect()
    for r in rows:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 24
    assert max(load.values()) < max(1.1 * mean, mean + max(r["size"] for r in rows)) and min(load.values()) > 0.85 * mean
    moved, total = sum(r["size"] for r in rows if r["moved"]), sum(r["size"] for r in rows)
    assert moved < 0.5 * total  # a third at least has to move
    assert resharding.reshard(empty, resharding.hashed_layout(16), 16, 24).count() == 0


def test_a_hot_row_and_small_rows(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)] + [(5000 + i % 2, "y" * 9000) for i in range(6)], "doc_id bigint, text string")
    rows = resharding.reshard(df, resharding.hashed_layout(4), 4, 6).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3006 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.05 * min(load.values())


def test_equal_texts_stay_together(spark, documents):
    """All but those that a shard has no room for."""
    texts = [f"text {i} " * (i % 9 + 1) for i in range(900)]
    rows = [(i, texts[i % 900] if i < 2400 else "hot one") for i in range(4000)]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string"), documents):
        found = resharding.reshard(df, resharding.hashed_layout(16), 16, 24).join(df.select("doc_id", "text"), "doc_id").collect()
        total = sum(r["size"] for r in found)
        shards, size = defaultdict(set), Counter()
        for r in found:
            shards[r["text"] or ""].add(r["shard"])
            size[r["text"] or ""] += r["size"]
        assert all((len(s) == 1) == (size[t] <= total // (24 * resharding.WHOLE) or len(s) == 1) for t, s in shards.items())
        assert sum(len(s) > 1 for s in shards.values()) <= 24 * resharding.WHOLE
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    assert len(load) == 24


def test_rewrite_odd_tables(spark, odd, empty, tmp_path):
    frame = odd.withColumn("slot", F.lit(-1)).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int"))
    frame.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), 3, 4)
    names = [c for c in frame.columns if c not in ("shard", "slot")]
    got = spark.read.parquet(str(tmp_path / "new"))
    assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, frame.select(*names).collect()))
    slots = defaultdict(list)
    for r in got.select("shard", "slot").collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    empty.withColumn("shard", F.lit(0)).write.parquet(str(tmp_path / "none"))
    assert resharding.rewrite(spark, str(tmp_path / "none"), str(tmp_path / "out"), 1, 2) == []


def test_rewrite_in_many_tasks(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "FILE", 30_000)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    documents.withColumn("shard", resharding.hashed_layout(2)).write.partitionBy("shard").parquet(old)
    resharding.rewrite(spark, old, new, 2, 3)
    for shard in range(3):
        files = [f for f in os.listdir(f"{new}/shard={shard}") if f.endswith(".parquet")]
        assert len(files) > 2
        ranges = sorted((min(s), max(s)) for f in files if (s := [r["slot"] for r in spark.read.parquet(f"{new}/shard={shard}/{f}").select("slot").collect()]))
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_rewrite_touches_what_moves(spark, documents, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    documents.withColumn("shard", resharding.hashed_layout(3)).write.partitionBy("shard").parquet(old)
    touched = resharding.rewrite(spark, old, new, 3, 5)
    assert {int(x.split("=")[1]) for x in os.listdir(new) if "=" in x} == set(touched) == set(range(5))
    got, want = spark.read.parquet(new).select("doc_id", "text", "lang"), documents.select("doc_id", "text", "lang")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- vectors


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, [float(np.float32(v)) for v in base + rng.normal(size=16) * rng.choice([0, 0.1, 0.25])], label))
                n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [], 0), (n + 5, [1.0] * 3, 0), (None, rows[0][1], 0), (n + 6, rows[0][1], 0), (n + 6, rows[0][1], 0)]
    # dimensions of few vectors link too; the largest and least numbers are vectors like others
    rows += [(n + 10 + i, [float(np.float32(v)) for v in rng.normal(size=3)], 0) for i in range(30)] + [(n + 50, [2.0], 0), (n + 51, [5.0], 0), (n + 52, [-1.0], 0), (n + 53, [3e38] * 16, 1), (n + 54, [1e-38] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' as root", "1 as pivot", "2 as copies")
    got = sorted((tuple(r) for r in pivots.near_vectors(df).collect()), key=repr)
    good = [(i, np.array(v, float), la) for i, v, la in rows if i is not None and la is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    good = [(i, x / np.abs(x).max(), la) for i, x, la in good]
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1 if i != j else 2
                links[j] += 1 if i != j else 0
                parent[max(find(i), find(j))] = min(find(i), find(j))
    twice = n + 6
    links[twice] //= 2
    want = sorted(((i, links[i] if i is not None else 0, None if i is None else find(i), i is not None and find(i) == i) for i, _, _ in rows), key=repr)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.97 * all_ and all(g[1] <= w[1] for g, w in zip(got, want))
    if found == all_:
        assert got == want
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "STRETCH", 1)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 8))
    rows = [(i, [float(v) for v in base[i % 3] + rng.normal(size=8) * 0.02], 7) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, pivots.near_vectors(df).collect())) == [(i, 49, i % 3, i < 3) for i in range(150)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=30))
def test_unite(pairs):
    parent = np.arange(20)
    for a in range(0, len(pairs), 7):
        u, v = (np.array(x, np.int64) for x in zip(*pairs[a : a + 7]))
        pivots.unite(parent, u, v)
    want = list(range(20))
    for u, v in pairs:
        low, high = sorted((want[u], want[v]))
        want = [low if w == high else w for w in want]
    assert parent.tolist() == want


def test_lists_that_are_split_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(25, 12))
    rows = [(i, [float(v) for v in base[i % 25] + rng.normal(size=12) * 0.15], i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = sorted(map(tuple, pivots.near_vectors(df).collect()))
    assert sum(r[1] for r in want) > 500
    for split in (40, 4):
        monkeypatch.setattr(pivots, "SPLIT", split)
        assert sorted(map(tuple, pivots.near_vectors(df).collect())) == want


def test_vectors_join_block_pairs_last(spark, monkeypatch):
    """Lists, split or not, hold no vectors; blocks of many dimensions are small; an id may hold several vectors."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4, 32))
    vectors = [(i % 170, (base[i % 4] + 0.02 * rng.normal(size=32)).tolist(), i % 2) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, label int")
    want = sorted(map(tuple, pivots.near_vectors(df).collect()))
    seen = {}

    def noted(table, name, *rest):
        seen.setdefault(name, []).append(table.columns)
        return _common.written(table, name, *rest)

    monkeypatch.setattr(pivots, "written", noted)
    monkeypatch.setattr(pivots, "SPLIT", 10)
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 8 * 32 * 5)  # five vectors a block
    assert sorted(map(tuple, pivots.near_vectors(df).collect())) == want
    assert len(seen["posted"]) == 3 and not any("embedding" in columns for columns in seen["posted"] + seen["lists"])
    assert [columns for columns in seen["vectors"]] == [["label", "embedding", "vec_id", "copies", "vec"]]


def test_recall_with_many_pivots():
    """Pairs at a cosine of exactly 0.93 among 1024 pivots meet in a list and share enough pivots."""
    rng = np.random.default_rng(0)
    x, o = pivots.unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
    o = pivots.unit(o - (o * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * o
    table = pivots.choose(pivots.unit(rng.normal(size=(8192, 64))), 1024)
    assert len(table) == 1024
    a, b = (pivots.permutations(v, table, pivots.PREFIX) for v in (x, y))
    meet = (a[:, : pivots.ROUTE, None] == b[:, None, : pivots.ROUTE]).any((1, 2))
    both = (a[:, :, None] == b[:, None, :]).sum((1, 2))
    recall = (meet & (both >= pivots.SHARED)).mean()
    print("recall", recall)
    assert recall >= 0.95


def test_cosine_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    assert sorted(con.execute(COSINE).fetchall()) == sorted(map(tuple, pivots.near_vectors(spark.read.parquet(f"{data}/embeddings.parquet")).collect()))


# --- near-duplicates


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] * bool(words))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b\x1cz", max_size=60) | st.none(), max_size=8))
def test_shingles(texts):
    found = shingles.Shingler().sets(pa.array(texts, pa.string()))
    sets = [brute_set(t) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in sets]
    for a, x in zip(found, sets):
        for b, y in zip(found, sets):
            assert len(np.intersect1d(a, b)) == len(x & y)


def brute_components(rows):
    """rows: (id, text) -> {(id, text): component}; ids may repeat or be null."""
    sets = defaultdict(list)
    for i, t in rows:
        if s := brute_set(t):
            sets[s].append(i)
    keys = list(sets)
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(keys)):
        for b in range(a):
            i = len(keys[a] & keys[b])
            if 100 * i >= 80 * (len(keys[a]) + len(keys[b]) - i):
                parent[find(a)] = find(b)
    least = {}
    for k, key in enumerate(keys):
        ids = [i for i in sets[key] if i is not None] + [x for x in [least.get(find(k))] if x is not None]
        least[find(k)] = min(ids) if ids else None
    return {key: least[find(k)] for k, key in enumerate(keys)}


def check_near(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    least = brute_components(rows)
    want = sorted(((i, len(s := brute_set(t)), least[s] if s else i) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr) == want


def families(seed, docs):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage, rows = list(rng.choice(words, 40)), []
    base = [list(rng.choice(words, int(n))) for n in rng.integers(3, 150, 12)]
    for i in range(docs):
        text = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 1 + len(text) // 25))):
            text[int(rng.integers(len(text)))] = str(rng.choice(words))
        rows.append((i, " ".join(text + passage * (i % 5 == 0))))
    return rows


def test_near_duplicates(spark, documents, odd, empty):
    check_near(documents)
    check_near(odd)
    assert jaccard.near_duplicates(empty).count() == 0
    check_near(spark.createDataFrame(families(1, 150), "doc_id bigint, text string"))


def test_large_tiles_in_chunks(spark, monkeypatch):
    for tile in (7, 3):
        monkeypatch.setattr(jaccard, "TILE", tile)
        check_near(spark.createDataFrame(families(2, 160), "doc_id bigint, text string"))


def templates(count, seed=11):
    """Pages of one shop: 60 words that all have, 35 out of a pool."""
    rng = np.random.default_rng(seed)
    fixed, pool = [f"f{i}" for i in range(60)], [f"p{i}" for i in range(9)]
    return [(i, " ".join(fixed[:30] + list(rng.choice(pool, 35)) + fixed[30:])) for i in range(count)]


def test_large_tiles_of_unlike_texts_grow_with_the_rows(spark, monkeypatch):
    """Across chunks of pages of one template no more sets are sent than there are pages; links are whole."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    compared, plain = [], jaccard._verified

    def counted(members, *rest):
        compared.append(members.count())
        return plain(members, *rest)

    check_near(spark.createDataFrame(templates(120) + [(500 + i, t.replace("p3", "q", 1)) for i, t in templates(40)], "doc_id bigint, text string"))
    monkeypatch.setattr(jaccard, "_verified", counted)
    for n in (600, 1200):
        rows = [(2 * i + j, t if j else t.replace("p3", "q", 2)) for i, t in templates(n) for j in (0, 1)]
        jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert len(compared) == 4  # tiles, then what lies across their chunks
    assert compared[1] <= 1200 and compared[3] <= 2400, compared


def test_heavy_keys_and_light_ones_meet_alike(spark, monkeypatch):
    """The rows are the same whichever keys are broadcast."""
    many = spark.createDataFrame([(i % 7 if i < 60 else 100 + i, i) for i in range(100)], "k bigint, v bigint")
    few = written(many.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2).where("k <> 150"), "few")
    want = {how: sorted(map(tuple, many.join(few.drop("n"), "k", how).collect())) for how in ("inner", "left")}
    monkeypatch.setattr(_common, "HEAVY", 50)
    monkeypatch.setattr(_common, "HEAVY_ROWS", 1)
    for how in ("inner", "left"):
        assert sorted(map(tuple, _common.joined(many, few, ["k"], "n", how).collect())) == want[how]


def regrouped(rows, make, names):
    """What a shuffle by k, a sort and a map over the tiles give, in this process."""
    table = pa.Table.from_batches(rows).sort_by([(n, "ascending") for n in names])
    one, out = make(), []
    for batch in table.to_batches(max_chunksize=3):
        out += list(one(batch))
    return out + list(one.finish())


@pytest.mark.parametrize("batch,often", [(40, 2), (300, 32), (1 << 21, 3)])
def test_counting_is_brute_force(monkeypatch, batch, often):
    """Shared shingles and prefixes through batches, buckets and back, against a plain count."""
    monkeypatch.setattr(jaccard, "BATCH", batch)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    texts = [t for _, t in families(4, 60)] + ["", None, "one two", "one two"]
    dealt = []
    for part in (0, 1):  # two tasks; each leaves out the copies of its own
        dealer = jaccard.Dealer(5, 9, part)
        dealt += list(dealer(pa.RecordBatch.from_arrays([pa.array(texts[part::2], pa.string())], names=["text"]))) + list(dealer.finish())
    back = regrouped(dealt, jaccard._count(9), ["k", "batch"])
    got = regrouped(back, jaccard._choose(80), ["k", "kind"])
    mine = {r["node"]: r for b in got for r in b.to_pylist()}
    held = Counter()
    sets = {}
    for part in (0, 1):
        own = {jaccard.digest(s)[0]: s for s in shingles.Shingler().sets(pa.array(texts[part::2], pa.string())) if len(s)}
        sets |= own
        for s in own.values():
            held.update(s.tolist())
    level = {h: int(8 * np.log2(n)) for h, n in held.items()}
    expected = {}
    for node, s in sets.items():
        shared = sorted(h for h in s.tolist() if held[h] > 1)
        room = jaccard.prefix_length(len(s), 80) - (len(s) - len(shared))
        if room > 0 and shared:
            expected[node] = (len(s), room, sorted(shared, key=lambda h: (level[h], h))[: room + jaccard.EXTRA], shared)
    assert {n: (r["n_shingles"], r["room"], np.frombuffer(r["prefix"], "<u8").tolist(), np.frombuffer(r["shared"], "<u8").tolist()) for n, r in mine.items()} == expected


def test_all_links(spark, monkeypatch):
    rows = families(3, 120)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for tile in (1024, 7, 3):
        monkeypatch.setattr(jaccard, "TILE", tile)
        _, classes, pairs = jaccard.links(df, every=True)
        rep = {r["node"]: r["rep"] for r in classes.collect()}
        got = {tuple(sorted((rep[r["a"]], rep[r["b"]]))): r["overlap"] for r in pairs.collect()}
        first, want = {}, {}
        for i, t in rows:
            first.setdefault(brute_set(t), i)
        items = list(first.items())
        for a, (x, i) in enumerate(items):
            for y, j in items[:a]:
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    want[tuple(sorted((i, j)))] = n
        assert got == want


def test_bound_and_tree():
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 2**63, int(n)).astype(np.uint64) * np.uint64(2) for n in rng.integers(20, 300, 8)]
    sets = []
    for _ in range(200):
        b = base[int(rng.integers(8))]
        sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < rng.choice([0.5, 0.95, 1])], rng.integers(0, 2**63, 5).astype(np.uint64)])))
    points, sizes = jaccard.counts_of(sets), np.array([len(s) for s in sets])
    tree = jaccard.RTree(points, sizes)
    for i in range(200):
        near = set(tree.near(points[i], int(sizes[i]), 80).tolist())
        true = {j for j in range(200) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - n)}
        assert true <= near
        assert near == {j for j in range(200) if np.minimum(points[i], points[j]).sum() >= jaccard.need(int(sizes[i]), int(sizes[j]), 80)}


def test_jaccard_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert sorted(con.execute(JACCARD).fetchall()) == sorted(map(tuple, jaccard.near_duplicates(spark.read.parquet(f"{data}/documents.parquet")).collect()))


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(i, i + 1) for i in range(100, 140)]
    stars = spark.createDataFrame([(max(p), min(p)) for p in pairs], "node bigint, root bigint")
    parent = {i: i for p in pairs for i in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(stars).collect()}
    assert {i: got.get(i, i) for i in parent} == {i: find(i) for i in parent}
    assert components(stars.limit(0)).count() == 0


def test_keep_one(odd, empty):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    least = brute_components(rows)
    want = {i for i, t in rows if i is not None and (not brute_set(t) or least[brute_set(t)] == i)}
    got = [r["doc_id"] for r in kept.collect()]
    assert {i for i in got if i is not None} == want and len([i for i in got if i is not None]) == len(want)
    assert got.count(None) == sum(i is None for i, _ in rows)
    assert jaccard.keep_one(empty).count() == 0


# --- pipeline


def test_pipeline_stages(spark, data, documents, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.schema == docs.schema
        kept = out.collect()
        before = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[r["doc_id"]] == r for r in kept) and 0 < len(kept) <= len(before)
        if name == "near_duplicates":
            least = brute_components([(r["doc_id"], r["text"]) for r in before.values()])
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before.values() if not brute_set(r["text"]) or least[brute_set(r["text"])] == r["doc_id"]}
        docs = spark.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, data)
    assert whole.select(F.sum("length")).first() == packed.select(F.sum("length")).first()
    for df in (odd, empty):
        at = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, data)
            assert at.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, data).count() >= 0
