import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from fieldloom.llm import turns
from fieldloom.llm.turns import WIDTH, LoserTree, prefix_trie


def brute(rows):
    """Every prefix of every rebuilt conversation, in a dictionary. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children[seq]) or 1
        saved[seq] = (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0) + sum(saved[x] for x in children[seq])
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest())
        for s, m in members.items()
    )


def rows_of(df):
    return sorted(map(tuple, df.select(*turns._COLUMNS).collect()))


def test_equals_brute_force_on_the_table(spark, data, monkeypatch):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(prefix_trie(table)) == want


@pytest.mark.parametrize("rows_in_range", [3, 10_000])
def test_copies_and_prefixes_over_many_ranges(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(turns, "RANGE_ROWS", rows_in_range)
    monkeypatch.setattr(turns, "PIECE_IDS", 2)
    rng = random.Random(4)
    rows = []
    for c in range(-30, 160):
        kind = rng.random()
        said = ["hello", "yes", "no", "go on"] if kind < 0.4 else [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        rows += [(c, t, "user" if t % 2 else None, x) for t, x in enumerate(said)]
    rows += [(500, None, None, None), (500, 1, "user", "é\U0001f600"), (500, 1, "user", "é\U0001f600"), (500, 1, "bot", ""), (None, 1, "user", "hello"), (700, 0, "user", "short"), (800, 0, "user", "x" * 100_000)]
    rows += [(900, t, "user", f"turn {t}") for t in range(300)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq string, n int").repartition(5)
    assert rows_of(prefix_trie(frame)) == brute(rows)


def test_empty_and_rows_without_id(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


def test_loser_tree_merges_by_common_turns_alone():
    rng = random.Random(9)
    words = [bytes([i]) * WIDTH for i in range(3)]
    stem = b"".join(rng.choice(words) for _ in range(40))
    rows = sorted((stem + b"".join(rng.choice(words) for _ in range(rng.randint(0, 6))), i) for i in range(900))
    for ways in (1, 2, 3, 7, 16):
        runs = [[] for _ in range(ways)]
        for row in rows:
            part = runs[rng.randrange(ways)]
            part.append((*row, turns.common(part[-1][0], row[0]) if part else 0, None))
        tree = LoserTree(runs)
        out = list(tree)
        assert [r[:2] for r in out] == rows
        assert [r[2] for r in out] == [0] + [turns.common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        # the 40 shared turns are looked at once for each run, not in each of the comparisons
        assert tree.compared < 60 * ways + 900 * 8
