"""Token counts, packing and pieces against their own libraries."""

import json
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fieldloom.llm.packing import STRIDE, SumOfSquares, materialize, pack, topped_up
from fieldloom.llm.pieces import SPACE, Encoder, Lanes, Model, Stream, decode, encode, encoder, stream
from fieldloom.llm import packing, tokens
from fieldloom.llm.tokens import checked, counter_of, merged_length, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTES)
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_merging_by_heap_and_list():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("ab", "c"): 2, ("a", "a"): 3, ("aa", "aa"): 4, ("a", "bc"): 5}
    assert merged_length([], ranks) == 0
    assert merged_length(list("abc"), ranks) == 1
    assert merged_length(list("aaaaa"), ranks) == 2
    assert merged_length(list("xyz"), ranks) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab '\n\t sdlvre019éß中😀<|endoftext|>", max_size=60))
def test_counts_are_the_librarys(text):
    assert counter_of(BYTES).count(text) == len(ids(text))


def test_token_counts(spark, documents, odd, empty):
    for df in (documents, odd):
        got = sorted((r for r in token_counts(df, BYTES).collect()), key=repr)
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(ids(r["text"])), len(ids(r["text"])) > 1024) for r in df.collect()), key=repr)
        assert sorted(map(tuple, got), key=repr) == want
    assert token_counts(empty, BYTES).count() == 0


def check_pack(df, size):
    rows = [r.asDict() for r in pack(df, BYTES, size=size, with_ids=True).collect()]
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(ids(r["text"]) + [0])
    for r in rows:
        assert len(r["ids"]) == r["length"] and crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0 and at < size
    assert sum(r["length"] for r in rows) == sum(len(t) for ts in texts.values() for t in ts)
    for doc, whole in texts.items():
        if len(whole) == 1:
            mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
            assert [i for r in mine for i in r["ids"]] == whole[0]
            assert {r["doc_tokens"] for r in mine} == {len(whole[0])}


def test_pack(documents, odd, empty):
    check_pack(documents, 1024)
    check_pack(odd, 64)
    assert pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        pack(empty, BYTES, size=1000)


def test_materialize(documents, odd, empty):
    for df in (documents, odd):
        rows = materialize(pack(df, BYTES, size=256, with_ids=True)).collect()
        assert all(len(r["ids"]) == 256 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in rows)
        assert sum(len(r["ids"]) for r in rows) == sum(len(ids(r["text"])) + 1 for r in df.collect())
        assert all(len(r["doc_ids"]) == len(r["starts"]) for r in rows)
    assert materialize(pack(empty, BYTES, with_ids=True)).count() == 0


def test_sum_of_squares_rule():
    """Each item goes where the squared counts of open windows end up least, by trying all places."""
    rng = np.random.default_rng(0)
    size, s = 32, SumOfSquares(32)
    for _ in range(400):
        item = int(rng.integers(1, size))
        before = s.levels.copy()
        cost = {}
        for h in range(size - item + 1):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                if h + item < size:
                    n[h + item] += 1
                cost[h] = int((n[1:size] ** 2).sum())
        s.place("x", item)
        assert int((s.levels[1:size] ** 2).sum()) == min(cost.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 20), min_size=1, max_size=4).filter(lambda w: sum(w) < 32), max_size=12))
def test_topping_up_keeps_every_id(lengths):
    windows, n = [], 0
    for w in sorted(lengths, key=sum, reverse=True):
        windows.append([])
        for size in w:
            windows[-1].append((n, 0, np.arange(size) + 100 * n))
            n += 1
    out = topped_up([list(w) for w in windows], 32)
    assert sorted(np.concatenate([x[2] for w in out for x in w]).tolist() if out else []) == sorted(np.concatenate([x[2] for w in windows for x in w]).tolist() if windows else [])
    assert all((total := sum(len(x[2]) for x in w)) == 32 or total & (total - 1) == 0 for w in out)
    assert all(ids[0] == 100 * key + start for w in out for key, start, ids in w)
    assert sum(sum(len(x[2]) for x in w) < 32 for w in out) <= 5


def test_most_ids_stay_where_the_rule_put_them(spark, monkeypatch):
    """At sf0.1 in eight partitions: rests that are whole lie in a window that the level array chose."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8)
    rows = pack(docs, BYTES).where("length < 1024").collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    rests = sum(r["length"] for r in rows)
    whole = sum(r["length"] for r in rows if r["start"] % 1024 == 0 and r["start"] + r["length"] == r["doc_tokens"])
    print("share of rests' ids placed whole:", whole / rests, "sequences", len(fill), "below 1024:", sum(n < 1024 for n in fill.values()))
    assert whole >= 0.9 * rests
    packers = {s // STRIDE for s in fill}
    assert len(packers) == spark.sparkContext.defaultParallelism  # fewer documents than PER_PACKER: a packer a core
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values()) and sum(n < 1024 for n in fill.values()) <= 10 * len(packers)


def test_packers_follow_each_other_in_few_tasks(spark, documents, monkeypatch):
    """Many packers, two tasks: the rows are those of a task for each."""
    monkeypatch.setattr(packing, "PER_PACKER", 16)
    docs = documents.select("doc_id", "text").coalesce(1)
    want = sorted(map(tuple, pack(docs, BYTES).collect()))
    monkeypatch.setattr(packing, "TASKS", 2)
    few = pack(docs, BYTES)
    assert few.rdd.getNumPartitions() == 2 and sorted(map(tuple, few.collect())) == want
    assert len({r[5] // STRIDE for r in want}) > 10


def test_unknown_settings_raise(tmp_path):
    import json

    spec = json.load(open(BYTES))
    for where, name, value in ((spec, "normalizer", {"type": "NFC"}), (spec["model"], "ignore_merges", True), (spec["pre_tokenizer"], "add_prefix_space", True), (spec["added_tokens"][0], "lstrip", True)):
        old, where[name] = where[name], value
        with pytest.raises(ValueError):
            checked(spec)
        where[name] = old
    assert checked(spec)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab  th e\ning▁éß中😀.", max_size=120))
def test_pieces_are_the_librarys(text):
    got = np.frombuffer(encoder(PIECES)([text])[0], "<u4").tolist()
    want = SP.encode(text)
    assert got == want
    assert encoder(PIECES).model.decode(got) == text.replace(SPACE, " ")
    if text:
        assert list(stream(encoder(PIECES).model, f" {text}".replace(" ", SPACE))) == want
        lanes = Lanes(encoder(PIECES).model, [f" {text}".replace(" ", SPACE)] * 2)
        assert [np.frombuffer(x, "<u4").tolist() for x in lanes.run()] == [want, want]


def test_stream_commits_early():
    s, out, most = Stream(encoder(PIECES).model), [], 0
    text = "▁" + "the quick brown fox ".replace(" ", SPACE) * 400
    for c in text:
        out += s.push(c)
        most = max(most, len(s.back))
    out += s.finish()
    assert most < 200 and out == SP.encode(text[1:].replace(SPACE, " "))


def test_unigram_weights():
    """The same engine on additive scores, against all segmentations."""
    model = Model(PIECES, kind="unigram")
    rng = np.random.default_rng(1)
    for w in ["▁hello", "▁tokens", "aaaa", "▁the▁ca"]:
        for p in list(model.index)[:2000]:
            model.score[model.index[p]] = -float(rng.random() * 5 + 1)

        def best(at):
            if at == len(w):
                return 0.0
            tries = [model.score[model.index[w[at:e]]] + best(e) for e in range(at + 1, min(len(w), at + model.longest) + 1) if w[at:e] in model.index]
            return max(tries + [model.unknown_score + best(at + 1)] * (w[at] not in model.index))

        got = list(stream(model, w))
        assert "".join(model.pieces[i] for i in got) == w
        assert abs(sum(model.score[i] for i in got) - best(0)) < 1e-9


def test_encode_and_decode(documents, odd, empty):
    for df in (documents, odd):
        rows = encode(df, PIECES, with_ids=True).collect()
        texts = sorted((repr((r["doc_id"], SP.encode(r["text"] or ""))) for r in df.collect()))
        assert sorted(repr((r["doc_id"], r["ids"])) for r in rows) == texts
        assert all(crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
        assert {r["doc_id"] for r in rows if not r["round_trip"]} == {r["doc_id"] for r in df.where(f"contains(text, '{SPACE}')").collect()}
    back = decode(encode(documents, PIECES, with_ids=True), PIECES)
    assert sorted(map(tuple, back.collect())) == sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert encode(empty, PIECES).count() == 0
    assert decode(encode(empty, PIECES, with_ids=True), PIECES).count() == 0
    got = {r["doc_id"]: r["text"] for r in decode(encode(odd, PIECES, with_ids=True), PIECES).collect() if r["doc_id"] in (40, 41, 42, 43, 45)}
    texts = {r["doc_id"]: (r["text"] or "").replace(SPACE, " ") for r in odd.collect()}
    assert got == {i: texts[i] for i in got} and len(got) == 5
    rows = odd.sparkSession.createDataFrame([(1, None, "x"), (None, [], "x"), (None, [], "x")], "doc_id bigint, ids array<int>, text string")
    assert sorted((tuple(r) for r in decode(rows, PIECES).collect()), key=repr) == [(1, None), (None, ""), (None, "")]


def test_all_ids_leave_through_window_commits(documents, monkeypatch):
    """What the query's encoder returns was committed, piece by piece, out of windows of bounded length."""
    model = Model(PIECES)
    counted = {"pieces": 0, "kept": 0, "out": 0}
    run, commit = Lanes.run, Stream.commit

    def counting_run(self):
        out = run(self)
        counted["pieces"] += self.left
        counted["kept"] = max(counted["kept"], self.kept)
        assert self.left == sum(len(p) for _, p, _ in self.out)
        return out

    def counting_commit(self):
        before = self.base
        out = commit(self)
        assert bool(out) == (self.base > before)
        counted["out"] += len(out)
        return out

    monkeypatch.setattr(Lanes, "run", counting_run)
    monkeypatch.setattr(Stream, "commit", counting_commit)
    texts = [r["text"] or "" for r in documents.collect()]
    encode_all = Encoder(model)
    got = encode_all(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [SP.encode(t) for t in texts]
    # the distinct stretches between cuts: each of their ids left by a commit (unknown characters are several ids)
    assert counted["pieces"] > 10_000 and counted["kept"] <= 4 * (model.longest + 2)
    alone = 0
    for c, ids in encode_all.known.items():
        alone += sum(1 for i in np.frombuffer(ids, "<u4").tolist() if i not in model.bytes.values())
    assert counted["pieces"] + counted["out"] >= alone


def test_lanes_commit_inside_long_texts():
    """Windows stay as long as a piece and what the survivors do not agree on, whatever the length."""
    model = encoder(PIECES).model
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("etaoinshrdlu."), 5000))
    lanes = Lanes(model, [SPACE + text, SPACE + text[::-1]])
    got = lanes.run()
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [SP.encode(text), SP.encode(text[::-1])]
    assert lanes.kept < 12 * model.longest and lanes.rows < 300
    s = Stream(model)
    out, most = [], 0
    for c in SPACE + text:
        out += s.push(c)
        most = max(most, len(s.back))
    assert out + s.finish() == SP.encode(text) and most < 8 * model.longest


def test_chunks_of_one_text_without_cuts():
    e = Encoder(Model(PIECES))
    text = "internationalization" * 12
    assert np.frombuffer(e([text])[0], "<u4").tolist() == SP.encode(text)


def test_ids_must_rise_with_merges(tmp_path):
    """Merging by least id is not merging by rank in such a file."""
    letters = list(tokens.byte_letters())
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 257, "bc": 256}
    spec = {"normalizer": None, "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "b c"]}}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    assert tokens.Counter(tokens.Vocabulary(str(path))).count("abc") == 2
    with pytest.raises(ValueError):
        tokens.Vocabulary(str(path)).ranks()
