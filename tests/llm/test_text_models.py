"""Quality, toxicity and language: rules on small inputs, held-out accuracy, odd rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import _common, language, quality, toxicity


def held(doc_id, modulus, fold):
    return zlib.crc32(str(doc_id).encode()) % modulus == fold


# --- quality


def test_quality_odd_rows(odd, odd_labels, empty, no_labels):
    rows = quality.quality(odd, odd_labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["keep"] is not None for r in rows)
    kept = quality.keep_good(odd, odd_labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in rows)
    assert quality.quality(empty, odd_labels).count() == 0 and quality.keep_good(empty, odd_labels).count() == 0
    assert all(r["evidence"] == 0 and r["keep"] for r in quality.quality(odd, no_labels).collect())


def test_quality_finds_junk(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    by = {r["doc_id"]: r["keep"] for r in quality.quality(documents, labels).collect()}
    rows = labels.collect()
    good = [by[r["doc_id"]] for r in rows if r["quality"] == 1]
    bad = [by[r["doc_id"]] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_quality_held_out(spark):
    """Labels of one fold kept from the fit: how it does on them."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.collect()
    fitted = spark.createDataFrame([r for r in rows if not held(r["doc_id"], 3, 1)], labels.schema)
    keep = {r["doc_id"]: r["keep"] for r in quality.quality(documents, fitted).collect()}
    good, bad = ([keep[r["doc_id"]] for r in rows if r["quality"] == k and held(r["doc_id"], 3, 1)] for k in (1, 0))
    print("held out at sf0.1: clean kept", np.mean(good), len(good), "others rejected", 1 - np.mean(bad), len(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_sparse_sites_shrink(spark):
    scored = spark.createDataFrame([("big", "a", 0.9)] * 400 + [("big", "b", 0.8)] * 200 + [("low", "a", 0.1)] * 300 + [("tiny", "a", 0.1)], "host string, path string, p double")
    rates = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in quality.sites(scored).collect()}
    mean = (360 + 160 + 30 + 0.1) / 901
    assert abs(rates["big", "a"][1] - 0.9) < 0.02 and abs(rates["low", "a"][0] - 0.1) < 0.02
    assert 0.1 < rates["tiny", "a"][0] < mean and rates["tiny", "a"][0] > rates["low", "a"][0] + 0.1


def test_strength():
    assert quality.strength(0.5, 100, 10, 0.0) == 1e6
    assert quality.strength(0.5, 1000, 10, 0.05) == pytest.approx(0.25 / (0.05 - 0.0025) - 1)


def test_sites_beyond_a_broadcast(documents, labels, monkeypatch):
    want = sorted(map(tuple, quality.quality(documents, labels).collect()))
    plain = sorted(map(repr, quality.keep_good(documents, labels).collect()))
    for heavy, rows in ((10**9, 0), (1, 0), (20, 0)):  # all sites are broadcast, none, some
        monkeypatch.setattr(_common, "HEAVY", heavy)
        monkeypatch.setattr(_common, "HEAVY_ROWS", rows)
        assert sorted(map(tuple, quality.quality(documents, labels).collect())) == want
        assert sorted(map(repr, quality.keep_good(documents, labels).collect())) == plain


def test_addresses(spark):
    df = spark.createDataFrame([("http://u@Ex.org:80/a/b?c", "x"), ("src1", "en"), (None, None)], "source string, lang string")
    host, path = quality.site_columns(df, "source", "lang")
    assert [tuple(r) for r in df.select(host, path).collect()] == [("ex.org", "/a"), ("src1", "en"), ("", "")]


# --- toxicity


def brute_kernel(a, b):
    """Sum over all pairs of index triples that spell the same, by their spans."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), 3):
        for j in itertools.combinations(range(len(b)), 3):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return total


@pytest.mark.parametrize("a,b", [("idiot", "id.iot"), ("abcabc", "acb"), ("aaaa", "aaa"), ("moron", "xyz")])
def test_kernel(a, b):
    sa, sb = toxicity.symbols([a]), toxicity.symbols([b])
    table = np.bincount(toxicity.codes(sb)[0], weights=toxicity.triples(sb.shape[1])[3], minlength=toxicity.SYMBOLS**3)
    folded = (table[toxicity.codes(sa)] * toxicity.triples(sa.shape[1])[3]).sum()
    assert folded == pytest.approx(brute_kernel(sa[0].tolist(), sb[0].tolist()))
    assert toxicity.self_kernel(sa)[0] == pytest.approx(brute_kernel(sa[0].tolist(), sa[0].tolist()))


def test_folding_landmarks_is_exact():
    """One weight for each subsequence gives what landmarks, root and coefficients give."""
    units, marks = ["idiot", "station", "moron", "union"], ["idiot", "moron", "nation"]
    z, root, tables = toxicity.nystrom(units, marks)
    w = np.array([0.7, -1.2, 0.4])
    machine = toxicity.Machine((root @ w) @ tables, 0.25)
    assert machine.units(units) == pytest.approx(z @ w + 0.25)


def test_gaps_and_insertions():
    bag = lambda s: Counter(s.split())
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeiorntslmd"), 6)) for _ in range(300)]
    clean = [bag(" ".join(rng.choice(plain, 30))) for _ in range(200)]
    toxic = [bag(" ".join(rng.choice(plain, 30)) + " " + w) for w in ("grobnak", "blivvet") * 30]
    machine = toxicity.fit(toxic, clean)
    hit, gap, other = machine.words(["grobnak", "gro-b.nak", "barbers"])
    assert hit > 0.5 and gap > 0 and other < 0 and gap > other + 0.5
    assert toxicity.units_of("you g r o b n a k !")["grobnak"] == 1


def test_scores_are_brute_force(spark, monkeypatch):
    """The whole score of a small table by plain sums: kernel with each landmark, worst units, logistic layer."""
    seen = {}
    nystrom, svm = toxicity.nystrom, toxicity.svm

    def caught_nystrom(units, landmarks):
        out = nystrom(units, landmarks)
        seen["landmarks"], seen["root"] = landmarks, out[1]
        return out

    def caught_svm(*a, **k):
        seen["w"] = svm(*a, **k)
        return seen["w"]

    monkeypatch.setattr(toxicity, "nystrom", caught_nystrom)
    monkeypatch.setattr(toxicity, "svm", caught_svm)
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeiorntslmd"), 5)) for _ in range(25)]
    docs = [(i, " ".join(rng.choice(plain, 6)) + (" grobnak" if i % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, toxic int")
    more = [(100, "you gro-bnak!"), (101, "a g r o b n a k b"), (102, "x" * 60 + "grobnak"), (103, None), (104, "Grobnak, grobnak")]
    df = spark.createDataFrame(docs + more, "doc_id bigint, text string")
    machine = toxicity.train(df, labels)
    coefficients = seen["root"] @ seen["w"][:-1]
    kernel = {}

    def k(a, b):
        if (a, b) not in kernel:
            kernel[a, b] = brute_kernel(toxicity.symbols([a])[0].tolist(), toxicity.symbols([b])[0].tolist())
        return kernel[a, b]

    def margin(unit):
        unit = unit.strip(toxicity.EDGES)
        if unit in machine.known:
            unit = ""
        parts = [unit] if len(unit) <= 24 else [unit[a : a + 24] for a in range(0, len(unit) - 12, 12)]
        return max(-1.0 if len(p) < 3 else sum(c * k(p, m) / math.sqrt(k(p, p) * k(m, m)) for c, m in zip(coefficients, seen["landmarks"])) + seen["w"][-1] for p in parts)

    def score(text):
        words = (text or "").lower().split()
        units = Counter(words)
        run = []
        for w in [*words, ""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
                continue
            if len(run) >= 4:
                units["".join(run)] += 1
            run = []
        m = {u: margin(u) for u in units}
        top = (sorted(m.values(), reverse=True) + [-1.0] * 4)[:4]
        hits = sum(n for u, n in units.items() if m[u] > 0)
        x = [*(min(max(v, -1), 2) for v in top), math.log(1 + hits), math.sqrt(hits / max(sum(units.values()), 1)), 1]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, machine.layer))))

    rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, machine).collect()}
    texts = dict(docs[:12] + more[:2] + more[3:])  # the long unit's plain sums take too long; its rule is tested below
    assert {i: rows[i] for i in texts} == pytest.approx({i: score(t) for i, t in texts.items()}, abs=2e-3)
    assert rows[1] > 0.7 > rows[0]


def test_toxicity_held_out_at_scale(spark):
    """A tenth of what the larger scale misses has no insult left that the machine could know."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    caught = np.mean([r["predicted"] for r in scored if r["toxic"] == 1])
    flagged = np.mean([r["predicted"] for r in scored if r["toxic"] == 0])
    print("held out at sf0.1: caught", caught, "flagged", flagged)
    assert caught > 0.85 and flagged < 0.03


def test_toxicity_held_out(documents, labels, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(big, toxicity.train(big, marks)).collect()}
    scored = [(rows[r["doc_id"]], r["toxic"]) for r in marks.collect()]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.7) for r, _ in scored)
    pos, neg = ([r["score"] for r, t in scored if t == k and r["held_out"]] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8 and np.mean(np.array(neg) >= 0.7) < 0.05 and np.mean(np.array(pos) >= 0.7) > 0.7


def test_toxicity_odd_rows(odd, odd_labels, empty, no_labels):
    machine = toxicity.train(odd, odd_labels)
    rows = toxicity.toxicity(odd, machine).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r, d in zip(sorted(rows, key=repr), sorted(odd.select("doc_id").collect(), key=repr)):
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[40] == by[41] == by[42] and len(by[None]) <= 2
    kept = toxicity.keep_clean(odd, machine)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] < 0.7 for r in rows)
    assert toxicity.toxicity(empty, machine).count() == 0 and toxicity.keep_clean(empty, machine).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(odd, toxicity.train(odd, no_labels)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(odd, toxicity.train(empty, odd_labels)).collect()} == {0}


def test_long_units_are_scored_whole():
    machine = toxicity.fit([Counter(["grobnak"])] * 40, [Counter(["station", "person", "letters"])] * 200)
    assert machine.words(["zz" * 40 + "grobnak" + "qq" * 40])[0] > machine.words(["zz" * 40 + "qq" * 44])[0]


# --- language


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(0)
    emit, step, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 1, 2])
    gamma, expected, norm = language.forward_backward(emit, lengths, step, start)
    at, log_z, pairs = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        weight = {p: math.exp(start[p[0]] + sum(emit[at + i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=int(n))}
        z = sum(weight.values())
        log_z += math.log(z)
        for i in range(n):
            want = [sum(v for p, v in weight.items() if p[i] == s) / z for s in range(3)]
            assert gamma[at + i] == pytest.approx(want)
        for p, v in weight.items():
            for a, b in zip(p, p[1:]):
                pairs[a, b] += v / z
        at += n
    assert expected == pytest.approx(pairs) and norm == pytest.approx(log_z)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_change_nothing(block):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 13, 2, 5, 10, 64, 7])
    emit, step, start = rng.normal(size=(lengths.sum(), 4)) * 6, rng.normal(size=(4, 4)) * 2, rng.normal(size=4)
    whole, cut = (language.forward_backward(emit, lengths, step, start, block=b) for b in (1000, block))
    assert cut[0] == pytest.approx(whole[0], abs=1e-12) and cut[1] == pytest.approx(whole[1]) and cut[2] == pytest.approx(whole[2])
    assert whole[0].sum(1) == pytest.approx(np.ones(len(emit)))


def test_long_lines_and_long_words_are_read_whole(documents):
    field = language.train(documents)
    tag = language.Tagger(field)
    by = {r["lang"]: r["text"].split() for r in documents.where("lang in ('en', 'es') and n_chars > 1500").limit(60).collect()}
    line = " ".join((by["en"] * 4)[:900] + (by["es"] * 4)[:700])
    ids, lengths, _ = tag.words([line])
    assert len(lengths) == 1 and lengths[0] > 1200
    emit = tag.table[ids].astype(float)
    cut, whole = (language.forward_backward(emit, lengths, field.step, field.start, block=b)[0] for b in (language.BLOCK, 10**6))
    assert cut == pytest.approx(whole, abs=1e-12)
    # one word of a thousand letters: its middle counts
    a, b = "".join(by["en"])[:400], "".join(by["es"])[:600]
    words = [a[:200] + x + a[200:] for x in (a * 2, b)]
    assert not np.allclose(*(field.emissions([language.cleaned(w)])[0] for w in words))
    rows = np.unique(next(language.by_length([words[1]]))[1])
    assert field.emissions([words[1]])[0] == pytest.approx(field.weights[next(language.by_length([words[1]]))[1][0]].sum(0), abs=1e-3) and len(rows) > 1000


def test_language_held_out(documents):
    rows = language.identify(documents, language.train(documents)).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_switches_inside_a_line(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = language.train(big)
    tag = language.Tagger(field)
    by = {r["lang"]: r["text"].split()[:8] for r in big.where("lang in ('en', 'es') and n_chars > 500").limit(40).collect()}
    ids, lengths, _ = tag.words([" ".join(by["en"] + by["es"])])
    gamma, _, _ = language.forward_backward(tag.table[ids].astype(float), lengths, field.step, field.start)
    said = [field.states[i] for i in gamma.argmax(1)]
    assert said[:8].count("en") >= 6 and said[8:].count("es") >= 6
    assert all(field.step[i, i] > field.step[i, j] for i in range(len(field.states)) for j in range(len(field.states)) if i != j)


def test_language_odd_rows(odd, empty):
    field = language.train(odd)
    rows = language.identify(odd, field).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (40, 41, 42))
    assert by[43]["lang_pred"] in {"de", "en"}
    assert language.identify(empty, field).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(empty)).collect()} == {"und"}


def test_units_of_the_sample_are_held_once():
    """The driver holds the sample's units: a unit is one string, texts are let go, copies count once."""
    rows = [(f"grobnak a{i} common b{i} word c{i} here d{i} too", i % 2 == 0) for i in range(6)]
    rows.append(rows[0])
    texts = list(rows)
    bags = toxicity.bags_of(rows)
    assert rows == [None] * 7 and [len(b) for b in bags] == [3, 3]
    assert bags == tuple([toxicity.units_of(t) for t, toxic in texts[:6] if toxic is side] for side in (True, False))
    held = [u for side in bags for bag in side for u in bag]
    assert len({id(u) for u in held}) == len(set(held)) < len(held)
