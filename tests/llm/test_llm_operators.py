"""The ten operators against brute force, and on the awkward tables: nulls, empty and very long
texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm import ann, fingerprints, licenses, lm, mixing, packing, simhash, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, fp long, tail int"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 500)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = {i: words(rng, int(rng.integers(1, 120))) for i in range(60)}
    for i in range(60, 75):  # near copies: a word or two changed
        w = base[i - 60 + 3].split()
        w[len(w) // 2] = "changed"
        base[i] = " ".join(w)
    for i in range(75, 95):  # exact copies, a large group of them
        base[i] = base[7]
    passage = words(rng, 60)
    for i in range(95, 105):
        base[i] = words(rng, 20) + "\n" + passage + "\t" + words(rng, 15)
    base[105], base[106], base[107] = None, "", "  \n "
    base[108] = words(rng, 30_000)
    base[109] = "x " * 200
    base[110] = "Ünïcödé <|endoftext|> \u2028 日本 " * 5
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else "hot", len(t or ""), 1.0, 2, 3, 4) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def run(df):
    return df.toPandas()


# --- 1 mixing -----------------------------------------------------------------------------------


def test_mixing_reaches_the_target_and_the_weights(spark):
    rows = [(i, "a b c d e f g h", "en", "big" if i < 800 else f"s{i % 4}", 1) for i in range(1000)]
    plan = run(mixing.mix_plan(spark.createDataFrame(rows, EMPTY), repeats=50.0))
    w = plan.groupby("source").weight.first()
    assert w.sum() == pytest.approx(1) and -(w * np.log(w)).sum() == pytest.approx(0.97 * math.log(5), abs=1e-6)
    share = plan.groupby("source").n_tokens.sum() / plan.n_tokens.sum()
    assert (abs(share - w) < 0.01).all()
    assert set(plan.doc_id) == set(range(1000))  # every document at least once
    uses = plan.groupby(["source", "doc_id"]).size()
    assert (uses.groupby("source").max() - uses.groupby("source").min() <= 1).all()
    assert not plan.duplicated(["doc_id", "epoch"]).any()


@pytest.mark.parametrize("band", [1024, 2])
def test_last_epoch_takes_blocks_in_key_order(spark, monkeypatch, band):
    monkeypatch.setattr(mixing, "BAND", band)
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "a b c d " * (1 + i % 5), "en", "big" if i < 500 else "small", 1) for i in range(700)]
    d = spark.createDataFrame(rows, EMPTY)
    plan = run(mixing.mix_plan(d, budget=0.6))
    tokens = {i: 4 * (1 + i % 5) for i in range(700)}
    for source, g in plan.groupby("source"):
        last = g[g.epoch == g.epoch.max()].sort_values(["block_key", "block", "doc_key", "doc_id"])
        budget = g.weight.iloc[0] * 0.6 * sum(tokens.values())
        spent = g.n_tokens.sum()
        assert budget - 1e-6 <= spent < budget + max(tokens.values())
        assert spent - last.n_tokens.iloc[-1] < budget  # it ends with the document that fills it
        ends = last.groupby("block_key").size()
        full = run(mixing.mix_plan(d, budget=50.0))
        whole = full[(full.source == source) & (full.epoch == 0)].groupby("block").size()
        names = last.drop_duplicates("block_key").set_index("block_key").block
        assert all(ends[k] == whole[names[k]] for k in ends.index[:-1])  # whole blocks but for the last


@pytest.mark.parametrize("budget", [None, 2.0])
def test_mixing_repetition_limit(spark, budget):
    share = np.array([1000, 10, 10]) / 1020
    shares = spark.createDataFrame([(f"s{k}", float(x)) for k, x in enumerate(share)], "_source string, share double")

    def passes(alpha):
        w = share**alpha / (share**alpha).sum()
        return (w / share).max() * (1 / (w / share).min() if budget is None else budget)

    free, bound = (mixing.temperature(shares, 0.99, most, budget) for most in (1e9, 5.0))
    assert passes(bound) == pytest.approx(5.0, abs=1e-6) and passes(free) > 5.0 and bound > free
    w = share**free / (share**free).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.99 * math.log(3), abs=1e-9)


def test_mixing_takes_any_number_of_sources(spark):
    """A source for each document: all weights are equal, each is passed through once."""
    d = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    got = mixing.mix_plan(d).agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert (got.n, got.s) == (120_000, 120_000) and got.lo == pytest.approx(1 / 120_000) == got.hi


def test_mixing_edges(spark, docs, texts):
    plan = run(mixing.mix_plan(docs))
    assert set(plan.doc_id) == set(texts)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and Counter(run(mixed).doc_id) == Counter(plan.doc_id)
    assert mixing.mix_plan(spark.createDataFrame([], EMPTY)).count() == 0
    names = ("_i", "_s", "_r", "_uses", "_use", "_source", "_tokens", "_row", "uses", "epoch", "weight")
    clashing = docs.select("*", *(F.lit(7).alias(n) for n in names))
    assert mixing.mix(clashing).columns == clashing.columns and run(mixing.mix(clashing).select(*names)).eq(7).all(axis=None)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, 1), (1, "a", None, None, 1)], EMPTY)
    assert mixing.mix(odd).count() == 3


# --- 2 nearest neighbours ---------------------------------------------------------------------------


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    x[500:520] = x[500]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9001, None, 1), (9002, [0.0] * 48, 1), (9003, [float("nan")] + [1.0] * 47, 1), (9004, [None] + [1.0] * 47, 1), (9100, [1.0, 2.0], 1)]
    found = run(ann.search_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")))
    assert set(found.query_id) == set(range(0, 3000, 100)) and (found.groupby("query_id").size() == 10).all()
    hits = 0
    for q, g in found.groupby("query_id"):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(d[g.vec_id], g.score)
        assert list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))
        hits += len(set(want) & set(g.vec_id))
    assert hits / 300 >= 0.95
    assert set(found[found.query_id == 500].vec_id) == set(range(501, 511))


def test_codes_estimate_and_bound_squared_distances():
    rng = np.random.default_rng(2)
    for d in (3, 64, 130):
        x, q = rng.normal(size=(500, d)) + 1, rng.normal(size=(40, d)) + 1
        c, turn = ann.centres(x[:200]), ann.rotation(d)
        codes = ann.Codes.of(x, c, turn)
        true = ((q[:, None] - x[None]) ** 2).sum(2)
        estimate, bound = codes.lower_bounds(q, c, turn)
        assert (bound <= true * (1 + 1e-9)).mean() > 0.97
        if d > 3:
            assert np.abs(estimate - true).mean() < 0.2 * true.mean() and np.corrcoef(estimate.ravel(), true.ravel())[0, 1] > 0.7
        bits = np.unpackbits(codes.bits.view(np.uint8), axis=1, count=d, bitorder="little")
        plain = (q @ turn) @ ((2.0 * bits - 1) / np.sqrt(d)).T
        inner, step = codes.inner(q, turn)
        assert (np.abs(inner - plain) <= step[:, None] / 2 * np.sqrt(d) + 1e-6).all()


def test_neighbours_in_double_precision_and_of_any_length(spark):
    rows = [(i, [float(i % 7), 1e39 if i == 51 else 1.0 + i * 1e-9]) for i in range(1, 60)] + [(100, [1.0, 1.0]), (200, [1.0, 1.0, 1.0]), (201, [1.0, 1.0, 2.0]), (300, [1e300, 1e300]), (400, [float("inf"), 1.0]), (7, [9.0, 9.0])]
    found = run(ann.search_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert set(found.query_id) == {100, 200, 300} and np.isfinite(found.score).all()
    d = {100: [1.0, 1.0], 300: [1e300, 1e300]}
    for q, own in d.items():
        want = sorted((math.dist(own, v), i) for i, v in rows if len(v) == 2 and i not in (q, 400))[:10]
        got = found[found.query_id == q].sort_values("rank")
        assert got.vec_id.tolist() == [i for _, i in want] and np.allclose(got.score, [s for s, _ in want], rtol=1e-12)
    only = found[found.query_id == 200]
    assert only.vec_id.tolist() == [201] and only.score.tolist() == [1.0]


def test_neighbours_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search_hundredths(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.rank, r.vec_id) for r in ann.search_hundredths(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search_hundredths(few.filter("vec_id = 0")).count() == 0


# --- 3 substrings --------------------------------------------------------------------------------------


def brute_repeats(texts):
    first = {}
    split = {i: (t or "").encode().split() for i, t in sorted(texts.items())}
    for i, w in split.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, w in split.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        out[i] = [x for x, g in zip(w, gone) if not g]
    return split, out


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeats_against_brute_force(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    split, kept = brute_repeats(texts)
    got = run(substrings.repeats_report(docs)).set_index("doc_id")
    assert len(got) == len(texts)
    for i in texts:
        assert got.n_words[i] == len(split[i]) and got.n_removed[i] == len(split[i]) - len(kept[i])
        assert got.kept_sha256[i] == hashlib.sha256(b" ".join(kept[i])).hexdigest()
    assert sum(got.n_removed) > 1000


def test_drop_repeats_keeps_columns_and_untouched_texts(spark, docs, texts):
    split, kept = brute_repeats(texts)
    out = substrings.drop_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    names = ("_hit", "_hash", "_starts", "starts", "text_hash", "anchors", "shared")
    clashing = substrings.drop_repeats(docs.select("*", *(F.lit(7).alias(n) for n in names)))
    assert clashing.columns == [*docs.columns, *names] and run(clashing.select(*names)).eq(7).all(axis=None)
    got = run(out).set_index("doc_id")
    for i, t in texts.items():
        want = t if len(kept[i]) == len(split[i]) else b" ".join(kept[i]).decode()
        assert got.text[i] == want if want is not None else got.text[i] is None
    assert substrings.repeats_report(spark.createDataFrame([], EMPTY)).count() == 0
    same = " ".join(map(str, range(20)))
    odd = run(substrings.repeats_report(spark.createDataFrame([(1, same), (1, same), (2, "z " + same), (None, same)], "doc_id long, text string")))
    assert sorted(odd.n_removed) == [0, 0, 0, 20]


@given(st.lists(st.lists(st.integers(1, 4), min_size=13, max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_index_matches_by_counting(sequences):
    lengths = np.array([len(s) for s in sequences])
    index = substrings.FMIndex(np.concatenate([np.array(s) for s in sequences]), lengths, np.arange(len(sequences)))
    first = np.cumsum(lengths + 1) - lengths - 1
    classes = index.slide(index.text, first, first + lengths - 1)
    flat = index.text.tolist()
    for s, f in zip(sequences, first):
        for k in range(len(s) - 12):
            window = s[k : k + 13]
            owner = min(j for j, o in enumerate(sequences) if any(o[m : m + 13] == window for m in range(len(o) - 12)))
            assert index.least[classes[f + k]] == owner
    # sequences that the index does not hold: half of them indexed, all of them asked for
    held = np.arange(len(sequences)) % 2 == 0
    words = pa.array([" ".join(map(str, s)).encode() for s in sequences] + [b"9 8 7 6 5 4 3 2 1 0 1 2 3 4"])
    least, windows = substrings.first_documents(words, np.arange(len(sequences) + 1), np.append(held, False), np.ones(len(sequences) + 1, bool))
    want = []
    for s in [*sequences, [9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1, 2, 3, 4]]:
        for k in range(len(s) - 12):
            want.append(min((j for j, o in enumerate(sequences) if held[j] and any(o[m : m + 13] == s[k : k + 13] for m in range(len(o) - 12))), default=substrings.NOWHERE))
    assert least.tolist() == want and windows.sum() == len(want)
    ends = np.flatnonzero(index.text > 0)
    length, low, high = index.matching(index.text, ends, 6)
    for e, n, a, b in zip(ends, length, low, high):
        if n:
            pattern = flat[e - n + 1 : e + 1]
            assert b - a == sum(flat[m : m + n] == pattern for m in range(len(flat)))
        assert n == 6 or flat[e - n] == 0


@given(st.lists(st.integers(0, 20), min_size=1, max_size=200), st.integers(0, 20), st.integers(0, 200))
@settings(max_examples=80, deadline=None)
def test_wavelet_tree_ranks(values, number, place):
    place = min(place, len(values))
    tree = substrings.WaveletTree(np.array(values))
    number %= 1 << tree.levels
    ends = tree.walk(np.array([number, number]), np.array([0, place], np.int32))
    assert ends[1] - ends[0] == values[:place].count(number)


# --- 4 toxicity ------------------------------------------------------------------------------------------


def test_machine_learns_pairs_that_weights_cannot():
    rng = np.random.default_rng(1)
    sets, labels = [], []
    for _ in range(3000):
        s = set(rng.integers(100, 2000, 40).tolist())
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        s |= {int(rng.integers(0, 5))} if insult else set()
        s |= {int(rng.integers(10, 15))} if group else set()
        sets.append(np.array(sorted(s), np.int32))
        labels.append(insult and group)
    labels = np.array(labels)
    machine = toxicity.learn(sets[:2400], labels[:2400])
    right = (machine.scores(sets[2400:]) >= 0.5) == labels[2400:]
    assert right.mean() > 0.97
    machine.v[:] = 0  # what the additive weights alone make of it
    assert ((machine.scores(sets[2400:]) >= 0.5) == labels[2400:]).mean() < right.mean()


@pytest.mark.parametrize("rule", [lambda a, b: a != b, lambda a, b: a == b, lambda a, b: a and b])
def test_machine_learns_pairs_that_tell_nothing_alone(rule):
    """Exclusive or, its opposite and both: alone the two terms say little or nothing of the label."""

    def corpus(n, seed):
        rng, sets, labels = np.random.default_rng(seed), [], []
        for _ in range(n):
            a, b = (rng.random(2) < 0.5).tolist()
            text = " ".join(["left"] * a + ["right"] * b + [f"w{x}" for x in rng.zipf(1.2, 60) % 3000])
            sets.append(toxicity.terms(text.encode()))
            labels.append(int(rule(a, b)))
        return sets, np.array(labels)

    machine = toxicity.learn(*corpus(2500, 1))
    sets, labels = corpus(600, 2)
    assert set(toxicity.terms(b"left right")) <= set(machine.known)
    assert ((machine.scores(sets) >= 0.5) == labels).mean() > 0.97


def test_scores_and_telling_pairs_by_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 25, int(rng.integers(0, 24)))).astype(np.int32) for _ in range(700)]
    labels = np.array([float((3 in s) != (17 in s)) if rng.random() < 0.97 else 0.0 for s in sets])
    machine = toxicity.Machine(np.arange(0, 25, 2, dtype=np.int32), seed=4)
    machine.w, machine.bias = rng.normal(size=13), 0.3
    for s, got in zip(sets, machine.scores(sets)):
        at = [int(x) // 2 for x in s if x % 2 == 0]
        raw = 0.3 + sum(machine.w[i] for i in at) + sum(machine.v[i] @ machine.v[j] for n, i in enumerate(at) for j in at[:n])
        assert got == pytest.approx(1 / (1 + math.exp(-raw)))
    alone = np.array([1, 2], np.int32)
    want, rate = set(), labels.mean()
    for i in range(25):
        for j in range(i):
            both = np.array([i in s and j in s for s in sets])
            n, k = both.sum(), labels[both].sum()
            if n and not {i, j} & {1, 2}:
                p = k / n
                bits = (p * math.log(p / rate) if p else 0) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0)
                if n * bits > toxicity.CHANCE:
                    want |= {i, j}
    got = [toxicity.telling_pairs(sets, labels, alone, part, 3) for part in range(3)]
    assert want and set(np.concatenate(got).tolist()) == want == set(toxicity.telling_pairs(sets, labels, alone).tolist())


def test_toxicity_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(2)
    bad = ["nasty", "vile", "rotten"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = words(rng, 60).split()
        if toxic:
            w[int(rng.integers(60))] = bad[i % 3]
        rows.append((i, " ".join(w), "en", "s", 1, 0.5, 1, 1, 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en", "s", 1, 0.5, 1, 1, 1), (5001, "", "en", "s", 1, 0.5, 1, 1, 1), (0, rows[0][1], "en", "s", 1, 0.5, 1, 1, 1)]
    labels += [(7777, 1, 1), (3, 1, None)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(toxicity.toxicity(d, lab))
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out & (got.doc_id < 900)]
    assert (held.predicted == (held.doc_id % 6 == 0)).mean() > 0.98
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and set(run(kept).doc_id) == set(got[got.score < 0.5].doc_id)
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
    assert set(run(toxicity.toxicity(d, lab.limit(0))).score) == {0.5}


def test_training_bound_counts_documents(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(toxicity, "learn", lambda sets, labels, together: learned.append(labels) or toxicity.Machine(np.zeros(0, np.int32)))
    d = spark.createDataFrame([(i, "plain words") for i in range(100)] + [(1, f"again {k}") for k in range(50)], "doc_id long, text string")
    toxicity.train(d, spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int"), 60)
    assert len(learned[0]) == 60
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    d = spark.createDataFrame([(free, f"again {k}") for k in range(50)], "doc_id long, text string")
    toxicity.train(d, spark.createDataFrame([(free, 1)], "doc_id long, toxic int"), 60)
    assert len(learned[1]) == 1


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "nasty words here" if i % 2 else "plain words here") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = [(i, int(i % 2)) for i in range(200)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in lab]
    a, b = (run(toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int"))).sort_values("doc_id").score.tolist() for x in (lab, turned))
    assert a == b


# --- 5 SimHash -----------------------------------------------------------------------------------------


def closed(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components_against_brute_force(docs, texts):
    prints = {i: simhash.simhash((t or "").encode()) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = closed(pairs, texts)
    got = run(simhash.fingerprint_components(docs)).set_index("doc_id")
    assert {i: got.component_id[i] for i in texts} == want
    assert all(got.fingerprint[i] == f"{p:016x}" for i, p in prints.items())
    assert prints[105] == prints[106] == prints[107] == 0


def test_simhash_by_definition():
    text = "The CAT sat on the mat the cat sat\u00a0on Ünder"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.simhash(text.encode()) == want
    assert simhash.simhash(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


@given(st.lists(st.integers(0, 255), min_size=1, max_size=60, unique=True), st.integers(0, 3))
@settings(max_examples=80, deadline=None)
def test_bk_tree_and_links(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:5]:
        assert sorted(values[n] for n, _ in tree.search(v, radius)) == sorted(x for x in values if (x ^ v).bit_count() <= radius)
    forest = simhash.linked(values, radius)
    want = closed([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius], range(len(values)))
    assert [forest.find(i) for i in range(len(values))] == [want[i] for i in range(len(values))]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_large_shards_are_dealt_in_chunks(docs, texts, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    sets = {i: set(simhash.shingles((t or "").encode(), 5)) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = closed(pairs, texts)
    kept = run(simhash.drop_near_duplicates(docs))
    assert sorted(kept.doc_id) == sorted(i for i in texts if want[i] == i) and list(kept.columns) == docs.columns


def test_near_duplicates_with_lines_repeated_differently_often(spark):
    rng = np.random.default_rng(21)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 20_000, n))
    rows = []
    for k in range(40):
        body, line = word(400), word(20)
        rows += [(2 * k, f"{body}\n{line}"), (2 * k + 1, "\n".join([body, *[line] * 40]))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * k for k in range(40)]


def test_near_duplicates_of_few_shingles_need_no_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_RADIUS", -1)  # the trees find nothing
    rng = np.random.default_rng(22)
    rows = []
    for k in range(30):  # 10 to 31 shingles, and two words more
        words = [f"w{x}" for x in rng.integers(0, 20_000, int(rng.integers(14, 36)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "a", "b"]))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * k for k in range(30)]


def test_simhash_edges(spark):
    assert simhash.fingerprint_components(spark.createDataFrame([], EMPTY)).count() == 0
    odd = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.fingerprint_components(odd).collect())
    assert got == [(-1, 3), (1, 1), (3, 3), (3, 3)]
    assert simhash.drop_near_duplicates(odd).count() == 4


# --- 6 licenses --------------------------------------------------------------------------------------------


def test_license_scan_against_all_pairs(spark, texts):
    notices = {200: "Blah blah\nReleased under the MIT License.\nmore", 201: "this work is licensed under the GNU General Public License, version 3. mit-license MIT   license", 202: "Licensed under CC BY-NC 4.0.", 203: "apache\n\nlicense", 204: "licensed under the apache version 2 0", 205: "permit license", 206: None}
    every = dict(texts) | notices
    d = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, 1, 1) for i, t in every.items()], DOCS)
    got = run(licenses.license_scan(d)).set_index("doc_id")
    assert len(got) == len(every)
    assert (got.base_labels[200], got.n_base[200], got.first_word[200]) == ("mit", 1, 5)
    assert (got.base_labels[201], got.n_base[201]) == ("gpl,mit", 3) and got.last_word[201] - got.first_word[201] == 7
    assert (got.base_labels[202], got.labels[202], got.score[202]) == ("", "cc-by-nc", 1.0)
    assert got.base_labels[203] == "apache" and got.base_labels[205] == ""
    assert (got.base_labels[204], got.labels[204]) == ("", "apache")
    sets = [(label, set(licenses.words(t.encode()))) for label, t in licenses.TEMPLATES]
    for i, t in every.items():
        best = max((len(s & set(b)) / len(s) for b in licenses.blocks((t or "").encode()) for _, s in sets), default=0)
        assert got.score[i] == pytest.approx(1.0 if got.n_base[i] else best if best >= 0.8 else 0.0)


@given(st.lists(st.sampled_from("a b c d e f g h i j".split()), max_size=12), st.sampled_from([0.5, 0.8, 1.0]))
@settings(max_examples=100, deadline=None)
def test_filters_lose_no_match(block, contained):
    templates = (("x", "a b c d"), ("y", "c d e f g h"), ("z", "a"), ("w", "h i j a b"))
    index = licenses.Index(templates, {b"a": 5, b"b": 3, b"c": 9}, contained)
    block = [w.encode() for w in block]
    want = {k: len(s & set(block)) / len(s) for k, s in enumerate(index.sets) if len(s & set(block)) >= contained * len(s) - 1e-9}
    assert index.matches(block) == want


@pytest.mark.parametrize("columns", [30, 70, 80])
def test_wrapped_notices_are_found(columns):
    index = licenses.Index(licenses.TEMPLATES, {})
    for label, notice in licenses.TEMPLATES:
        for before in range(0, 70, 7):
            text = "\n".join(textwrap.wrap(" ".join(["blah"] * before + [notice] + ["more"] * 40), columns, break_long_words=False))
            *_, labels, score = licenses.scan(text.encode(), index)
            assert label in labels.split(",") and score == 1.0
    long = " ".join(f"w{k}" for k in range(150))
    wrapped = "\n".join(textwrap.wrap("x " * 100 + long, 70)).encode()
    assert licenses.scan(wrapped, licenses.Index((("own", long),), {}))[5:] == ("own", 1.0)


def test_whole_license_texts_are_labelled():
    index = licenses.Index(licenses.TEMPLATES, {})
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
    free = "This is free and unencumbered software released into the public domain."
    for text, label in ((mit, "mit"), (bsd, "bsd"), (isc, "isc"), (free, "unlicense")):
        wrapped = "some words before\n" + "\n".join(textwrap.wrap(text, 50)) + "\nand after"
        assert licenses.scan(text.encode(), index)[5] == licenses.scan(wrapped.encode(), index)[5] == label
    assert licenses.scan(b"the software that they use is free for any purpose and they provide it with notice " * 9, index)[5] == ""


def test_every_place_of_a_phrase_counts():
    text = ("mit license mit license " * 3000 + "x general public license").encode()
    n_words, n_base, first, last, base, *_ = licenses.scan(text, licenses.Index(licenses.TEMPLATES, {}))
    assert (n_words, n_base, first, last, base) == (12004, 6001, 0, 12001, "gpl,mit")


# --- 7 masked pseudo-likelihood --------------------------------------------------------------------------


def test_likelihood_prefers_order_and_matches_by_hand(spark):
    rng = np.random.default_rng(3)
    cycle = [f"t{k}" for k in range(12)]
    rows = []
    for i in range(400):
        at = int(rng.integers(12))
        rows.append((i, " ".join(cycle[(at + k) % 12] for k in range(80))))
    rows += [(1000, " ".join(rng.permutation(rows[0][1].split()))), (1001, None), (1002, ""), (1003, "T0")]
    d = lm.tokenized(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    counts = lm.bucket_counts(d)
    assert counts.sum() == sum(len((t or "").split()) for _, t in rows)
    net = lm.train(d, counts)
    got = run(lm.score(d, net, counts)).set_index("doc_id")
    assert got.mean_log_likelihood[1000] < got.mean_log_likelihood[0] - 0.5
    assert got.n_tokens[1001] == 0 and got.log_likelihood[1001] == 0 and math.isnan(got.mean_log_likelihood[1002])
    of, within = lm.class_table(counts)
    ids, trees = lm.tokens(rows[7][1].encode()), lm.Trees(counts)
    total = 0.0
    for k, own in enumerate(ids):
        window = [int(ids[j]) & (lm.EMBEDDED - 1) if 0 <= j < len(ids) else lm.EMBEDDED for j in (k - 2, k - 1, k + 1, k + 2)]
        h = np.tanh(net.e[window].ravel() @ net.w + net.b)
        z = h @ net.u + net.c
        total += z[of[own]] - np.log(np.exp(z).sum())
        for node, right in zip(*(x.tolist() for x in trees.forks(np.array([own]))[1:])):
            odds = trees.odds[node] + net.v[-1, node] + sum(net.v[f, node] * h[f] for f in range(lm.FORK))
            total -= np.log1p(np.exp(-odds if right else odds))
    assert got.log_likelihood[7] == pytest.approx(total, rel=1e-4)
    assert np.exp(within).sum() == pytest.approx(len(set(of)), rel=1e-6)


def test_likelihood_tells_words_of_one_class_apart(spark):
    """Far more words than classes, all equally frequent: in each pair of documents the other half of
    a fixed pair stands in one place, a word of the same count and class."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{side}{k}" for k in rng.integers(0, 1000, 60) for side in "ab")) for i in range(2000)]
    d = lm.tokenized(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = lm.bucket_counts(d)
    net, trees = lm.train(d, counts, rounds=1), lm.Trees(counts)
    of, within = lm.class_table(counts)
    assert np.bincount(of[counts > 0]).max() > 20
    # without the hidden layer the trees give the counts' shares, with any they sum to one in each class
    every = np.arange(lm.BUCKETS)
    assert net.log_within(np.zeros((1, lm.HIDDEN), np.float32).repeat(len(every), 0), every, trees).shape == every.shape
    assert lm.Network().log_within(np.zeros((len(every), lm.HIDDEN), np.float32), every, trees) == pytest.approx(within, abs=1e-4)
    h = np.tanh(rng.normal(0, 1, (1, lm.HIDDEN))).astype(np.float32).repeat(len(every), 0)
    p = net.log_within(h, every, trees)
    assert np.bincount(of, np.exp(p)) == pytest.approx(np.ones(of.max() + 1), abs=1e-3)
    assert np.abs(p - within)[counts > 0].max() > 0.1


def test_every_position_is_trained_once():
    found = [np.arange(n, dtype=np.int32) + 100 * n for n in (0, 1, 2, 3, 7, 40)]
    seen = np.concatenate([lm.examples(found, r, lm.ROUNDS)[1] for r in range(lm.ROUNDS)])
    assert sorted(seen.tolist()) == sorted(np.concatenate(found).tolist())


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    """Repeated rows too, and through several shards and levels of averaging."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 700)
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(12)
    rows = [(i % 180, words(rng, int(rng.integers(1, 90)))) for i in range(200)] + [(7, "the same row"), (None, "no id")] * 3 + [(9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (run(lm.pseudo_likelihood(d.repartition(n))).sort_values(["doc_id", "n_tokens", "mean_log_likelihood"], ignore_index=True) for n in (2, 13))
    assert len(a) == len(rows) and a.doc_id.equals(b.doc_id)
    assert np.abs(a.mean_log_likelihood - b.mean_log_likelihood).max() < 1e-6
    same = a[(a.doc_id == 7) & (a.n_tokens == 3)]
    assert len(same) == 3 and same.log_likelihood.nunique() == 1


def test_held_out_documents_beat_their_words_counts(spark):
    """Sentences whose words come in fixed pairs: the window tells the partner, counts do not."""
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 60, 40))) for i in range(700)]
    d = lm.tokenized(spark.createDataFrame(rows, "doc_id long, text string"))
    learned, held = d.filter("doc_id < 600"), d.filter("doc_id >= 600")
    counts = lm.bucket_counts(learned)
    got = run(lm.score(held, lm.train(learned, counts), counts)).mean_log_likelihood.mean()
    share = np.log((counts + 1) / (counts + 1).sum())
    plain = np.mean([share[lm.tokens(t.encode())].mean() for i, t in rows if i >= 600])
    assert got > plain + 0.3


def test_likelihood_empty_table(spark):
    assert lm.pseudo_likelihood(spark.createDataFrame([], EMPTY)).count() == 0


# --- 8 URLs ------------------------------------------------------------------------------------------------


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, after = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = after[: next((k for k, c in enumerate(after) if c in "?#"), len(after))]
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def test_urls_rules_and_templates(spark):
    rows = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x=/q", "https://example.org/en/17#t", "http://example.org", "http://notexample.org/es/", "x://b.com/fr/2/a", "http://b.com/de/", "http://b.com?u=http://c.org/", "http://b.net/de/5"]
    rows += [f"http://h{i % 3}.com/de/{i}.html" for i in range(60)] + [f"http://h{i % 3}.com/fr/{i}" for i in range(60)] + [f"http://h0.com/user/name{i}x/p" for i in range(40)] + ["http://h0.net/a/b/c/d/e/f/g/h/i"] * 2
    d = spark.createDataFrame([(i, u, "<p>", "x", 1.0) for i, u in enumerate(rows)], "page_id long, url string, html string, host string, purity double")
    got = run(urls.judge(d)).set_index("page_id")
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        host, path, rule = brute_rule(u)
        assert (got.host[i], got.path[i]) == (host, path)
        assert got.rule[i] == (rule[0] if rule else None)
        if rule:
            assert got.verdict[i] == rule[1]
    assert set(got[got.path.str.startswith("/user/")].template) == {"/user/*/p"}
    assert set(got.verdict) == {"allow", "block"}
    assert urls.judge(d.limit(0)).count() == 0


def test_unruled_pages_follow_their_template(spark):
    rules = (("block", "bad.com", "/spam/"), ("allow", "bad.com", "/news/"))
    rows = [f"http://bad.com/spam/{i}" for i in range(30)] + [f"http://bad.com/news/{i}" for i in range(30)] + ["http://other.net/spam/9", "http://other.net/news/9"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = run(urls.judge(d, rules)).set_index("page_id")
    assert got.verdict[60] == "block" and got.verdict[61] == "allow" and got.rule.isna().sum() == 2


def test_one_more_section_leaves_the_large_ones_literal(spark):
    rules = (("block", "com", "/de/"), ("allow", "com", "/fr/"))
    rows = [f"http://h.com/{x}/{i}" for x in ("de", "fr") for i in range(60)] + [f"http://h.net/{x}/{i}" for x in ("de", "fr") for i in range(60)]
    rows += [f"http://h.net/section{i}/1" for i in range(30)]
    d = spark.createDataFrame([*enumerate(rows)], "page_id long, url string")
    got = run(urls.judge(d, rules)).sort_values("page_id")
    assert got.verdict.tolist()[:240] == (["block"] * 60 + ["allow"] * 60) * 2
    assert got.template.tolist() == (["/de/{n}"] * 60 + ["/fr/{n}"] * 60) * 2 + ["/*/{n}"] * 30


def test_branches_that_differ_far_down_are_told_apart(spark):
    rules = (("block", "h.com", "/a/b/c/d/e/f/g/bad/"), ("allow", "h.com", "/a/b/c/d/e/f/g/good/"))
    rows = [f"http://h.{top}/a/b/c/d/e/f/g/{x}/{i}" for top in ("com", "net") for x in ("bad", "good") for i in range(40)]
    got = run(urls.judge(spark.createDataFrame([*enumerate(rows)], "page_id long, url string"), rules)).sort_values("page_id")
    assert got.verdict.tolist() == (["block"] * 40 + ["allow"] * 40) * 2
    assert set(got.template) == {"/a/b/c/d/e/f/g/bad/{n}", "/a/b/c/d/e/f/g/good/{n}"}


def brute_tree(counts):
    """{(host, form): (template, purity)} by plain recursion, from {(host, form): [n, labelled, blocked]}."""
    out = {}

    def apart(l1, b1, l2, b2):
        if not l1 or not l2:
            return None
        pooled = (b1 + b2) / (l1 + l2)
        return abs(b1 / l1 - b2 / l2) > 1.96 * math.sqrt(pooled * (1 - pooled) * (1 / l1 + 1 / l2))

    def grow(host, forms, template, k):  # forms: {form: (key, counts)}
        if len(forms) == 1 or all(len(f) <= k for f in forms):
            for f in forms:
                out[host, f] = template + f[k:]
            return
        children = defaultdict(dict)
        for f in forms:
            children[f[k] if len(f) > k else None][f] = forms[f]
        total = {c: [sum(x[i] for x in fs.values()) for i in range(3)] for c, fs in children.items()}
        for f in children.pop(None, {}):
            out[host, f] = template
        labelled, blocked = (sum(total[c][i] for c in children) for i in (1, 2))
        steps = defaultdict(list)
        for c in children:
            n, m, b = total[c]
            rare = len(children) > 20 and n < 20 and m < 20 and not (m >= 5 and apart(m, b, labelled - m, blocked - b)) and c not in ("#n", "#x")
            steps["#*" if rare else c].append(c)
        rates = {s: [sum(total[c][i] for c in cs) for i in (1, 2)] for s, cs in steps.items()}
        groups, n, b = [], 0, 0
        for s in sorted(steps, key=lambda s: (rates[s][1] / rates[s][0] if rates[s][0] else -1, s)):
            if groups and apart(n, b, *rates[s]) is False:
                groups[-1].append(s)
                n, b = n + rates[s][0], b + rates[s][1]
            else:
                groups.append([s])
                n, b = rates[s]
        for g in groups:
            name = min(g) + (f"#{len(g) - 1}" if len(g) > 1 else "")
            grow(host, {f: x for s in g for c in steps[s] for f, x in children[c].items()}, (*template, name), k + 1)

    for host in {h for h, _ in counts}:
        grow(host, {f: x for (h, f), x in counts.items() if h == host}, (), 0)
    nodes, everywhere, whole = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for (host, form), template in out.items():
        for i in (1, 2):
            v = counts[host, form][i]
            everywhere[template][i - 1] += v
            whole[i - 1] += v
            for d in range(len(template) + 1):
                nodes[host, template[:d]][i - 1] += v
    for (host, form), template in out.items():
        p = (everywhere[template][1] + 4 * (whole[1] + 1) / (whole[0] + 2)) / (everywhere[template][0] + 4)
        for d in range(len(template) + 1):
            m, b = nodes[host, template[:d]]
            p = (b + 4 * p) / (m + 4)
        out[host, form] = (template, p)
    return out


def test_templates_and_purity_by_brute_force(spark):
    rng = np.random.default_rng(14)
    counts = {}
    for _ in range(900):
        host = f"h{rng.integers(3)}"
        form = tuple(str(x) for x in rng.choice(["a", "b", "c", "#n", "#x", "{x}", "*", *(f"r{k}" for k in range(40))], int(rng.integers(0, 5)), p=[0.15] * 3 + [0.1, 0.05, 0.02, 0.02, *[0.36 / 40] * 40]))
        m = int(rng.integers(0, 9)) * int(rng.random() < 0.5)
        old = counts.get((host, form), [0, 0, 0])
        blocked = int(rng.binomial(m, 0.9 if form[:1] in (("a",), ("b",)) else 0.1))
        counts[host, form] = [old[0] + m + int(rng.integers(1, 9)), old[1] + m, old[2] + blocked]
    rows = [(h, list(f), *c) for (h, f), c in counts.items()]
    d = spark.createDataFrame(rows, "host string, form array<string>, n long, labelled long, blocked long")
    got = {(r.host, tuple(r.form)): (tuple(r.template), r.purity) for r in urls.template_purity(d).collect()}
    want = brute_tree(counts)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    names = {s for t, _ in want.values() for s in t}
    assert any(s.startswith("#*") for s in names) and any("#" in s[1:] for s in names)


def test_braces_and_endings_in_urls_are_no_wildcards(spark):
    rows = [f"http://h.com/x/{{{i:06d}-abc}}/p" for i in range(300)] + [f"http://h.com/y/{i}.{chr(97 + i % 26) * (1 + i // 26)}" for i in range(300)] + ["http://h.com/*/q", None]
    got = run(urls.judge(spark.createDataFrame([*enumerate(rows)], "page_id long, url string"))).sort_values("page_id")
    assert set(got.template[:300]) == {"/x/*/p"} and set(got.template[300:600]) == {"/y/*"} and got.template.tolist()[600] == "/*/q"


# --- 9 fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints_follow_the_successor(spark, docs, texts):
    got = run(fingerprints.document_fingerprints(docs)).set_index("doc_id")
    ids = sorted(texts)
    near, far = [], []
    for k, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = fingerprints.fingerprint(text.encode()), fingerprints.fingerprint(changed.encode())
        assert (got.fingerprint[i], got.edited_fingerprint[i]) == (a.hex(), b.hex())
        assert got.near_edited[i] == pytest.approx(fingerprints.likeness(a, b)) and 0 <= got.near_next[i] <= 1
        if len(text) > 200 and text != following:
            near.append(got.near_edited[i])
            far.append(got.near_next[i])
    assert np.mean(near) > np.mean(far) + 0.2
    prints = {i: int(got.fingerprint[i], 16) for i in ids}
    for i in ids:
        assert got.n_near[i] == sum((prints[i] ^ prints[j]).bit_count() <= 3 for j in ids if j != i)


def test_block_tables_find_every_pair(spark):
    rng = np.random.default_rng(4)
    base = [int.from_bytes(rng.bytes(16)) for _ in range(20)]
    values = base + [b ^ sum(1 << int(k) for k in rng.choice(128, int(rng.integers(1, 6)), replace=False)) for b in base for _ in range(5)] + base[:3]
    got = {r.fingerprint: r.n_near for r in fingerprints.near_counts(spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string")).collect()}
    for v in set(values):
        assert got[f"{v:032x}"] == sum((v ^ w).bit_count() <= 3 for w in values) - 1


def test_fingerprint_edges(spark):
    assert fingerprints.document_fingerprints(spark.createDataFrame([], EMPTY)).count() == 0
    one = fingerprints.document_fingerprints(spark.createDataFrame([(1, "a b c d", "x", "y", 1)], EMPTY)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert fingerprints.document_fingerprints(odd).count() == 3


# --- 10 packing -----------------------------------------------------------------------------------------------


def check_pieces(q, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    total = 0
    for i, g in q.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    for _, g in q.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    return total


def test_packing_round_trip(docs, texts):
    q = run(packing.pack(docs))
    assert set(q.doc_id) == set(texts)
    total = check_pieces(q, texts)
    n = q.sequence_id.nunique()
    assert total / (2048 * n) > 0.93 and n <= total // 2048 + 2


def test_packing_in_small_groups(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    q = run(packing.pack(docs))
    assert set(q.doc_id) == set(texts)
    check_pieces(q, texts)


@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 300), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_patterns_place_every_token_once(histogram):
    rows, n = packing.slots(packing.pack_histogram(histogram))
    held = defaultdict(int)
    fill = defaultdict(int)
    for length, lo, hi, part, size, base, at in rows:
        assert part % packing.GRID == 0 and (part + size == length or size % packing.GRID == 0)
        held[length] += (hi - lo) * size
        for s in range(base, base + hi - lo):
            fill[s] += size
    assert held == {k: k * v for k, v in histogram.items()}
    assert len(fill) == n and max(fill.values()) <= 2048
    total = sum(fill.values())
    assert n * 2048 - total <= 64 * n + 2048


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksum_of_a_middle_part(x, y):
    assert packing.crc_after(zlib.crc32(x), zlib.crc32(x + y), len(y)) == zlib.crc32(y)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_rank_file_gives_the_tokenizers_ids(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = _CACHE.setdefault("t", Tokenizer.from_file(path("byte_bpe_50k.json")))
    assert packing.document_ids(text, packing.default_vocabulary()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


_CACHE: dict = {}


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\r\n" * 1_000_000, "ab" * 1_000_000, "word " * 9 + "\t" * 1_500_000 + "x " * 9])
def test_very_long_runs_and_words_give_the_tokenizers_ids(text):
    tokenizer = packing.whole_file(packing.default_vocabulary())
    assert packing.document_ids(text, packing.default_vocabulary()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    q = run(packing.pack(odd))
    assert len(q) == 4 and q.length.sum() == q.doc_tokens.sum() and q.sequence_id.nunique() == 1


# --- awkward tables, all operators ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(31)
    long = " ".join(f"w{x}" for x in rng.integers(0, 900, 40_000))
    rows = [(1, "x" * 1_500_000), (2, " " * 1_200_000), (3, long), (4, long + " end"), (5, "\n\t" * 10), (6, None), (7, ""), (None, "no id here"), (None, "no id here"), (8, "twice " * 30), (8, "twice " * 30), (9, "é日本 " * 40)]
    return rows, spark.createDataFrame([(*r, "en", "s", 1, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fingerprint int").repartition(3)


def test_awkward_rows_keep_their_places(awkward):
    rows, d = awkward
    ids = Counter(i for i, _ in rows)
    named = lambda df: Counter(None if i is None or i != i else int(i) for i in run(df.select("doc_id")).doc_id.astype(object))
    assert named(substrings.repeats_report(d)) == named(simhash.fingerprint_components(d)) == named(licenses.license_scan(d)) == ids
    assert named(lm.pseudo_likelihood(d)) == named(fingerprints.document_fingerprints(d)) == ids
    report = run(substrings.repeats_report(d)).dropna(subset="doc_id").set_index("doc_id")
    assert report.n_removed[4] == 40_000 and report.n_removed[[1, 2, 3, 5, 6, 7, 9]].sum() == 0 and (report.n_removed.loc[[8]] == 0).all()
    prints = run(simhash.fingerprint_components(d)).dropna(subset="doc_id").set_index("doc_id")
    assert prints.fingerprint[2] == prints.fingerprint[5] == prints.fingerprint[6] == "0" * 16 and prints.component_id[7] == 2
    assert int(prints.fingerprint[1], 16) == xxhash.xxh64_intdigest("x" * 1_500_000, 42)
    scores = run(lm.pseudo_likelihood(d)).dropna(subset="doc_id").set_index("doc_id")
    assert scores.n_tokens[1] == 1 and scores.n_tokens[3] == 40_000 and np.isfinite(scores.log_likelihood).all()


def test_awkward_rows_are_packed_whole(awkward):
    rows, d = awkward
    pieces = run(packing.pack(d))
    want = Counter()
    for i, t in rows:
        want[i] += len(packing.document_ids(t, packing.default_vocabulary()))
    got = pieces.assign(doc_id=[None if i is None or i != i else int(i) for i in pieces.doc_id.astype(object)])
    assert {i: got[got.doc_id == i].length.sum() if i is not None else got[got.doc_id.isna()].length.sum() for i in want} == dict(want)


def test_pages_without_ids_and_repeated_ones(spark):
    rows = [(None, "http://a.com/de/1")] * 3 + [(1, None)] * 2 + [(2, "x" * 100_000), (3, "http://" + "h" * 5_000 + "/" + "a/" * 3_000)]
    got = run(urls.judge(spark.createDataFrame(rows, "page_id long, url string")))
    assert len(got) == len(rows) and (got[got.page_id.isna()].verdict == "block").all() and got[got.page_id == 3].host.iloc[0] == "h" * 5_000
