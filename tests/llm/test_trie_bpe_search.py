"""The prefix trie, byte-level BPE and ranked search against brute force and the tokenizers library, and
on awkward tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import bpe, ranked, trie

TURNS = "conv_id long, turn long, role string, text string, depth int, one string, place long, block string"
DOCS = "doc_id long, text string, ids string, n string, terms int, score double"


def frame(spark, rows, schema, extra):
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)


# --- 11 prefix trie -------------------------------------------------------------------------------


def trie_by_hand(turns):
    own = defaultdict(list)
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        own[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in children[node])
    return {
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    }


def trie_of(spark, turns):
    rows = trie.prefix_trie(frame(spark, turns, TURNS, (1, "x", 9, "y"))).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def random_turns(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        if rng.random() < 0.9:
            out += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é", "bb", None])) for t in range(rng.randrange(1, longest))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed):
    turns = random_turns(seed) + [(-3, 0, "user", "a"), (-3, 1, "user", "a"), (-5, 0, None, "a"), (None, 0, "user", "lost")]
    assert trie_of(spark, turns) == trie_by_hand(turns)


def test_trie_of_long_hot_and_repeated_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    turns = [(0, t, "user", f"t{t % 7}") for t in range(150)]
    turns += [(c, t, "user", f"t{t % 7}") for c in (1, 2, 6, 7) for t in range(150 - 30 * (c % 3))]
    turns += [(c, t, "user", "same") for c in range(20, 90) for t in range(10)]
    turns += [(5, 0, "user", "tied")] * 40 + [(5, 0, "assistant", "tied")] * 3
    assert trie_of(spark, turns) == trie_by_hand(turns)


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie_of(spark, []) == set()
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert trie_of(spark, [(lone, 0, "user", "only")]) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_light_edges_halve_the_members(spark):
    turns = [(c, t, "user", str(c >> t & 1)) for c in range(0, 640, 5) for t in range(7)]
    conversations, own = trie.rebuilt(trie.numbered(frame(spark, turns, TURNS, (1, "x", 9, "y"))))
    rows = trie.prefixes(conversations, own)
    nodes = trie.nodes_of(rows)
    paths = trie.path_arrays(rows, nodes)
    assert paths.count() == nodes.count() == paths.select("conv_id", "depth").distinct().count()
    assert paths.agg({"level": "max"}).first()[0] <= math.log2(128)


# --- 12 byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


ODD = ["a", "b", " ", "  ", "\n", "'s", "'", "the", "ing", "<|endoftext|>", "<|endof", "é", "日", "Ᲊ", "\x1c", "9", "²", "aaaa", "́", "🙂", "\x85", "​", "　", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join))
def test_ids_and_texts_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    global _LIBRARY
    _LIBRARY = globals().get("_LIBRARY") or Tokenizer.from_file(bpe.default_vocabulary())
    ids = bpe.codec(bpe.default_vocabulary()).encode(text)
    assert ids.tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(bpe.default_vocabulary()).decode(ids) == text


def test_any_ids_are_decoded_as_by_the_library(library):
    own, rng = bpe.codec(bpe.default_vocabulary()), np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, 50_300, 9)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_each_prefix_has_one_last_token():
    own = bpe.codec(bpe.default_vocabulary())
    for word in (b"unbelievably", b"aaaaaaaaaaaaa", "žluťoučký".encode(), b"      "):
        last = {}
        for end, token in own.matches.iter(word.decode("latin-1")):
            before = end - own.size[token]
            if before < 0 or own.compatible(last[before], token):
                assert last.setdefault(end, token) == token
        assert len(last) == len(word)


def test_words_of_any_length_and_small_memories(spark, library, monkeypatch):
    own = bpe.Codec(bpe.default_vocabulary())
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 7)
    for text in ("ab" * 60_000, " " * 50_000 + "x", "é" * 30_000, "one two three four five six seven eight nine ten one two"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_digests(spark, library):
    texts = [None, "", "plain words", "a <|endoftext|> b", "x" * 30_000, "Ünï 日本 " * 50, "plain words"]
    docs = frame(spark, [(k if k != 2 else None, t) for k, t in enumerate(texts)], DOCS, ("taken", "n", 3, 0.5))
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == sorted(((k if k != 2 else None, len(i), sha(",".join(map(str, i))), sha(t or "")) for k, (t, i) in enumerate(zip(texts, ids))), key=str)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_columns_stay_and_clashes_are_refused(spark):
    docs = frame(spark, [(1, "some words")], DOCS, ("kept", "n", 3, 0.5))
    with pytest.raises(ValueError):
        bpe.encode(docs)
    row = bpe.decode(bpe.encode(docs, ids="tokens"), ids="tokens").first()
    assert (row["ids"], row["score"], row["decoded"]) == ("kept", 0.5, "some words")
    odd = spark.createDataFrame([(1, None), (2, [5, None, -4, 99_999])], "id int, ids array<int>")
    assert {r["id"]: r["decoded"] for r in bpe.decode(odd).collect()} == {1: "", 2: bpe.codec(bpe.default_vocabulary()).decode(np.array([5]))}


# --- 13 ranked search ---------------------------------------------------------------------------------


def terms_by_hand(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def search_by_hand(docs, queries, k=10):
    held = [(d, Counter(terms_by_hand(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for item, text in queries:
        asked[item].update(terms_by_hand(text))
    out = set()
    for item, q in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in q}
        scored = [(sum(times * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * size * n // total))) for t, times in q.items() if c[t]), d) for d, c, size in held]
        best = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out |= {(item, r + 1, d, s) for r, (s, d) in enumerate(best)}
    return out


def search_of(spark, docs, queries, **more):
    rows = ranked.search(frame(spark, docs, DOCS, ("x", "n", 3, 0.5)), spark.createDataFrame(queries, "item_id long, text string"), **more).collect()
    return {tuple(r) for r in rows}


def random_text(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "Éa", "é", "x1", "日本", *map(str, range(30))]) + rng.choice(["", ",", "\n", "\x00"]) for _ in range(n))


@pytest.mark.parametrize("shard, read, block", [(8192, 4, 1 << 18), (7, 1, 3)])
def test_search_is_that_of_brute_force(spark, monkeypatch, shard, read, block):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "FIRST_READ", read)
    rng = random.Random(4)
    docs = [(k, random_text(rng, rng.randrange(0, 40))) for k in range(120)] + [(500 + k, "alpha beta") for k in range(30)]
    docs += [(7, "repeated id x1 x1"), (None, "null id x1"), (8, None), (9, ""), (10, " ,.;"), (600, random_text(rng, 20_000))]
    queries = [(k, random_text(rng, rng.randrange(1, 12))) for k in range(12)] + [(20, None), (21, "nowhere"), (22, "alpha beta"), (23, "ALPHA alpha"), (3, "x1 again"), (None, "é 日本")]
    assert search_of(spark, docs, queries, block_terms=block) == search_by_hand(docs, queries)


def test_search_of_nothing(spark):
    assert search_of(spark, [], [(1, "a")]) == search_of(spark, [(1, "a")], []) == set()


def test_the_threshold_stops_before_the_lists_end(monkeypatch):
    looked = []
    scores = ranked.Shard.scores
    monkeypatch.setattr(ranked.Shard, "scores", lambda self, docs, weight: looked.extend(docs) or scores(self, docs, weight))
    n = 4000
    count = np.where(np.arange(n) < 20, 50, 1).astype(np.int64)
    shard = ranked.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), np.ones(n, np.int64), np.zeros(n, np.int32), count, 1)
    score, ids, _ = shard.best(np.array([0]), np.array([3]), 10, ranked.NONE)
    assert ids.tolist() == list(range(10)) and len(set(score)) == 1 and len(looked) < 100
