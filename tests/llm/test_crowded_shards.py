"""Near-duplicates among many documents that share a line and are not alike."""

import numpy as np
import pytest

from tallyline.llm import simhash
from tests.llm.test_llm_operators import closed

LINE = " ".join(f"footer{k}" for k in range(60))


def corpus(n, copies):
    """n documents of random words under one common line, every tenth with a near copy, and a group of copies."""
    rng = np.random.default_rng(31)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 50_000, k)]
    rows = {}
    for i in range(n):
        body = word(int(rng.integers(40, 90)))
        rows[i] = " ".join([*body, LINE])
        if i % 10 == 0:
            body[len(body) // 2] = "changed"
            rows[10**6 + i] = " ".join([*body, LINE])
    body = word(80)
    for k in range(copies):
        rows[2 * 10**6 + k] = " ".join([*body[:40], f"copy{k}", *body[40:], LINE])
    rows[3 * 10**6], rows[3 * 10**6 + 1] = LINE, LINE + " end"
    return rows


def dealt(monkeypatch):
    """Row counts that the shards deal to tasks, call by call."""
    seen, plain = [], simhash.grouped

    def counting(rows, key, values, f, schema):
        seen.append(rows.count())
        return plain(rows, key, values, f, schema)

    monkeypatch.setattr(simhash, "grouped", counting)
    return seen


@pytest.mark.parametrize("chunk", [8, 32])
def test_crowded_shards_find_what_brute_force_finds(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = corpus(200, 40)
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows.items()}
    pairs = [(a, b) for a in rows for b in rows if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = closed(pairs, rows)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if want[i] == i)


def test_rows_dealt_grow_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 32)
    totals = []
    for n in (200, 800):
        seen = dealt(monkeypatch)
        docs = spark.createDataFrame(list(corpus(n, 0).items()), "doc_id long, text string").repartition(4)
        simhash.near_links(docs)
        totals.append(sum(seen))
        monkeypatch.undo()
        monkeypatch.setattr(simhash, "CHUNK", 32)
    assert totals[1] < 5 * totals[0]
