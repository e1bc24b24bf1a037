"""Components, close names, competitions in their eras, the ladder of grounds and replay bundles by hand."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import groups, replay
from tallyline.plans import ledger

SF = "/root/testdata/sf0.001"


def test_components_are_those_of_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)] + [(5, None), (None, None), (9, 9)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert groups.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_close_names_are_those_of_brute_force(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(250)] + ["kohli", "malinga", "ab", "axb", "aaaaaa", "aaaa"]
    asked = ["".join(c for c in n if rng.random() > 0.15) + rng.choice(["", "x", "a"]) for n in rng.sample(names, 60)] + ["kohly", "malingga", "ab", "aaaaa", "", None]
    got = {(r["request"], r["name"]): r["ratio"] for r in groups.close_names(spark.createDataFrame([(a,) for a in asked], "request string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {(a, n): difflib.SequenceMatcher(None, a, n, False).ratio() for a in set(asked) if a for n in set(names) if a != n}
    assert got == {k: v for k, v in want.items() if v >= 0.8}
    with pytest.raises(ValueError):
        groups.close_names(spark.createDataFrame([], "request string"), spark.createDataFrame([], "name string"), 0.5)


def test_competitions_in_all_their_eras(spark):
    events = spark.createDataFrame([("NatWest Blast", 5), ("Vitality Blast", 9), ("Vitality Blast Men", 2), ("Other Cup", 9), ("other cup", 1), (None, 3)], "event string, matches long")
    aliases = spark.createDataFrame([("blast", "NatWest Blast"), ("blast", "Vitality Blast"), ("t20 blast", "Vitality Blast"), ("t20 blast", "Vitality Blast Men")], "alias string, event string")
    got = {r["event"]: (r["competition"], r["events"], r["matches"]) for r in groups.competition_groups(events, aliases).collect()}
    blast = ("Vitality Blast", ["NatWest Blast", "Vitality Blast", "Vitality Blast Men"], 16)
    cup = ("Other Cup", ["Other Cup", "other cup"], 10)
    assert got == {"NatWest Blast": blast, "Vitality Blast": blast, "Vitality Blast Men": blast, "Other Cup": cup, "other cup": cup}


def test_the_ladder_of_grounds(spark):
    venues = spark.createDataFrame([
        ("Eden Gardens", None, 5), ("Eden Gardens, Kolkata", "Calcutta", 50), ("Lord's, London", "London", 80), ("Lords, St David's", "St David's", 2), ("Lords", None, 1),
        ("M.Chinnaswamy Stadium", "Bangalore", 30), ("M Chinnaswamy Stadium, Bengaluru", "Bengaluru", 20), ("City Oval", "Kolkata", 4), ("Old Oval", "Perth", 10), ("Big Oval", "Perth", 9), ("Kotla", "Delhi", 7), ("Jaitley", "Delhi", 9), (None, "x", 1),
    ], "venue string, city string, matches long")
    found = groups.grounds(venues, {"bangalore": "bengaluru", "calcutta": "kolkata"})
    asked = ["eden gardens", "Lords", "chinnaswamy", "oval", "kolkata", "Calcutta Ovl", "kotla", "eden gardns", "nowhere", "", None]
    got = {r["request"]: (r["how"], r["venues"], r["candidates"]) for r in groups.resolve_venues(found, spark.createDataFrame([(a,) for a in asked], "request string"), {"kotla": "kotla|jaitley"}).collect()}
    assert got["eden gardens"] == ("name", ["Eden Gardens", "Eden Gardens, Kolkata"], None)
    assert got["Lords"] == ("name", ["Lord's, London", "Lords"], None)
    assert got["chinnaswamy"] == ("words", ["M Chinnaswamy Stadium, Bengaluru", "M.Chinnaswamy Stadium"], None)
    assert got["oval"] == ("words", None, ["old oval", "big oval", "city oval"])
    assert got["kolkata"] == ("city", ["City Oval", "Eden Gardens, Kolkata"], None)
    assert got["kotla"] == ("name", ["Jaitley", "Kotla"], None)
    assert got["eden gardns"] == ("close", None, ["eden gardens"])
    assert got["nowhere"] == got[""] == got["Calcutta Ovl"] == (None, None, None) and None not in got


def test_result_words(spark):
    rows = [("Oaks", None, None, 5, None), ("Oaks", None, "D/L", None, 3), (None, "no result", None, None, None), ("Elms", "tie", None, None, None), (None, "tie", None, None, None), (None, None, None, None, None), ("Oaks", None, None, 0, None)]
    d = spark.createDataFrame(rows, "winner string, result string, method string, win_by_runs int, win_by_wickets int")
    assert [r[0] for r in d.select(replay.result_words()).collect()] == ["Oaks won by 5 runs", "Oaks won by 3 wickets (DLS)", "No result", "Tied (Elms won the super over)", "Tied", "No result", "Oaks won"]


def test_bundles_are_whole_and_in_order(spark, capsys):
    from tallyline.plans import replay_queries

    found = replay_queries.bundled(spark, SF)
    balls = ledger.tables(spark, SF)["balls"].filter("fgroup in ('T20', 'ODI')")
    rows = found.select("match_id", F.size("balls").alias("n"), "balls.seq", "balls.innings", "innings").collect()
    assert sum(r["n"] for r in rows) == balls.count() and len({r["match_id"] for r in rows}) == len(rows)
    assert all(list(zip(r["innings"] and r[3] or [], r["seq"])) == sorted(zip(r[3], r["seq"])) for r in rows)
