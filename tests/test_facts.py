"""Ranks, quadrants, digests that shrink, split seasons by hand."""

from pyspark.sql import functions as F

from tallyline.functions import scope
from tallyline.operators import insights


def table(spark, n=12, name="p"):
    return spark.createDataFrame([(f"{name}{k:02d}", float(k % 7)) for k in range(n)] + [("none", None)], "player string, v double")


def test_ranked_facts_by_hand(spark):
    f = insights.ranked_facts(table(spark), "player", "v").first()
    assert (f["n"], tuple(f["best"]), tuple(f["worst"]), f["spread"]) == (12, ("p06", 6.0), ("p07", 0.0), 6.0)
    assert [r["key"] for r in f["ranked"]] == ["p06", "p05", "p04", "p11", "p03", "p10", "p02", "p09"] and f["leader_share"] == 6.0 / 31
    low = insights.ranked_facts(table(spark), "player", "v", False, 0).first()
    assert [r["key"] for r in low["ranked"]] == ["p00", "p07", "p01"] and low["leader_share"] is None
    none = insights.ranked_facts(table(spark).limit(0), "player", "v").first()
    assert none is None or none["n"] == 0


def test_quadrants_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 8.0), ("c", 3.0, 1.0), ("d", 4.0, 2.0), ("e", 2.5, 5.0), ("f", None, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["quadrant"], r["place"]) for r in insights.quadrants(rows, "k", "x", "y").collect()}
    assert got == {"e": ("both", 1), "c": ("x only", 2), "d": ("x only", 1), "a": ("y only", 2), "b": ("y only", 1)}


def test_digests_shrink_and_count_what_is_left_out(spark):
    cards = {f"card {k}": (table(spark, 12, "p" if k < 2 else f"q{k}"), "player", "v", True) for k in range(3)}
    whole = insights.board_digest("board", cards)
    assert "in several cards: none, p00" in whole and "median" in whole
    shorter = insights.board_digest("board", cards, len(whole) - 1)
    assert len(shorter) < len(whole) and "card 2" in shorter
    assert "more left out" in insights.board_digest("board", cards, 80) and len(insights.board_digest("board", cards, 80)) < 110


def test_split_seasons_are_held_to_the_year_and_the_one_before(spark):
    rows = spark.createDataFrame([("2024", 2023), ("2023/24", 2024), ("2023/24", 2023), ("2024/25", 2024), ("2020/21", 2024), ("2024", 2024)], "season string, yr int")
    got = [tuple(r) for r in rows.filter(scope._season("2024")).collect()]
    assert got == [("2024", 2023), ("2023/24", 2024), ("2024/25", 2024), ("2024", 2024)]
    assert rows.filter(scope._season("2023/24")).agg(F.count("*")).first()[0] == 2
