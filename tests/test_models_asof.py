"""As-of joins, the feature matrix, rolled metrics, facets in one scan and the evaluation of forecasts by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions.metrics import REGISTRY
from tallyline.functions.scope import build
from tallyline.operators import engine, evaluate, features, models
from tallyline.operators.asof import asof_join
from tallyline.plans import ledger

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("banded", [False, True])
def test_asof_join_is_that_of_brute_force(spark, inclusive, banded):
    rng = random.Random(3)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([*range(40), None])) for k in range(120)] + [(7, "a", 5)] * 3
    right = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([*range(40), None]), k, rng.choice([None, k * 1.5])) for k in range(90)]
    got = asof_join(
        spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, n int, v double"), ["k"], "t", ["n", "v"], inclusive=inclusive, ties=["n"], band=F.floor(F.col("t") / 7) if banded else None
    )
    want = []
    for i, k, t in left:
        before = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t or inclusive and r[1] == t)]
        last = max(before, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((i, k, t, last[2], last[3]))
    assert got.columns == ["id", "k", "t", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_asof_join_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, t int, v int")
    assert asof_join(left, right, ["k"], "t", ["v"]).collect() == [(1, 2, None)]
    assert asof_join(left.limit(0), left.withColumn("v", F.lit(1)), ["k"], "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left.withColumn("v", F.lit(0)), right, ["k"], "t", ["v"])


def test_rating_history_leads_to_the_ratings_before(spark):
    rng, teams = random.Random(1), "ABCD"
    rows = []
    for k in range(60):
        a, b = rng.sample(teams, 2)
        rows.append(("P", f"2020-01-{k // 3 + 1:02d}", k, a, b, rng.choice([a, b, None]), False))
    matches = spark.createDataFrame(rows, "pool string, date string, match_id long, team1 string, team2 string, winner string, tied boolean")
    before = {r["match_id"]: r for r in models.elo(matches).collect()}
    history = features.rating_history(matches)
    sides = matches.select("pool", "match_id", "date", F.explode(F.array("team1", "team2")).alias("team"))
    at = "date || lpad(match_id, 5, '0')"
    got = asof_join(sides.withColumn("at", F.expr(at)), history.withColumn("at", F.expr(at)).drop("date", "match_id"), ["pool", "team"], "at", ["rating"]).collect()
    by_match = {r[2]: r for r in rows}
    for r in got:
        own = before[r["match_id"]][2 if r["team"] == by_match[r["match_id"]][3] else 3]
        assert (r["rating"] or models.ELO_START) == pytest.approx(own)


def test_the_matrix_has_each_ball_once(spark):
    from tallyline.plans import model_queries

    matrix = model_queries._matrix(spark, SF)
    balls = ledger.tables(spark, SF)["balls"].filter("fgroup in ('T20', 'ODI')")
    assert matrix.count() == balls.count() == matrix.select("match_id", "innings", "seq").distinct().count()


@pytest.mark.parametrize("role", ["batting", "bowling"])
def test_every_metric_rolls(spark, role):
    innings = ledger.tables(spark, SF)[f"{role}_innings"].filter(F.col("player").isin("s1", "s2", "Brand#11", "Brand#22"))
    names = list(REGISTRY[role])
    rolled = engine.rolling_metrics(innings, role, names, 6).collect()
    last = {}
    for r in rolled:
        last.setdefault(r["player"], []).append(r)
    numbered = innings.withColumn("n", F.row_number().over(engine.Window.partitionBy("player").orderBy(*engine.CHRONOLOGICAL)))
    for n in (1, 4, 9):
        groups = numbered.filter(F.col("n").between(n - 5, n)).groupBy("player").agg(F.max("n").alias("n"), *(REGISTRY[role][m].column() for m in names)).filter(F.col("n") == n).collect()
        assert groups
        for g in groups:
            own = last[g["player"]]
            row = next(r for r in own if r["n"] == n)
            for m in names:
                assert row[m] == g[m] if g[m] is None or isinstance(g[m], str) else row[m] == pytest.approx(g[m]), m


def test_facets_read_the_table_once_and_agree_with_single_filters(spark, capsys):
    innings = ledger.tables(spark, SF)["bowling_innings"]
    scope = build("bowling", season="1998", competition="ASIA", gender="BUILDING")
    got = {tuple(r) for r in engine.facets(innings, scope).collect()}
    want = set()
    for name, (column, most) in engine.FACETS.items():
        rows = scope.apply(innings, skip=name).filter(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("match_id").alias("n")).orderBy(F.desc("n"), column).limit(most)
        want |= {(name, r[0], r[1]) for r in rows.collect()}
    assert got == want
    engine.facets(innings, scope).explain("formatted")
    assert capsys.readouterr().out.count("Location:") == 1


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.random(500), rng.random(300) / 1e6, np.full(200, 0.25), [1.0]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert evaluate.quantile(rows, "v", q).first()[0] == pytest.approx(np.quantile(values, q))
    assert evaluate.quantile(rows.limit(0), "v", q).first()[0] is None


def test_scores_of_probability_vectors(spark):
    rng = np.random.default_rng(5)
    p, y = rng.dirichlet(np.ones(7), 50), rng.integers(0, 7, 50)
    p[0] = [1, 0, 0, 0, 0, 0, 0]
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(p, y)] + [(None, 1), ([0.1] * 7, None)], "p array<double>, y int")
    got = evaluate.class_scores(rows).first()
    clipped = np.clip(p, 1e-6, 1)
    clipped /= clipped.sum(1, keepdims=True)
    runs = np.array(evaluate.RUNS)
    out = y == 6
    assert got["n"] == 50 and got["log_loss"] == pytest.approx(-np.log(clipped[np.arange(50), y]).mean())
    assert got["out_log_loss"] == pytest.approx(-np.where(out, np.log(clipped[:, 6]), np.log1p(-clipped[:, 6])).mean())
    assert got["out_brier"] == pytest.approx(((clipped[:, 6] - out) ** 2).mean()) and got["runs_rmse"] == pytest.approx(math.sqrt(((clipped @ runs - runs[y]) ** 2).mean()))


def test_par_rule_by_hand(spark):
    rows = spark.createDataFrame([(1, 60, 6, 80, None, None, None, 160.0, 20), (2, 30, 2, 100, 150, 50, 10.0, 160.0, 20), (1, 60, 6, 80, None, None, None, 0.0, 20)], "innings int, balls_left int, wickets_left int, score int, target int, needed int, required double, par double, overs int")
    got = [r[0] for r in rows.select(evaluate.par_forecast(150.0)).collect()]
    setting = (80 + 8.0 * 60 / 6 * math.sqrt(0.6) - 160) / (0.12 * 160)
    chasing = (100 * 6 / 90 * math.sqrt(0.2) + 1 - 10.0) / 1.5
    assert got[:2] == pytest.approx([1 / (1 + math.exp(-setting)), 1 / (1 + math.exp(-chasing))]) and got[2] is None
