"""The balls are passed once, where they lie, by what sums them up over players and years."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyline.operators import derive, evaluate, models, study
from tallyline.plans import ledger, model_queries, view_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _moved(df) -> list[str]:
    """What each exchange of a plan takes in."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", _plan(df))


def _ball_scans(df) -> int:
    """How many scans of a plan read strikers."""
    return sum("batter#" in columns for columns in re.findall(r"\(\d+\) Scan parquet.*\nOutput[^:]*: (.*)", _plan(df)))


def test_era_range_passes_the_balls_once_where_they_lie(spark):
    got = entry.queries()["era_range"](spark, SF)
    assert _ball_scans(got) == 1
    assert _moved(got) and not any("match_id#" in columns for columns in _moved(got))


def test_an_era_needs_a_year_of_its_own(spark):
    rows = [("m", "T20", 1, 2000, 10, 1), ("m", "T20", 1, 2002, 30, 0), ("m", "T20", 1, 2005, 50, 1), (None, "T20", 1, 2003, 7, 0), ("m", "T20", 12, 2000, 99, 1), ("m", "T20", 1, None, 80, 1)]
    got = derive.era_baseline(spark.createDataFrame(rows, "gender string, fgroup string, position int, yr int, runs int, out int"))
    assert {(r.gender, r.position, r.yr): (r.era_runs, r.era_outs) for r in got.collect()} == {("m", 1, 2000): (20.0, 0.5), ("m", 1, 2002): (20.0, 0.5), ("m", 1, 2005): (50.0, 1.0), (None, 1, 2003): (7.0, 0.0)}


def test_form_moves_innings_not_balls(spark):
    moved = _moved(entry.queries()["form_all_kinds"](spark, SF))
    assert sum("match_id#" in columns for columns in moved) == 1 and not any("seq#" in columns for columns in moved)


def test_pairs_of_years_need_no_second_copy(spark):
    rows = [("a", 2000, 4.0, 0.5), ("a", 2001, 12.0, 0.25), ("a", 2003, 9.0, 0.1), ("a", 2004, None, 0.2), (None, 2000, 5.0, 0.5), (None, 2001, 5.0, 0.5), ("b", None, 5.0, 0.5), ("b", 2000, 5.0, 0.5)]
    years = spark.createDataFrame(rows, "player string, yr int, n double, rate double").withColumns({"fgroup": F.lit("f"), "gender": F.lit("g"), "metric": F.lit("m")})
    got = study.next_year(years)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.player, r.yr, r.n, r.n2, r.rate, r.rate2, r.w) for r in got.collect()) == [("a", 2000, 4.0, 12.0, 0.5, 0.25, 3.0), ("a", 2003, 9.0, None, 0.1, 0.2, None)]


@pytest.mark.parametrize("name", ["study_prediction", "study_predictors", "study_gain"])
def test_lines_and_errors_read_written_pairs(spark, name):
    files = entry.queries()[name](spark, SF).inputFiles()
    assert files and all("/pairs-" in f for f in files)


def test_the_study_leaves_the_balls_where_they_lie(spark):
    moved = _moved(study.seasons(view_queries._bowl(spark, SF), "bowling"))
    assert moved and not any("match_id#" in columns for columns in moved)


@pytest.mark.parametrize("name", ["metrics_batting_context", "metrics_batting_role", "metrics_bowling_context"])
def test_a_family_of_metrics_leaves_the_balls_where_they_lie(spark, name):
    moved = _moved(entry.queries()[name](spark, SF))
    assert moved and not any("match_id#" in columns for columns in moved)


def test_a_forecast_makes_only_what_its_rule_reads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(model_queries, "cut", lambda rows, *how: written.append(rows) or rows)
    model_queries._forecasts(spark, SF)
    moved = _moved(written[0])
    # The matches' grounds move, and nothing of strikers, sides or balls.
    assert moved and not any(re.search(r"\b(batter|player|team|pool|seq|outs)#", columns) for columns in moved)
    assert _plan(written[0]).count("SortMergeJoin") + _plan(written[0]).count("ShuffledHashJoin") <= 1


def test_swings_and_scores_of_forecasts_leave_the_balls_with_their_match(spark):
    forecasts = model_queries._forecasts(spark, SF)
    assert not any("match_id#" in columns for columns in _moved(evaluate.swing(forecasts)))
    assert len(_moved(evaluate.quiet_swings(forecasts))) == 1  # the mean par
    # Only one-row sums, and no distinct forecast, cross an exchange.
    moved = _moved(entry.queries()["par_forecast"](spark, SF))
    assert moved and not any(re.search(r"\b(p|v|band|b)#", columns) for columns in moved)


def test_accuracy_is_the_evaluation_without_its_ranks(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.4, 1), (0.4, 0)], "p double, y int")
    a, e = models.accuracy(rows).first(), models.evaluation(rows).first()
    assert (a.n, a.log_loss, a.brier, a.ones) == (e.n, e.log_loss, e.brier, 2)


def test_forms_come_to_the_balls_of_a_match(spark):
    got = entry.queries()["next_ball_form"](spark, SF)
    assert not any("lineitem" in f for f in got.inputFiles())
    moved = _moved(got)
    # The bowlers' sums of a match go out and their forms come back; no ball moves, and no striker's form is made.
    assert sum("match_id#" in columns for columns in moved) == 2 and not any(re.search(r"\b(seq|faced|batter)#", columns) for columns in moved)


def test_forms_by_hand(spark):
    innings = spark.createDataFrame([("a", "g", "2001", 1, 10, 20), ("a", "g", "2001", 1, 2, 4), ("a", "g", "2002", 2, 30, 10), ("b", "g", "2002", 2, 6, 6), (None, "g", "2001", 2, 9, 9), ("a", None, "2001", 2, 9, 9)], "player string, gender string, date string, match_id int, runs int, balls int")
    balls = [(1, 1, "a", "b", "g"), (2, 1, "a", "b", "g"), (2, 2, "a", "a", "g"), (2, 3, None, None, "g"), (2, 4, "a", "a", None), (3, 1, "a", "b", "g"), (None, 1, "a", "b", "g")]
    rows = spark.createDataFrame(balls, "match_id int, seq int, batter string, bowler string, gender string")
    mean = 66 / 58
    first, after = mean, (12 + 120 * mean) / (24 + 120)
    want = {(1, 1): (first, None), (2, 1): (after, first), (2, 2): (after, after), (2, 3): (None, None), (2, 4): (None, None), (3, 1): (None, None), (None, 1): (None, None)}
    for shares in (None, 3):
        got = models.next_ball_form(rows, innings, innings, shares).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.batter_form, r.bowler_form) == tuple(x if x is None else pytest.approx(x) for x in want[r.match_id, r.seq])


def test_lines_meet_their_parts_while_they_are_narrow(spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as with too many parts
    try:
        lines = [columns for columns in _moved(ledger._lines(spark, SF)) if "l_partkey#" in columns]
    finally:
        spark.conf.set(limit, before)
    assert sum("o_orderdate#" not in columns for columns in lines) == 2  # by part, then by order
