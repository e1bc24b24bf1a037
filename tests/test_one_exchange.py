"""The innings tables move the balls once, and make only what is asked for."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import derive
from tallyline.plans import ledger

SF = "/root/testdata/sf0.001"


def test_an_innings_table_joins_nothing_that_is_not_asked_for(spark):
    t = ledger.tables(spark, SF)
    full = derive.expected(t["balls"], derive.expectation(t["balls"]))
    batting = derive.with_era(derive.match_context(derive.batting_innings(full), "batting"))
    for rows in (batting, derive.bowling_innings(full), derive.batting_phases(full)):
        plan = rows.groupBy("player").agg(F.sum("runs"))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


@pytest.mark.parametrize("name", ["batting_innings", "bowling_innings", "batting_phase", "bowling_phase"])
def test_the_balls_cross_one_exchange(spark, name):
    plan = ledger.tables(spark, SF)[name].groupBy("match_id", "player").agg(F.sum("runs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "RangePartitioning" not in plan


def test_key_moments_are_picked_without_a_call_for_each_match(spark):
    from tallyline.operators import models

    rows = spark.createDataFrame([(1, 1, 3, 0.2), (1, 3, 4, -0.4), (1, 5, 5, 0.2), (1, 6, 6, 0.01), (2, 1, 1, float("nan"))], "match_id long, start long, stop long, swing double")
    got = models.key_moments(rows)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 4, -0.4), (1, 5, 5, 0.2)]


def test_the_forecast_matrix_is_planned_once(spark):
    from tallyline.plans import model_queries

    plan = model_queries._forecasts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftOuter" not in plan


@pytest.mark.parametrize("name", ["audit_frozen", "audit_conservation"])
def test_audits_read_the_stored_balls(spark, name):
    import __spark_entry__ as entry

    files = entry.queries()[name](spark, SF).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_the_balls_are_dealt_in_bounded_shares(spark, monkeypatch):
    monkeypatch.setattr(ledger, "LEAST_SHARE", 1000)
    rows = spark.range(0, 5000, 1, 2)
    assert ledger.shares(rows) == min(5, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(ledger, "SHARE", 500)
    assert ledger.shares(rows) == 10 and ledger.shares(rows.limit(0)) == 2


def test_the_state_is_sorted_on_narrow_lines(spark):
    lines = ledger.states(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first_window = next(at for at, line in enumerate(lines) if "Window" in line)
    assert any("Join" in line for line in lines[:first_window])  # names are looked up after the windows
