"""Qualified seasons, too small groups, constants of one's own gender or the default one's."""

from pyspark.sql import functions as F

from tallyline.operators import derive, study
from tallyline.plans import ledger

SF = "/root/testdata/sf0.001"


def test_limits_by_role_and_format(spark):
    assert study.limits_of("bowling")["ODI"] == 300 and study.limits_of("batting")["T20"] == 60
    rows = spark.createDataFrame([("T20", "m", "p", 2000, h, "dot", n, 1.0) for h, n in ((0, 70.0), (1, 60.0))] + [("T20", "m", "q", 2000, h, "dot", 50.0, 1.0) for h in (0, 1)] + [("X", "m", "r", 2000, h, "dot", 900.0, 1.0) for h in (0, 1)], "fgroup string, gender string, player string, yr int, half int, metric string, n double, x double")
    assert {r["player"] for r in study.halves(rows, 1).collect()} == {"p", "q", "r"}
    assert {r["player"] for r in study.halves(rows, 1, study.limits_of("bowling")).collect()} == {"p"}


def test_small_groups_have_no_estimate(spark):
    bowling = ledger.tables(spark, SF)["bowling_innings"]
    every = study.stability(bowling, "bowling", 1).filter("r_half is not null").count()
    assert every and study.stability(bowling, "bowling", 1, fewest=10**6).filter("k is not null or tau2 is not null or r is not null").count() == 0
    report = study.report(bowling, "bowling", limits={"T20": 5.0}, fewest=2)
    assert {r[0] for r in report.select("fgroup").distinct().collect()} <= {"T20"}
    assert study.report(bowling, "bowling").count() == 0  # no season has 120 balls here


def test_constants_fall_back_to_the_default_gender(spark):
    innings = spark.createDataFrame([(1, "T20", "f"), (2, "T20", "m"), (3, "ODI", "f"), (4, "T20", None)], "id int, fgroup string, gender string")
    stable = spark.createDataFrame([("bowling", "T20", "m", "dot", 50.0), ("bowling", "T20", "f", "dot", None), ("bowling", "T20", "f", "runs", 7.0), ("batting", "T20", "m", "runs", 9.0)], "role string, fgroup string, gender string, metric string, k double")
    got = {r["id"]: (r["k_dot"], r["k_runs"]) for r in derive.attach_k(innings, stable, "bowling", "m").collect()}
    assert got == {1: (50.0, 7.0), 2: (50.0, None), 3: (None, None), 4: (50.0, None)}




def test_reliability_in_words(spark):
    d = spark.createDataFrame([(0.8,), (0.6,), (0.3,), (0.1,), (None,)], "x double").select(study.reliability_words(F.col("x")))
    assert [r[0] for r in d.collect()] == ["mostly skill", "more skill than luck", "more luck than skill", "mostly luck", "not to be told"]
