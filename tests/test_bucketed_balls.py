"""The stored balls are bucketed by match, and the feature matrix leaves them where they are."""

import re

from pyspark.sql import functions as F

from tallyline.operators import features
from tallyline.plans import ledger, model_queries
from tallyline.sources.stored import Stored

SF = "/root/testdata/sf0.001"


def _moved(df) -> list[str]:
    """What each exchange of a plan takes in."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)


def test_the_matrix_leaves_the_balls_with_their_match(spark):
    moved = _moved(model_queries._matrix(spark, SF))
    assert moved and not any("seq#" in columns for columns in moved)


def test_a_bucketed_table_groups_without_an_exchange(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    make = {"a": lambda _: spark.range(100).select((F.col("id") % 7).alias("m"), "id")}
    kept = Stored(spark, str(tmp_path), make, [source], buckets={"a": lambda _: ("m", 3)})
    sums = kept["a"].groupBy("m").agg(F.sum("id").alias("s"))
    assert not _moved(sums) and len(_moved(kept.flat("a").groupBy("m").count())) == 1
    assert {r.m: r.s for r in sums.collect()} == {m: sum(range(m, 100, 7)) for m in range(7)}
    again = Stored(spark, str(tmp_path), make, [source], buckets={"a": lambda _: ("m", 3)})
    assert again["a"].inputFiles() == kept["a"].inputFiles()


def test_the_matrix_is_the_same_without_buckets(spark):
    key = ["match_id", "innings", "seq"]
    balls = ledger.tables(spark, SF).flat("balls")
    # An unknown striker has no form, an unknown side no lead.
    balls = balls.withColumn("batter", F.when(F.col("seq") != 2, F.col("batter"))).withColumn("team", F.when(F.col("seq") != 3, F.col("team")))
    got = features.win_matrix(balls, *model_queries._histories(balls), female=model_queries.FEMALE)
    rows = got.select(*key, "striker_form", "rating_lead").collect()
    assert len(rows) == len({tuple(r[:3]) for r in rows}) == balls.filter("fgroup in ('T20', 'ODI')").count()
    assert all((r.striker_form is None) == (r.seq == 2) and (r.rating_lead is None) == (r.seq == 3) for r in rows)
