"""How good forecasts are: par heuristic, swings on quiet balls, scores of probability vectors, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes of a ball and what each brings the striker: fixed values.
CLASSES = ("0", "1", "2", "3", "4", "6", "out")
RUNS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 0.0)
#: Bands of values from 0 to 1 in which a quantile is looked for.
QUANTILE_BANDS = 10_000


def par_forecast(mean_par: float | Column) -> Column:
    """The batting side's chance by a plain rule over the feature matrix: setting, the projected total
    against par (mean_par where it is not known); chasing, the required rate against the rate so far. Null for a par of 0."""
    par = F.coalesce(F.col("par"), F.lit(mean_par) if isinstance(mean_par, int | float) else mean_par)
    left, bowled = F.greatest(F.col("balls_left"), F.lit(1)), F.greatest(F.col("overs") * 6 - F.col("balls_left"), F.lit(6))
    # The rule's constants.
    in_hand = F.sqrt(F.least(F.greatest(F.col("wickets_left") / 10, F.lit(0.1)), F.lit(1.0)))
    scored = F.when(F.col("innings") == 1, F.col("score")).otherwise(F.coalesce(F.col("target") - F.col("needed"), F.lit(0)))
    rate = 6 * scored / bowled
    setting = (F.col("score") + rate * in_hand * left / 6 - par) / F.nullif(0.12 * par, F.lit(0.0))
    chasing = (rate * in_hand + 1 - F.coalesce("required", F.lit(0.0))) / 1.5
    odds = F.when(F.col("innings") == 1, setting).otherwise(chasing)
    return F.when(odds.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0)))))


def quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the q-quantile of values from 0 to 1, linear between its neighbours, exact at any size.

    Counts by band (a bounded table that adds up in any order) tell in which bands the two neighbours
    lie; only the distinct values of these are then counted. Null values have no say."""
    rows = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null").withColumn("band", F.least(F.floor(F.col("v") * QUANTILE_BANDS), F.lit(QUANTILE_BANDS - 1)))
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("band").agg(F.count("*").alias("m"))
    place = (F.sum("m").over(Window.partitionBy()) - 1) * q
    bands = bands.select("band", "m", F.coalesce(F.sum("m").over(before("band")), F.lit(0)).alias("below"), place.alias("place"))  # at most QUANTILE_BANDS rows
    ranks = F.array(F.floor("place"), F.ceil("place"))
    held = bands.filter(F.exists(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("m"))))
    values = rows.join(F.broadcast(held), "band").groupBy("band", "below", "place", "v").agg(F.count("*").alias("m"))
    inside = F.coalesce(F.sum("m").over(Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("first", F.col("below") + inside)
    at = lambda rank: F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("m")), F.col("v")))
    ends = values.agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    return ends.select((F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias(value))


def quiet_swings(scored: DataFrame, p: str = "p") -> DataFrame:
    """match_id, innings, seq, swing: how far the forecast moved on each ball without a wicket (outs) or a
    boundary (four, six), from the ball before it in the innings."""
    order = Window.partitionBy("match_id", "innings").orderBy("seq")
    moved = scored.withColumn("swing", F.abs(F.col(p) - F.lag(p).over(order)))
    return moved.filter((F.col("outs") == 0) & ~F.col("four") & ~F.col("six") & F.col("swing").isNotNull()).select("match_id", "innings", "seq", "swing")


def swing(scored: DataFrame, p: str = "p", q: float = 0.99) -> DataFrame:
    """One row: n, mean and q-quantile (`top`) of the swings on quiet balls."""
    moved = quiet_swings(scored, p)
    return moved.agg(F.count("*").alias("n"), F.avg("swing").alias("mean")).crossJoin(F.broadcast(quantile(moved, "swing", q).withColumnRenamed("swing", "top")))


def outcome_class(outs: str = "outs", runs: str = "runs_batter") -> Column:
    """The place of a ball's outcome in CLASSES; fives, and what else has no class of its own, are null."""
    runs_class = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col(runs).cast("string")).cast("int")
    return F.when(F.col(outs) > 0, len(CLASSES) - 1).otherwise(F.nullif(runs_class, F.lit(0)) - 1)


def situation_vectors(rows: DataFrame, keys: Sequence[str], label: str = "y", pseudo: float = 50.0) -> DataFrame:
    """keys, p: in each situation the probabilities of all classes, drawn to the overall shares by `pseudo`
    balls. One aggregate counts the classes as an array; nothing is pivoted."""
    counts = F.array(*(F.count_if(F.col(label) == k).cast("double") for k in range(len(CLASSES))))
    cells = rows.filter(F.col(label).isNotNull()).groupBy(*keys).agg(counts.alias("c"))
    all_of = F.array(*(F.sum(F.col("c")[k]) for k in range(len(CLASSES))))
    overall = cells.agg(all_of.alias("a")).select(F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda s, y: s + y)).alias("base"))
    n = F.aggregate("c", F.lit(0.0), lambda s, y: s + y)
    return cells.crossJoin(F.broadcast(overall)).select(*keys, F.zip_with("c", "base", lambda c, b: (c + pseudo * b) / (n + pseudo)).alias("p"))


def class_scores(scored: DataFrame, p: str = "p", label: str = "y", runs: Sequence[float] = RUNS) -> DataFrame:
    """One row for rows with a probability vector and a class's place: n, log_loss over all classes,
    out_log_loss and out_brier of the last class, runs_rmse of the expected runs. Vectors are clipped
    at 1e-6 and made to sum to 1; rows without a vector or class have no say."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0)))
    rows = scored.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).select(clipped.alias("c"), F.col(label).cast("int").alias("y"))
    rows = rows.select(F.transform("c", lambda x: x / F.aggregate("c", F.lit(0.0), lambda s, y: s + y)).alias("c"), "y")
    brings = F.array(*(F.lit(float(r)) for r in runs))
    expected = F.aggregate(F.zip_with("c", brings, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    rows = rows.select(F.get("c", F.col("y")).alias("own"), F.get("c", F.lit(len(runs) - 1)).alias("out"), (F.col("y") == len(runs) - 1).cast("double").alias("is_out"), (expected - F.get(brings, F.col("y"))).alias("off"))
    return rows.agg(
        F.count("*").alias("n"), F.avg(-F.log("own")).alias("log_loss"), F.avg(-F.col("is_out") * F.log("out") - (1 - F.col("is_out")) * F.log1p(-F.col("out"))).alias("out_log_loss"),
        F.avg((F.col("out") - F.col("is_out")) ** 2).alias("out_brier"), F.sqrt(F.avg(F.col("off") ** 2)).alias("runs_rmse"),
    )
