"""The win model's feature matrix: the state after each ball with what was known before its match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .models import ELO_START, FORM_BALLS, OVERS, elo, match_map, win_rows

FEATURES = ("innings", "balls_left", "wickets_left", "score", "target", "needed", "required", "par", "female", "overs", "rating_lead", "striker_form")


def rating_history(matches: DataFrame) -> DataFrame:
    """pool, team, date, match_id, rating: each team's rating after each of its matches (elo() over pool, date,
    match_id, team1, team2, winner, tied), for as-of joins: the rating before its next match is the one after
    this."""
    before = elo(matches)
    sides = matches.join(before, ["pool", "match_id"]).select("pool", "date", "match_id", F.explode(F.array(*(F.struct(F.col(f"team{k}").alias("team"), F.col(f"before{k}").alias("before")) for k in (1, 2)))).alias("s"))
    along = Window.partitionBy("pool", "s.team").orderBy("date", "match_id")
    # What a match changed shows before the team's next one; the last change has no later reader.
    later = F.lead("s.before").over(along)
    return sides.withColumn("rating", later).select("pool", "s.team", "date", "match_id", "rating").filter("rating is not null")


def running_history(rows: DataFrame, keys: list[str], values: dict, at: str = "date") -> DataFrame:
    """keys, at and each value's aggregate up to and including that time: a history for as-of joins."""
    days = rows.groupBy(*keys, at).agg(*(F.sum(v).alias(n) for n, v in values.items()))
    along = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*keys, at, *(F.sum(n).over(along).alias(n) for n in values))


def win_matrix(balls: DataFrame, ratings: DataFrame, totals: DataFrame, batting: DataFrame, overs: dict[str, int] | None = None, female: str = "female", shares: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """match_id, innings, seq, batter, the FEATURES and won of every ball of win_rows(); keep: columns of the balls
    that come along.

    ratings (pool, team, date, rating; pool is format group and gender joined by a bar), totals
    (venue, fgroup, date, runs, n: first-innings runs and innings so far) and batting (player, gender,
    date, runs, balls: so far) are histories: of each the latest row before the match's day counts.
    rating_lead is the batting side's rating less the other's, ELO_START where none is known; par is
    the venue's mean total; striker_form is the striker's runs a ball, drawn to the pool's mean by
    FORM_BALLS balls. A match has a few sides and strikers, so the as-of joins run over these; what
    they find goes back to the match as one map each. Balls that are bucketed by match stay where they
    are; shares is the number of their buckets. A match has one row in each map, so Spark drops the join of a
    map, and all that it is made of, where none of its features is asked for."""
    pool = F.concat_ws("|", "fgroup", "gender")
    own = balls.filter(F.col("fgroup").isin(*(overs or OVERS)) & F.col("innings").isin(1, 2)).dropna(subset=["match_id", "seq"])
    rows = win_rows(own, overs=overs, keep=("batter", "gender", "fgroup", "venue", "date", "team", "opposition", *keep)).withColumnRenamed("score_after", "score")
    both = own.select("match_id", "date", pool.alias("pool"), "team", "opposition").distinct()
    sides = both.select("match_id", "date", "pool", F.explode(F.array("team", "opposition")).alias("team")).distinct().filter("team is not null")
    rated = asof_join(sides, ratings, ["pool", "team"], "date", ["rating"]).withColumn("rating", F.coalesce("rating", F.lit(ELO_START)))
    places = own.select("match_id", "date", "venue", "fgroup").distinct().filter("venue is not null")
    par = asof_join(places, totals, ["venue", "fgroup"], "date", ["runs", "n"]).withColumn("par", F.col("runs") / F.nullif(F.col("n"), F.lit(0)))
    strikers = own.select("match_id", "date", F.col("batter").alias("player"), "gender").distinct().filter("player is not null and gender is not null")
    mean = batting.groupBy("player", "gender").agg(F.max("runs").alias("runs"), F.max("balls").alias("balls")).groupBy("gender").agg((F.sum("runs") / F.nullif(F.sum("balls"), F.lit(0))).alias("mean"))
    form = asof_join(strikers, batting, ["player", "gender"], "date", ["runs", "balls"]).join(mean, "gender", "left")
    form = form.withColumn("form", (F.coalesce("runs", F.lit(0)) + FORM_BALLS * F.col("mean")) / (F.coalesce("balls", F.lit(0)) + FORM_BALLS))
    of = lambda name, *key: F.try_element_at(name, F.struct(*(F.col(c).alias(k) for k, c in key)))
    at = ("date", "date")
    rows = rows.withColumn("pool", pool).join(match_map(rated, ["team", "pool", "date"], "rating", "_ratings", shares), "match_id", "left")
    rows = rows.withColumn("rating_lead", of("_ratings", ("team", "team"), ("pool", "pool"), at) - of("_ratings", ("team", "opposition"), ("pool", "pool"), at)).drop("_ratings", "team", "opposition", "pool")
    rows = rows.join(match_map(par, ["venue", "fgroup", "date"], "par", "_pars", shares), "match_id", "left")
    rows = rows.withColumn("par", of("_pars", ("venue", "venue"), ("fgroup", "fgroup"), at)).drop("_pars", "venue", "fgroup")
    rows = rows.join(match_map(form, ["player", "gender", "date"], "form", "_forms", shares), "match_id", "left")
    rows = rows.withColumns({"striker_form": of("_forms", ("player", "batter"), ("gender", "gender"), at), "female": (F.col("gender") == female).cast("int"), "overs": F.col("balls_total") / 6})
    return rows.select("match_id", "innings", "seq", "batter", *FEATURES[1:], "won", *keep)
