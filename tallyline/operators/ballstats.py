"""Figures straight from balls: players, teams, venues, match-ups, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import dimensions, flags
from tallyline.functions.scope import Scope, ScopeError
from tallyline.operators.derive import dismissals


def _n(c: Column) -> Column:
    return F.count_if(c)


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return scale * a / F.nullif(b, F.lit(0))


def batting(balls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """player, innings (as striker or partner), not_outs, runs, balls, fours, sixes, highest, average, strike_rate."""
    who = F.explode(F.array_distinct(F.array("batter", "non_striker"))).alias("player")
    there = balls.select("match_id", "innings", *keys, who).filter("player is not null").distinct()
    faced = balls.groupBy("match_id", "innings", *keys, F.col("batter").alias("player")).agg(F.sum("runs_batter").alias("runs"), _n(F.col("faced")).alias("balls"), _n(F.col("four")).alias("fours"), _n(F.col("six")).alias("sixes"))
    outs = dismissals(balls, keys).drop("n", "kind").distinct().withColumn("out", F.lit(1))
    key = ["match_id", "innings", *keys, "player"]
    rows = there.join(faced, key, "left").join(outs, key, "left").fillna(0)
    agg = rows.groupBy("player", *keys).agg(F.count("*").alias("innings"), (F.count("*") - F.sum("out")).alias("not_outs"), *(F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes")), F.max("runs").alias("highest"))
    outs_ = F.col("innings") - F.col("not_outs")
    return agg.withColumns({"average": _ratio(F.col("runs"), outs_), "strike_rate": _ratio(F.col("runs"), F.col("balls"), 100.0)})


def bowling(balls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """player, innings, balls, runs, wickets, maidens, best_wickets, best_runs, average, economy."""
    overs = balls.groupBy("match_id", "innings", *keys, F.col("bowler").alias("player"), "over").agg(_n(F.col("legal")).alias("balls"), F.sum("bowler_runs").alias("runs"), F.sum("credited").alias("wickets"))
    rows = overs.groupBy("match_id", "innings", *keys, "player").agg(F.sum("balls").alias("balls"), F.sum("runs").alias("runs"), F.sum("wickets").alias("wickets"), _n((F.col("balls") >= 6) & (F.col("runs") == 0)).alias("maidens"))
    best = F.max(F.struct("wickets", (-F.col("runs")).alias("r")))
    agg = rows.groupBy("player", *keys).agg(F.count("*").alias("innings"), *(F.sum(c).alias(c) for c in ("balls", "runs", "wickets", "maidens")), best.alias("b"))
    return agg.withColumns({"best_wickets": F.col("b.wickets"), "best_runs": -F.col("b.r"), "average": _ratio(F.col("runs"), F.col("wickets")), "economy": _ratio(F.col("runs"), F.col("balls"), 6.0)}).drop("b")


def fielding(wickets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """player, catches, stumpings, run_outs; the bowler is the catcher of caught and bowled. fielders: an
    array of names."""
    who = F.when(F.col("kind") == "caught and bowled", F.array("bowler")).otherwise(F.col("fielders"))
    rows = wickets.filter(F.col("kind").isin("caught", "caught and bowled", "stumped", "run out")).select(*keys, "kind", F.explode(who).alias("player"))
    return rows.groupBy("player", *keys).agg(_n(F.col("kind").isin("caught", "caught and bowled")).alias("catches"), _n(F.col("kind") == "stumped").alias("stumpings"), _n(F.col("kind") == "run out").alias("run_outs"))


def fielders_from_text(column: str = "fielders") -> Column:
    """A JSON list of names kept as text."""
    return F.from_json(column, "array<string>")


def leaderboard(figures: DataFrame, metric: str, ascending: bool = False, least: int = 0, sample: str = "balls", limit: int = 10) -> DataFrame:
    value = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return figures.filter(F.col(sample) >= least).orderBy(value, F.desc(sample), "player").limit(max(1, min(limit, 50)))


def matches_of(balls: DataFrame, player: str) -> DataFrame:
    """The balls of the matches that a player took part in."""
    own = balls.filter((F.col("batter") == player) | (F.col("non_striker") == player) | (F.col("bowler") == player)).select("match_id").distinct()
    return balls.join(own, "match_id", "left_semi")


#: What a player's figures can be split by: name -> key over flagged balls, for the batting side.
SPLITS = ("season", "year", "format", "competition", "opposition", "team", "venue", "phase", "innings")


def split_key(name: str, role: str) -> Column:
    """The key of a split; a bowler's team is the side that does not bat."""
    if name not in SPLITS:
        raise ScopeError(f"split_by must be one of: {', '.join(SPLITS)}")
    if role == "bowling" and name in ("team", "opposition"):
        name = "opposition" if name == "team" else "team"
    return dimensions.key(name)


def player_stats(balls: DataFrame, role: str = "batting", players: Sequence[str] | None = None, split_by: str | None = None, scope: Scope | None = None) -> DataFrame:
    """batting() or bowling() figures of the balls in scope, of all or the named players, each with the
    column k where they are split. A named batter counts as striker and as partner."""
    rows = (scope or Scope({})).balls(balls, role)
    keys = ()
    if split_by:
        rows, keys = rows.withColumn("k", split_key(split_by, role)), ("k",)
    if players:
        own = F.col("bowler").isin(*players) if role == "bowling" else F.col("batter").isin(*players) | F.col("non_striker").isin(*players)
        rows = rows.filter(own)
    figures = (batting if role == "batting" else bowling)(rows, keys)
    return figures.filter(F.col("player").isin(*players)) if players else figures


def compare(balls: DataFrame, role: str, players: Sequence[str], scope: Scope | None = None) -> DataFrame:
    """The named players' figures side by side, in the order of their names as given."""
    place = F.array_position(F.array(*(F.lit(p) for p in players)), F.col("player"))
    return player_stats(balls, role, players, scope=scope).orderBy(place)


def matches_played(players: DataFrame) -> DataFrame:
    return players.groupBy("player").agg(F.countDistinct("match_id").alias("matches"))


def teams(matches: DataFrame) -> DataFrame:
    """Both sides of each match as rows: team, opponent, won, lost, drawn, batted_first, won_toss."""
    sides = F.explode(F.array(F.struct(F.col("team1").alias("team"), F.col("team2").alias("opponent")), F.struct(F.col("team2").alias("team"), F.col("team1").alias("opponent"))))
    rows = matches.select("*", sides.alias("s")).select("*", "s.team", "s.opponent").drop("s")
    toss = F.col("toss_winner") == F.col("team")
    first = F.when(F.col("toss_decision") == "bat", toss).otherwise(~toss)
    return rows.withColumns({"won": F.col("winner") == F.col("team"), "lost": F.col("winner") == F.col("opponent"), "open": F.col("winner").isNull(), "won_toss": toss, "batted_first": first})


def team_leaderboard(sides: DataFrame, least: int = 10) -> DataFrame:
    """team, played, won, lost, win_pct of the decided, for teams with at least `least` decided matches."""
    agg = sides.groupBy("team").agg(F.count("*").alias("played"), _n(F.col("won")).alias("won"), _n(F.col("lost")).alias("lost"))
    return agg.filter(F.col("won") + F.col("lost") >= least).withColumn("win_pct", _ratio(F.col("won"), F.col("won") + F.col("lost"), 100.0))


def team_stats(sides: DataFrame) -> DataFrame:
    """Per team: results, batting first and chasing, toss, and the last five as text, latest first."""
    both = lambda a, b: _n(a & b)
    mark = F.when(F.col("won"), "W").when(F.col("lost"), "L").otherwise("N")
    order = Window.partitionBy("team").orderBy(F.desc("date"), F.desc("match_id"))
    recent = sides.withColumn("n", F.row_number().over(order)).filter("n <= 5").groupBy("team").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", mark.alias("m")))), lambda x: x["m"]), "").alias("last_five"))
    agg = sides.groupBy("team").agg(F.count("*").alias("played"), _n(F.col("won")).alias("won"), _n(F.col("lost")).alias("lost"), _n(F.col("open")).alias("no_result"), _n(F.col("batted_first")).alias("first"), both(F.col("batted_first"), F.col("won")).alias("won_first"), both(~F.col("batted_first"), F.col("won")).alias("won_chasing"), _n(F.col("won_toss")).alias("tosses"), both(F.col("won_toss"), F.col("won")).alias("won_after_toss"))
    return agg.join(recent, "team")


def head_to_head(sides: DataFrame) -> DataFrame:
    return sides.groupBy("team", "opponent").agg(F.count("*").alias("played"), _n(F.col("won")).alias("won"), _n(F.col("lost")).alias("lost"))


def innings_totals(balls: DataFrame) -> DataFrame:
    return balls.groupBy("match_id", "innings", "venue", "format", "date").agg(F.sum("runs_total").alias("total"), F.sum("outs").alias("wickets"), _n(F.col("legal")).alias("balls"))


def venue_stats(totals: DataFrame, first_wins: DataFrame | None = None) -> DataFrame:
    """venue, format: matches, mean first and second totals, highest and lowest total."""
    of = lambda k: F.avg(F.when(F.col("innings") == k, F.col("total")))
    return totals.groupBy("venue", "format").agg(F.countDistinct("match_id").alias("matches"), of(1).alias("first"), of(2).alias("second"), F.max("total").alias("highest"), F.min("total").alias("lowest"))


def lean(share: Column) -> Column:
    """What a share of wins batting first says of a ground."""
    return F.when(share >= 55, "batting first").when(share <= 45, "chasing").otherwise("even")


def matchups(balls: DataFrame, least: int = 12) -> DataFrame:
    """batter, bowler: balls, runs, outs, dots, boundaries, strike_rate; pairs of at least `least` balls."""
    out = F.col("striker_kind").isin(*flags.CREDITED)
    agg = balls.groupBy("batter", "bowler").agg(_n(F.col("faced")).alias("balls"), F.sum("runs_batter").alias("runs"), _n(out).alias("outs"), _n(F.col("faced") & F.col("dot")).alias("dots"), _n(F.col("four") | F.col("six")).alias("boundaries"))
    return agg.filter(F.col("balls") >= least).withColumn("strike_rate", _ratio(F.col("runs"), F.col("balls"), 100.0))


def top_performances(balls: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    """Single performances: 'batting' (runs, fewer balls first), 'bowling' (wickets, fewer runs first),
    'totals' (highest) or 'lowest' (all-out totals only)."""
    if kind == "batting":
        rows = balls.groupBy("match_id", "innings", F.col("batter").alias("who")).agg(F.sum("runs_batter").alias("a"), _n(F.col("faced")).alias("b"))
        order = [F.desc("a"), F.asc("b")]
    elif kind == "bowling":
        rows = balls.groupBy("match_id", "innings", F.col("bowler").alias("who")).agg(F.sum("credited").alias("a"), F.sum("bowler_runs").alias("b"))
        order = [F.desc("a"), F.asc("b")]
    else:
        rows = balls.groupBy("match_id", "innings").agg(F.max("team").alias("who"), F.sum("runs_total").alias("a"), F.sum("outs").alias("b"))
        rows = rows.filter("b >= 10") if kind == "lowest" else rows
        order = [F.asc("a") if kind == "lowest" else F.desc("a"), F.asc("b")]
    return rows.orderBy(*order, "match_id", "innings", "who").limit(max(1, min(limit, 50)))
