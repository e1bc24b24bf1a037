"""A match to be replayed: one nested row of its result, innings, balls, moments and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of dismissal without a bowler's part: fixed values.
NOT_THE_BOWLERS = ("run out", "retired hurt", "obstructing the field")


def result_words() -> Column:
    """A match's result (winner, result, method, win_by_runs, win_by_wickets) in words: ties name the winner
    of the super over, and a result by the rain rule is marked."""
    by = lambda n, what: F.when(F.coalesce(F.col(n), F.lit(0)) != 0, F.concat(F.lit(" by "), F.col(n).cast("string"), F.lit(what)))
    how = F.coalesce(by("win_by_runs", " runs"), by("win_by_wickets", " wickets"), F.lit(""))
    rain = F.when(F.col("method") == "D/L", " (DLS)").otherwise("")
    over = F.when(F.col("winner").isNotNull(), F.concat(F.lit(" ("), F.col("winner"), F.lit(" won the super over)"))).otherwise("")
    won = F.concat(F.col("winner"), F.lit(" won"), how, rain)
    return F.when(F.col("result") == "no result", "No result").when(F.col("result") == "tie", F.concat(F.lit("Tied"), over)).otherwise(F.coalesce(won, F.lit("No result")))


def ball_words() -> Column:
    """A ball (over, ball, batter, bowler, runs_batter, runs_total, kind, player_out) in words."""
    place = F.concat(F.col("over").cast("string"), F.lit("."), F.col("ball").cast("string"), F.lit(": "))
    by = F.when(F.col("kind").isin(*NOT_THE_BOWLERS), "").otherwise(F.concat(F.lit(", "), F.col("bowler")))
    gone = F.concat(F.coalesce("player_out", "batter"), F.lit(" "), F.col("kind"), by)
    edge = F.concat(F.col("batter"), F.lit(" hits "), F.col("bowler"), F.lit(" for "), F.col("runs_batter").cast("string"))
    plain = F.concat(F.col("batter"), F.lit(" "), F.col("runs_total").cast("string"), F.lit(" off "), F.col("bowler"))
    return F.concat(place, F.when(F.col("kind").isNotNull(), gone).when(F.col("runs_batter").isin(4, 6), edge).otherwise(plain))


#: Child table -> the columns of its structs, the first ones in the order of the list.
CHILDREN = {
    "balls": ("innings", "seq", "over", "ball", "legal", "score", "wickets", "team", "runs", "wicket", "boundary", "p", "text"),
    "moments": ("start", "stop", "swing"),
    "batting": ("innings", "position", "player", "team", "runs", "balls", "fours", "sixes", "out", "kind"),
    "bowling": ("innings", "order", "player", "team", "balls", "runs", "wickets", "dots"),
}


def bundles(matches: DataFrame, balls: DataFrame, batting: DataFrame, bowling: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """One row a match: match_id, match (its own columns and summary), innings, balls, moments, batting,
    bowling (arrays of structs in order), rain.

    matches has winner, result, method, win_by_runs, win_by_wickets and more; balls are scored ones
    (p: the first side's chance, may be null) with score_after, legal_after, wickets_after; batting and
    bowling are innings tables, of which batters without a ball are left out. All children meet in one
    exchange on match_id, each row in a column of its own kind; a match without balls has empty
    arrays. The innings are read off the balls' array."""
    about = F.struct(*(F.col(c) for c in matches.columns if c != "match_id"), result_words().alias("summary"))
    boundary = F.when(F.col("runs_batter").isin(4, 6), F.col("runs_batter"))
    rows = {
        "balls": balls.withColumns({"score": F.col("score_after"), "legal": F.col("legal_after"), "wickets": F.col("wickets_after"), "runs": F.col("runs_total"), "wicket": F.col("kind").isNotNull(), "boundary": boundary, "text": ball_words()}),
        "moments": moments,
        "batting": batting.filter("balls > 0"),
        "bowling": bowling.withColumn("order", F.struct(-F.col("wickets"), F.col("runs"))),
    }
    kinds = {name: F.struct(*(F.col(c) for c in CHILDREN[name])) for name in rows}
    parts = [matches.select("match_id", about.alias("match"))] + [df.select("match_id", kinds[name].alias(name)) for name, df in rows.items() if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    lists = [F.sort_array(F.collect_list(name)).alias(name) for name, df in rows.items() if df is not None]
    found = out.groupBy("match_id").agg(F.any_value("match", True).alias("match"), *lists)
    if moments is None:
        found = found.withColumn("moments", F.array().cast("array<struct<start:bigint,stop:bigint,swing:double>>"))
    last = lambda k: F.try_element_at(F.filter("balls", lambda b: b["innings"] == k), F.lit(-1))
    first_total = last(1)["score"]
    overs = lambda legal: F.concat(F.floor(legal / 6).cast("string"), F.lit("."), (legal % 6).cast("string"))
    one = lambda k: F.struct(F.lit(k).alias("innings"), last(k)["team"].alias("team"), last(k)["score"].alias("score"), last(k)["wickets"].alias("wickets"), overs(last(k)["legal"]).alias("overs"), (first_total + 1 if k == 2 else F.lit(None).cast("long")).alias("target"))
    innings = F.filter(F.array(one(1), one(2)), lambda x: x["score"].isNotNull())
    return found.filter("match is not null").select("match_id", "match", innings.alias("innings"), "balls", "moments", "batting", "bowling", F.coalesce(F.col("match.method") == "D/L", F.lit(False)).alias("rain"))
