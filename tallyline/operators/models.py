"""Win probability and next-ball models: states, features known beforehand, scorers, evaluation."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = (0.001, 0.999)
FORM_BALLS = 120.0
#: Bands of scores within which they are ranked.
BANDS = 1000
ELO_K, ELO_START, ELO_SCALE = 24.0, 1500.0, 400.0


def venue_par(totals: DataFrame, ground: int = 20, least: int = 3, recent: int = 200) -> DataFrame:
    """Adds par to first-innings totals (match_id, venue, format, date, total): the mean of the last
    `ground` earlier ones at the venue, or with fewer than `least` of them of the format's last `recent`.

    A format is no task of its own: its days are numbered and summed up, one row a day, its matches then
    within their day, and the mean of the last ones is the difference of two sums that are joined by
    the matches' numbers."""
    at = Window.partitionBy("venue", "format").orderBy("date", "match_id").rowsBetween(-ground, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = totals.groupBy("format", "date").agg(F.count("*").alias("_n"), F.sum("total").alias("_sum"))
    along, day = Window.partitionBy("format").orderBy("date"), Window.partitionBy("format", "date").orderBy("match_id")
    days = days.select("format", "date", before("_n", along).alias("_first"), before("_sum", along).alias("_before"))
    rows = totals.withColumns({"earlier": F.count("*").over(at), "_own": F.avg("total").over(at)}).join(days, ["format", "date"])
    rows = rows.withColumns({"_place": F.col("_first") + F.row_number().over(day) - 1, "_sum": F.col("_before") + before("total", day)})
    start = rows.select("format", (F.col("_place") + recent).alias("_place"), F.col("_sum").alias("_start"))
    last = (F.col("_sum") - F.coalesce("_start", F.lit(0))) / F.nullif(F.least(F.col("_place"), F.lit(recent)), F.lit(0))
    par = F.when(F.col("earlier") >= least, F.col("_own")).otherwise(last)
    return rows.join(start, ["format", "_place"], "left").withColumn("par", par).select(*totals.columns, "earlier", "par")


def ball_states(balls: DataFrame) -> DataFrame:
    """Adds the running score, legal balls and wickets after each ball and its number."""
    w = Window.partitionBy("match_id", "innings").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return balls.withColumns({"score_after": F.sum("runs_total").over(w), "legal_after": F.sum(F.col("legal").cast("int")).over(w), "wickets_after": F.sum("outs").over(w)})


#: Overs of an innings by format group.
OVERS = {"T20": 20, "ODI": 50}


def win_rows(balls: DataFrame, par: DataFrame | None = None, overs: dict[str, int] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The state after every ball of limited-overs innings 1 and 2 with what a forecast may know: balls_left,
    wickets_left, and in a chase the target, what is needed and at which rate; null where it does not
    apply. won: whether the batting side did, null without a decision. par (match_id, par) is joined
    if given. keep: columns of the balls that come along."""
    overs = overs or OVERS
    states = ball_states(balls.filter(F.col("fgroup").isin(*overs) & F.col("innings").isin(1, 2)))
    total = F.max(F.when(F.col("innings") == 1, F.col("score_after"))).over(Window.partitionBy("match_id"))
    target = F.when(F.col("innings") == 2, total + 1)
    length = 6 * F.coalesce(F.create_map(*(F.lit(x) for kv in overs.items() for x in kv))[F.col("fgroup")], F.lit(0))
    out = states.withColumns({"target": target, "balls_total": length, "balls_left": F.greatest(length - F.col("legal_after"), F.lit(0)), "wickets_left": 10 - F.least("wickets_after", F.lit(10))})
    out = out.withColumns({"needed": F.col("target") - F.col("score_after"), "won": F.when(F.col("result") == "won", 1).when(F.col("result") == "lost", 0)})
    out = out.withColumn("required", 6.0 * F.col("needed") / F.greatest("balls_left", F.lit(1)))
    columns = ("match_id", "innings", "seq", "score_after", "wickets_left", "balls_total", "balls_left", "target", "needed", "required", "won", *keep)
    return out.select(*columns) if par is None else out.join(par.select("match_id", "par"), "match_id", "left").select(*columns, "par")


def form_before(innings: DataFrame, values: Sequence[str]) -> DataFrame:
    """Each player's totals of `values` before the match: nothing of the match itself leaks in."""
    key = ["player", "gender"]
    per_match = innings.groupBy(*key, "date", "match_id").agg(*(F.sum(v).alias(v) for v in values))
    w = Window.partitionBy(*key).orderBy("date", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    return per_match.select(*key, "date", "match_id", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_before") for v in values))


def next_ball_rows(balls: DataFrame) -> DataFrame:
    """Each faced ball's outcome ('W' for a dismissal, else the striker's runs) with what was known before
    it, other balls included: score and wickets of the innings, balls and runs of the striker's, and the
    bowler's, stay so far."""

    def before(*keys: str):
        return Window.partitionBy("match_id", "innings", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    faced, legal = F.col("faced").cast("int"), F.col("legal").cast("int")
    outcome = F.when(F.col("outs") > 0, "W").otherwise(F.col("runs_batter").cast("string"))
    return balls.select(
        "match_id", "innings", "seq", total("runs_total", before()).alias("score"), total("outs", before()).alias("wickets"),
        total(faced, before("batter")).alias("striker_balls"), total("runs_batter", before("batter")).alias("striker_runs"),
        total(legal, before("bowler")).alias("bowler_balls"), total("bowler_runs", before("bowler")).alias("bowler_conceded"), outcome.alias("outcome"), "faced", "batter", "bowler", "gender",
    ).filter("faced").drop("faced")


def match_map(found: DataFrame, key: list[str], value: str, name: str, shares: int | None) -> DataFrame:
    """match_id, name: the values of a match's few keys in one map, dealt as the match's balls are."""
    dealt = found.repartition("match_id") if shares is None else found.repartition(shares, "match_id")
    return dealt.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*key), F.col(value)))).alias(name))


def next_ball_form(rows: DataFrame, batting: DataFrame, bowling: DataFrame, shares: int | None = None) -> DataFrame:
    """next_ball_rows() with the striker's and the bowler's career runs a ball before the match, drawn to the
    career mean of all by FORM_BALLS balls. A match's few forms come to it as a map, so rows that are bucketed by
    match stay where they are; shares is the number of their buckets."""
    for who, innings in (("batter", batting), ("bowler", bowling)):
        mean = innings.agg((F.sum("runs") / F.sum("balls")).alias("mean"))
        form = (F.col("runs_before") + FORM_BALLS * F.col("mean")) / (F.col("balls_before") + FORM_BALLS)
        found = form_before(innings, ["runs", "balls"]).dropna(subset=["player", "gender"]).crossJoin(F.broadcast(mean)).withColumn("form", form)
        known = F.try_element_at("_forms", F.struct(F.col(who).alias("player"), F.col("gender").alias("gender")))
        rows = rows.join(match_map(found, ["player", "gender"], "form", "_forms", shares), "match_id", "left").withColumn(f"{who}_form", known).drop("_forms")
    return rows


def shrunk_form(x: str, n: str, mean: float, pseudo: float = 120.0) -> Column:
    return (F.col(x) + pseudo * mean) / (F.col(n) + pseudo)


def career_snapshot(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """player, gender with batting and bowling totals, of whoever has either."""
    a = batting.groupBy("player", "gender").agg(F.sum("runs").alias("bat_runs"), F.sum("balls").alias("bat_balls"))
    b = bowling.groupBy("player", "gender").agg(F.sum("runs").alias("bowl_runs"), F.sum("balls").alias("bowl_balls"), F.sum("wickets").alias("bowl_wickets"))
    return a.join(b, ["player", "gender"], "full").fillna(0)


def elo_shift(lead: float, points: float, k: float) -> float:
    """What the first side wins, and the other loses, by so many points (1, 0.5, 0) at a rating lead."""
    expected = 1 / (1 + 10 ** (-lead / ELO_SCALE))  # a fixed formula: the usual one of ratings
    return k * (points - expected)


def elo(matches: DataFrame, k: float = ELO_K) -> DataFrame:
    """Ratings before each match: (pool, match_id, before1, before2), from (pool, date, match_id, team1,
    team2, winner, tied). A tie counts half, a match without result changes nothing.

    Each rating depends on all earlier ones, so a pool is folded in order by one task. Spark sorts its
    matches (spilling to disk) and they pass batch by batch: only the teams' ratings are held.
    """
    schema = "pool string, match_id long, before1 double, before2 double"

    def fold(batches):
        at, standing = object(), {}
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in columns}
            before = []
            for pool, sides, winner, tied in zip(c["pool"], zip(c["team1"], c["team2"]), c["winner"], c["tied"]):
                if pool != at:
                    at, standing = pool, {}
                before.append(tuple(standing.get(side, ELO_START) for side in sides))
                points = 0.5 if tied else None if winner is None else float(winner == sides[0])
                if points is not None:
                    shift = elo_shift(before[-1][0] - before[-1][1], points, k)
                    standing |= dict(zip(sides, (before[-1][0] + shift, before[-1][1] - shift)))
            out = [pa.array(c["pool"], pa.string()), pa.array(c["match_id"], pa.int64()), *(pa.array([x[i] for x in before], pa.float64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(out, names=["pool", "match_id", "before1", "before2"])

    columns = ["pool", "date", "match_id", "team1", "team2", "winner", "tied"]
    ordered = matches.select(*columns).withColumn("match_id", F.col("match_id").cast("long")).repartition("pool")
    return ordered.sortWithinPartitions("pool", F.asc_nulls_last("date"), F.asc_nulls_last("match_id")).mapInArrow(fold, schema)


def logistic(features: Sequence[str], mean: Sequence[float], scale: Sequence[float], weights: Sequence[float], intercept: float) -> Column:
    """Log-odds of a standardised linear model; a missing feature counts as its mean."""
    z = F.lit(float(intercept))
    for f, m, s, w in zip(features, mean, scale, weights):
        z = z + float(w) * (F.coalesce(F.col(f).cast("double"), F.lit(float(m))) - float(m)) / float(s)
    return z


def probability(log_odds: Column) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-log_odds)), F.lit(CLIP[0])), F.lit(CLIP[1]))


def tree_scorer(model: str, features: Sequence[str]) -> Column:
    """Sum of a tree ensemble's leaves over the features, as a pandas UDF over Arrow batches.

    model: JSON [{"feature": i, "threshold": t, "default_left": bool, "left": .., "right": ..} | leaf];
    left if the value is at most the threshold, missing values as default_left says.
    """
    trees = json.loads(model)

    def walk(node, x, rows, out):
        if not isinstance(node, dict):
            out[rows] += node
            return
        v = x[rows, node["feature"]]
        left = np.where(np.isnan(v), node["default_left"], v <= node["threshold"])
        walk(node["left"], x, rows[left.astype(bool)], out)
        walk(node["right"], x, rows[~left.astype(bool)], out)

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        x, out = values.to_numpy(dtype=float), np.zeros(len(values))
        for tree in trees:
            walk(tree, x, np.arange(len(x)), out)
        return pd.Series(out)

    return score(F.struct(*(F.col(f).cast("double").alias(f) for f in features)))


def blended(log_odds: Sequence[Column]) -> Column:
    return probability(sum(log_odds[1:], log_odds[0]) / len(log_odds))


def accuracy(scored: DataFrame, p: str = "p", label: str = "y") -> DataFrame:
    """One row: n, log_loss, brier and ones, the rows of label 1. Sums alone: no row is ranked or moved."""
    P, Y = F.col(p), F.col(label)
    return scored.agg(F.count("*").alias("n"), F.avg(-(Y * F.log(P) + (1 - Y) * F.log(1 - P))).alias("log_loss"), F.avg((P - Y) ** 2).alias("brier"), F.sum(Y).alias("ones"))


def evaluation(scored: DataFrame, p: str = "p", label: str = "y", bins: int = 20) -> DataFrame:
    """One row: n, log_loss, brier, auc (by rank sums, ties half) and ece over equal bins."""
    P, Y = F.col(p), F.col(label)
    basic = accuracy(scored, p, label)
    # Distinct scores lie in bands: sums over the bands before, then within the band.
    values = scored.groupBy(P.alias("v")).agg(F.count("*").alias("m"), F.sum(Y).alias("k")).withColumn("band", F.floor(F.col("v") * BANDS))
    before = lambda w: F.coalesce(F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("z", F.col("m") - F.col("k"))
    bands = values.groupBy("band").agg(F.sum("z").alias("z")).select("band", before(Window.orderBy("band")).alias("earlier"))  # BANDS rows
    ranks = values.join(F.broadcast(bands), "band").withColumn("zeros_below", F.col("earlier") + before(Window.partitionBy("band").orderBy("v")))
    wins = ranks.agg(F.sum(F.col("k") * (F.col("zeros_below") + (F.col("m") - F.col("k")) / 2)).alias("wins"))
    cal = scored.groupBy(F.least(F.floor(P * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("m"), F.abs(F.avg(P) - F.avg(Y)).alias("gap")).agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"))
    auc = F.col("wins") / F.nullif(F.col("ones") * (F.col("n") - F.col("ones")), F.lit(0))
    return basic.crossJoin(F.broadcast(wins)).crossJoin(F.broadcast(cal)).select("n", "log_loss", "brier", auc.alias("auc"), "ece")


def time_split(column: str = "yr", train_to: int = 2022, check_to: int = 2024) -> Column:
    return F.when(F.col(column) <= train_to, "train").when(F.col(column) <= check_to, "check").otherwise("test")


def situation_lookup(rows: DataFrame, keys: Sequence[str], label: str, pseudo: float = 50.0) -> DataFrame:
    """(keys, label): share of each outcome in a situation, smoothed towards the overall shares."""
    overall = rows.groupBy(label).agg(F.count("*").alias("c")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).select(label, (F.col("c") / F.col("all")).alias("base"))
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(overall))
    seen = rows.groupBy(*keys, label).agg(F.count("*").alias("c"))
    return cells.join(seen, [*keys, label], "left").select(*keys, label, "n", ((F.coalesce("c", F.lit(0)) + pseudo * F.col("base")) / (F.col("n") + pseudo)).alias("p"))


def train_win_model(rows: DataFrame, features: Sequence[str], label: str = "y"):
    """A logistic regression and boosted trees of pyspark.ml on the same standardised features; the mean
    of their log-odds is the forecast. Spark's trees know no monotone constraints."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_{f}" for f in features]
    prepare = [Imputer(inputCols=list(features), outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    linear = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_pl", rawPredictionCol="_rl", predictionCol="_yl")
    trees = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=20, maxDepth=4, seed=1, predictionCol="_yt").setProbabilityCol("_pt").setRawPredictionCol("_rt")
    return Pipeline(stages=[*prepare, linear, trees]).fit(rows)


def train_next_ball(rows: DataFrame, features: Sequence[str], label: str = "outcome"):
    """Multinomial forest over outcome classes 0 .. n-1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=30, maxDepth=6, seed=1)]).fit(rows)


# --- replay -------------------------------------------------------------------------------------------------------


def swings(scored: DataFrame, p: str = "p") -> DataFrame:
    """Adds swing: the change of the forecast at each ball."""
    w = Window.partitionBy("match_id").orderBy("innings", "seq")
    return scored.withColumn("swing", F.col(p) - F.lag(p).over(w))


def key_moments(moments: DataFrame, least: float = 0.05, most: int = 6) -> DataFrame:
    """Of each match's moments (match_id, start, stop, swing) the largest swings that do not overlap."""

    columns = {"match_id": "long", "start": "long", "stop": "long", "swing": "double"}
    rows = moments.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items())).filter((F.abs("swing") >= least) & ~F.isnan("swing"))
    # a match's moments are at most its balls
    found = F.array_sort(F.collect_list(F.struct((-F.abs("swing")).alias("size"), "start", "stop", "swing")))
    apart = lambda taken, x: (F.size(taken) < most) & F.forall(taken, lambda t: (x["stop"] < t["start"]) | (x["start"] > t["stop"]))
    none = F.array().cast("array<struct<size:double,start:bigint,stop:bigint,swing:double>>")
    taken = F.aggregate("found", none, lambda taken, x: F.when(apart(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return rows.groupBy("match_id").agg(found.alias("found")).select("match_id", F.explode(taken).alias("t")).select("match_id", "t.start", "t.stop", "t.swing")


def story(scored: DataFrame, p: str = "p") -> DataFrame:
    """match_id, innings, over: the state after the over's last ball."""
    last = F.max_by(F.struct("score_after", "wickets_after", F.col(p).alias("p")), "seq")
    return scored.groupBy("match_id", "innings", "over").agg(last.alias("s"), F.sum("runs_total").alias("runs")).select("match_id", "innings", "over", "runs", F.col("s.score_after").alias("score"), F.col("s.wickets_after").alias("wickets"), F.col("s.p").alias("p"))


def result_text() -> Column:
    """A match's result in words."""
    by = F.when(F.col("win_by_runs") > 0, F.concat(F.lit(" by "), F.col("win_by_runs").cast("string"), F.lit(" runs"))).when(F.col("win_by_wickets") > 0, F.concat(F.lit(" by "), F.col("win_by_wickets").cast("string"), F.lit(" wickets"))).otherwise("")
    return F.when(F.col("winner").isNotNull(), F.concat(F.col("winner"), F.lit(" won"), by)).otherwise(F.coalesce("result_type", F.lit("no result")))
