"""Reliability studies: how much of a rate is skill, and what predicts next year.

Players' seasons are cut into halves by a portable hash of the match; the weighted covariance of the
halves is the variance of skill, K the sample at which a rate is half skill. All metrics go through
one aggregation as rows (metric, n, x) instead of one pass each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metric -> (count column, sample column, whether each sample is 0 or 1).
SPECS = {
    "batting": {"runs": ("runs", "balls", False), "out": ("out", "balls", True), "dot": ("n_dot", "balls", True), "boundary": ("n_boundary", "balls", True), "inplay": ("inplay_runs", "n_inplay", False), "ct_field": ("n_ct_field", "balls", True)},
    "bowling": {"runs": ("runs", "deliveries", False), "wickets": ("wickets", "deliveries", True), "dot": ("n_dot", "deliveries", True), "boundary": ("n_boundary", "deliveries", True), "inplay": ("inplay_runs", "n_inplay", False), "ct_field": ("n_ct_field", "deliveries", True)},
}
#: Least sample of a player's season: (bowling, batting) by format group. Fixed values.
LEAST = {"T20": (120, 60), "ODI": (300, 150), "MULTI": (600, 300)}
LEAST_HALF = 20
#: Fewer qualified seasons, or pairs of seasons, give no estimate: a fixed value.
FEWEST = 20


def half(match: str = "match_id") -> Column:
    """0 or 1 by a hash that every engine computes alike."""
    return (F.conv(F.substring(F.md5(F.col(match).cast("string")), 1, 8), 16, 10).cast("long") % 2).cast("int")


def seasons(innings: DataFrame, role: str) -> DataFrame:
    """(fgroup, gender, player, yr, half, metric, n, x), all metrics of the role as rows."""
    rows = innings.withColumn("n_boundary", F.col("n_four") + F.col("n_six"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(n).cast("double").alias("n"), F.col(x).cast("double").alias("x")) for m, (x, n, _) in SPECS[role].items())))
    rows = rows.select("fgroup", "gender", "player", "yr", half().alias("half"), pairs.alias("p")).select("fgroup", "gender", "player", "yr", "half", "p.*")
    return rows.groupBy("fgroup", "gender", "player", "yr", "half", "metric").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def limits_of(role: str) -> dict[str, float]:
    """The least sample of a season by format group."""
    return {fgroup: pair[0 if role == "bowling" else 1] for fgroup, pair in LEAST.items()}


def enough(sample: Column, limits: dict[str, float]) -> Column:
    """Whether a sample qualifies in its format group; a group without a limit has no qualified seasons."""
    return F.coalesce(sample >= F.create_map(*(F.lit(x) for f, n in limits.items() for x in (f, float(n))))[F.col("fgroup")], F.lit(False))


def halves(rows: DataFrame, least: float = LEAST_HALF, limits: dict[str, float] | None = None) -> DataFrame:
    """Players' seasons with both halves of at least `least` samples, and with limits (see limits_of) a
    qualified sample: na, nb, a, b (rates)."""
    of = lambda k, c: F.sum(F.when(F.col("half") == k, F.col(c)))
    wide = rows.groupBy("fgroup", "gender", "player", "yr", "metric").agg(of(0, "n").alias("na"), of(1, "n").alias("nb"), of(0, "x").alias("xa"), of(1, "x").alias("xb"))
    if limits is not None:
        wide = wide.filter(enough(F.col("na") + F.col("nb"), limits))
    return wide.filter((F.col("na") >= least) & (F.col("nb") >= least)).withColumns({"a": F.col("xa") / F.col("na"), "b": F.col("xb") / F.col("nb")})


def weighted(w: str, x: str, y: str) -> dict[str, Column]:
    """Sums from which weighted means, (co)variances, correlation and slope follow."""
    W, X, Y = F.col(w), F.col(x), F.col(y)
    return {"sw": F.sum(W), "sx": F.sum(W * X), "sy": F.sum(W * Y), "sxy": F.sum(W * X * Y), "sxx": F.sum(W * X * X), "syy": F.sum(W * Y * Y)}


def _cov(a: str = "x", b: str = "y") -> Column:
    pair = "sxy" if a != b else f"s{a}{a}"
    return F.col(pair) / F.col("sw") - F.col(f"s{a}") * F.col(f"s{b}") / (F.col("sw") * F.col("sw"))


def correlation() -> Column:
    spread = _cov("x", "x") * _cov("y", "y")
    return F.when(spread > 0, _cov() / F.sqrt(spread))


def slope() -> Column:
    return _cov() / F.nullif(_cov("x", "x"), F.lit(0.0))


def stability(innings: DataFrame, role: str, least: float = LEAST_HALF, per_sample: DataFrame | None = None, limits: dict[str, float] | None = None, fewest: int = 0) -> DataFrame:
    """(fgroup, gender, metric): n seasons, tau2 (variance of skill), sigma2 (per sample), k, r of a whole
    season (Spearman-Brown), typical sample and its reliability n / (n + K).

    sigma2 is p(1-p) for rates of 0 or 1; for others it comes from per_sample (fgroup, gender, metric,
    sigma2). k is null where the halves do not vary together. limits: see halves(); groups of fewer than
    `fewest` seasons have no estimates.
    """
    h = halves(seasons(innings, role), least, limits).withColumn("w", F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    sums = h.groupBy("fgroup", "gender", "metric").agg(*(c.alias(k) for k, c in weighted("w", "a", "b").items()), F.count("*").alias("seasons"), (F.sum(F.col("xa") + F.col("xb")) / F.sum(F.col("na") + F.col("nb"))).alias("p"), F.percentile(F.col("na") + F.col("nb"), F.lit(0.5)).alias("typical"))
    binary = [m for m, (_, _, b) in SPECS[role].items() if b]
    own = F.when(F.col("metric").isin(*binary), F.col("p") * (1 - F.col("p")))
    if per_sample is not None:
        sums = sums.join(F.broadcast(per_sample), ["fgroup", "gender", "metric"], "left").withColumn("sigma2", F.coalesce(own, "sigma2"))
    else:
        sums = sums.withColumn("sigma2", own)
    some = lambda c: F.when(F.col("seasons") >= fewest, c)
    out = sums.withColumns({"tau2": some(_cov()), "r_half": some(correlation())}).withColumn("k", F.when(F.col("tau2") > 0, F.col("sigma2") / F.col("tau2")))
    return out.select(F.lit(role).alias("role"), "fgroup", "gender", "metric", "seasons", "p", "sigma2", "tau2", "k", "r_half", (2 * F.col("r_half") / F.nullif(1 + F.col("r_half"), F.lit(0.0))).alias("r"), "typical", (F.col("typical") / (F.col("typical") + F.col("k"))).alias("reliability"))


def report(innings: DataFrame, role: str, least: float = 1, per_sample: DataFrame | None = None, limits: dict[str, float] | None = None, fewest: int = FEWEST) -> DataFrame:
    """stability() of the qualified seasons, with pairs and yoy (the correlation of a year's rate with the
    next one's, both qualified) and verdict, what the figures say in words."""
    limits = limits_of(role) if limits is None else limits
    rows = seasons(innings, role)
    pairs = next_year(yearly(rows, least).filter(enough(F.col("n"), limits)))
    years = pairs.groupBy("fgroup", "gender", "metric").agg(F.count("*").alias("pairs"), *(c.alias(k) for k, c in weighted("w", "rate", "rate2").items()))
    years = years.select("fgroup", "gender", "metric", "pairs", F.when(F.col("pairs") >= fewest, correlation()).alias("yoy"))
    out = stability(innings, role, least, per_sample, limits, fewest).join(years, ["fgroup", "gender", "metric"], "left")
    return out.withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("verdict", reliability_words(F.col("reliability")))


def reliability_words(reliability: Column) -> Column:
    return F.when(reliability >= 0.7, "mostly skill").when(reliability >= 0.5, "more skill than luck").when(reliability >= 0.3, "more luck than skill").when(reliability.isNotNull(), "mostly luck").otherwise("not to be told")


def sample_variance(balls: DataFrame) -> DataFrame:
    """(fgroup, gender, metric, sigma2): variance of runs per faced ball, and of runs per shot in play."""
    from tallyline.functions.flags import in_play

    out = balls.groupBy("fgroup", "gender").agg(F.var_pop(F.when(F.col("faced"), F.col("runs_batter")).cast("double")).alias("runs"), F.var_pop(F.when(in_play(), F.col("runs_batter")).cast("double")).alias("inplay"))
    return out.unpivot(["fgroup", "gender"], ["runs", "inplay"], "metric", "sigma2")


def yearly(rows: DataFrame, least: float = LEAST_HALF) -> DataFrame:
    return rows.groupBy("fgroup", "gender", "player", "metric", "yr").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).filter(F.col("n") >= least).withColumn("rate", F.col("x") / F.col("n"))


def next_year(years: DataFrame) -> DataFrame:
    """Pairs of consecutive years of a player: n, rate, n2, rate2 and the harmonic weight. A gap makes no pair,
    nor does an unknown player or group. years: a row for each player, metric and year, read once."""
    key = ["fgroup", "gender", "player", "metric"]
    order = Window.partitionBy(*key).orderBy("yr")
    known = years.dropna(subset=[*key, "yr"]).select(*key, "yr", *(c for c in years.columns if c not in (*key, "yr")))
    pairs = known.withColumns({"n2": F.lead("n").over(order), "rate2": F.lead("rate").over(order), "_next": F.lead("yr").over(order)}).filter(F.col("_next") == F.col("yr") + 1).drop("_next")
    return pairs.withColumn("w", F.col("n") * F.col("n2") / (F.col("n") + F.col("n2")))


def year_to_year(innings: DataFrame, role: str, least: float = LEAST_HALF) -> DataFrame:
    pairs = next_year(yearly(seasons(innings, role), least))
    return pairs.groupBy("fgroup", "gender", "metric").agg(F.count("*").alias("pairs"), *(c.alias(k) for k, c in weighted("w", "rate", "rate2").items())).select("fgroup", "gender", "metric", "pairs", correlation().alias("r"))


def prediction(pairs: DataFrame, predictor: str, target: str = "rate2") -> DataFrame:
    """(fgroup, gender, metric): weighted RMSE of predicting next year's rate by a line in `predictor`.
    Folds by the year's parity: each fold is predicted with the other one's line."""
    key = ["fgroup", "gender", "metric"]
    rows = pairs.withColumn("fold", F.pmod("yr", F.lit(2)))
    sums = rows.groupBy(*key, "fold").agg(*(c.alias(k) for k, c in weighted("w", predictor, target).items()))
    line = sums.select(*key, (1 - F.col("fold")).alias("fold"), F.coalesce(slope(), F.lit(0.0)).alias("b"), (F.col("sx") / F.col("sw")).alias("mx"), (F.col("sy") / F.col("sw")).alias("my"))
    error = F.col(target) - (F.col("my") + F.col("b") * (F.col(predictor) - F.col("mx")))
    return rows.join(F.broadcast(line), [*key, "fold"]).groupBy(*key).agg(F.count("*").alias("pairs"), F.sqrt(F.sum(F.col("w") * error * error) / F.sum("w")).alias("rmse"))


def predictors(pairs: DataFrame, candidates: dict[str, Column], target: str = "rate2") -> DataFrame:
    """(fgroup, gender, metric, predictor): prediction()'s pairs and rmse, the correlation r with the
    target, and gain, the share of the error of the league average (no predictor) that is saved. All
    candidates go through one aggregation as rows."""
    key = ["fgroup", "gender", "metric", "predictor"]
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), c.cast("double").alias("x")) for n, c in ({"league average": F.lit(0.0)} | candidates).items())))
    rows = pairs.select(*key[:3], F.pmod("yr", F.lit(2)).alias("fold"), target, "w", every.alias("p")).select(*key[:3], "fold", target, "w", "p.*")
    sums = rows.groupBy(*key, "fold").agg(*(c.alias(k) for k, c in weighted("w", "x", target).items()))
    line = sums.select(*key, (1 - F.col("fold")).alias("fold"), F.coalesce(slope(), F.lit(0.0)).alias("b"), (F.col("sx") / F.col("sw")).alias("mx"), (F.col("sy") / F.col("sw")).alias("my"))
    error = F.col(target) - (F.col("my") + F.col("b") * (F.col("x") - F.col("mx")))
    sums = {"pairs": F.count("*"), "rmse": F.sqrt(F.sum(F.col("w") * error * error) / F.sum("w"))} | weighted("w", "x", target)
    out = rows.join(line, [*key, "fold"]).groupBy(*key).agg(*(c.alias(k) for k, c in sums.items()))
    base = F.max(F.when(F.col("predictor") == "league average", F.col("rmse"))).over(Window.partitionBy("fgroup", "gender", "metric"))
    return out.select(*key, "pairs", "rmse", correlation().alias("r"), (1 - F.col("rmse") / F.nullif(base, F.lit(0.0))).alias("gain"))


def finding(gain: Column, r: Column) -> Column:
    """What a predictor's figures say, in words."""
    worth = F.when(gain >= 0.1, "says a good deal").when(gain >= 0.02, "says a little").otherwise("says no more than the league average")
    return F.concat(worth, F.lit(" (r "), F.coalesce(F.format_number(r, 2), F.lit("-")), F.lit(")"))


def shrinkage(years: DataFrame, stable: DataFrame) -> DataFrame:
    """Adds shrunk, the rate drawn to the group's mean by K (see stability)."""
    k = stable.select("fgroup", "gender", "metric", "p", "k")
    return years.join(F.broadcast(k), ["fgroup", "gender", "metric"]).withColumn("shrunk", F.when(F.col("k").isNull(), F.col("p")).otherwise((F.col("x") + F.col("k") * F.col("p")) / (F.col("n") + F.col("k"))))
