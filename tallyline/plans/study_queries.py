"""Queries of the reliability study: qualified seasons, reports in words, and metrics by the study's constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions.metrics import get
from tallyline.operators import derive, engine, study

from . import ledger
from .ledger_queries import _r, rounded
from .registry import register
from .view_queries import _COV, _MINE, _SEASONS, _SUMS, _VX, _VY, _YEARS, _bowl, _pairs

#: The driver's tables have few balls a season.
LIMITS, FEWEST = {"T20": 9.0, "ODI": 10.0, "MULTI": 12.0}, 4
_LIMIT = "CASE fgroup WHEN 'T20' THEN 9 WHEN 'ODI' THEN 10 WHEN 'MULTI' THEN 12 END"
_STABLE = (
    _SEASONS + f", h AS (SELECT fgroup, gender, player, yr, metric, sum(n) FILTER (half = 0) AS na, sum(n) FILTER (half = 1) AS nb, sum(x) FILTER (half = 0) AS xa, sum(x) FILTER (half = 1) AS xb FROM seasons GROUP BY ALL HAVING na >= 1 AND nb >= 1 AND na + nb >= {_LIMIT}), "
    "g AS (SELECT fgroup, gender, metric, count(*) AS seasons, sum(xa + xb) / sum(na + nb) AS p, median(na + nb) AS typical, " + _SUMS("a", "b") + " FROM (SELECT *, xa / na AS a, xb / nb AS b, na * nb / (na + nb) AS w FROM h) GROUP BY ALL), "
    f"st AS (SELECT fgroup, gender, metric, seasons, typical, CASE WHEN seasons >= {FEWEST} AND {_COV} > 0 THEN p * (1 - p) / {_COV} END AS k, CASE WHEN seasons >= {FEWEST} AND {_VX} * {_VY} > 0 THEN {_COV} / sqrt({_VX} * {_VY}) END AS r_half FROM g), "
    f"q AS (SELECT fgroup, gender, player, metric, yr, sum(n) AS n, sum(x) / sum(n) AS rate FROM seasons GROUP BY ALL HAVING sum(n) >= 1 AND sum(n) >= {_LIMIT}), "
    "y AS (SELECT fgroup, gender, metric, count(*) AS pairs, " + _SUMS("rate", "rate2") + " FROM (SELECT a.*, b.rate AS rate2, a.n * b.n / (a.n + b.n) AS w FROM q a JOIN q b ON a.fgroup = b.fgroup AND a.gender = b.gender AND a.player = b.player AND a.metric = b.metric AND b.yr = a.yr + 1) GROUP BY ALL)\n"
)


@register("study_report", ledger.sql(_STABLE + f"""SELECT st.fgroup, st.gender, st.metric, seasons, round(k) AS k, {_r('2 * r_half / nullif(1 + r_half, 0)', 'r')}, {_r('typical / (typical + k)', 'reliability')}, coalesce(pairs, 0) AS pairs, {_r(f'CASE WHEN pairs >= {FEWEST} AND {_VX} * {_VY} > 0 THEN {_COV} / sqrt({_VX} * {_VY}) END', 'yoy')},
  CASE WHEN typical / (typical + k) >= 0.7 THEN 'mostly skill' WHEN typical / (typical + k) >= 0.5 THEN 'more skill than luck' WHEN typical / (typical + k) >= 0.3 THEN 'more luck than skill' WHEN k IS NOT NULL THEN 'mostly luck' ELSE 'not to be told' END AS verdict
FROM st LEFT JOIN y ON st.fgroup = y.fgroup AND st.gender = y.gender AND st.metric = y.metric""", bowling=True))
def study_report(spark, sf_dir):
    found = _MINE(study.report(_bowl(spark, sf_dir), "bowling", limits=LIMITS, fewest=FEWEST)).withColumn("k", F.round("k"))
    return rounded(found.select("fgroup", "gender", "metric", "seasons", "k", "r", "reliability", "pairs", "yoy", "verdict"))


_BY_K = "(sum({x}) + sum({n} * {k}) / sum({n}) * sum({e}) / nullif(sum({n}), 0)) / nullif(sum({n}) + sum({n} * {k}) / sum({n}), 0)"


@register("regressed_by_study", ledger.sql(_STABLE.rstrip() + """, kk AS (SELECT b.*, coalesce(d.k, d2.k) AS kd, coalesce(w.k, w2.k) AS kw FROM bowling b LEFT JOIN st d ON d.fgroup = b.fgroup AND d.gender = b.gender AND d.metric = 'dot' LEFT JOIN st d2 ON d2.fgroup = b.fgroup AND d2.gender = 'BUILDING' AND d2.metric = 'dot'
  LEFT JOIN st w ON w.fgroup = b.fgroup AND w.gender = b.gender AND w.metric = 'wickets' LEFT JOIN st w2 ON w2.fgroup = b.fgroup AND w2.gender = 'BUILDING' AND w2.metric = 'wickets')\n""" +
    f"SELECT player, fgroup, count(*) AS n, {_r('100 * ' + _BY_K.format(x='n_dot', e='x_dot', n='deliveries', k='kd'), 'regressed_dot_pct')}, {_r('1 / nullif(' + _BY_K.format(x='wickets', e='e_wkts', n='balls', k='kw') + ', 0)', 'regressed_strike_rate')} FROM kk GROUP BY ALL", bowling=True))
def regressed_by_study(spark, sf_dir):
    """Each innings carries the constants that the study finds for its format and gender."""
    bowling = _bowl(spark, sf_dir)
    plain = bowling.drop(*(c for c in bowling.columns if c.startswith("k_")))
    stable = study.stability(bowling, "bowling", 1, limits=LIMITS, fewest=FEWEST)
    rows = derive.attach_k(plain, stable, "bowling", default_gender="BUILDING")
    return rounded(rows.groupBy("player", "fgroup").agg(F.count("*").alias("n"), get("bowling", "regressed_dot_pct").column(), get("bowling", "regressed_strike_rate").column()))


@register("study_gain", ledger.sql(_SEASONS + _YEARS + ", v AS (SELECT fgroup, gender, metric, yr % 2 AS half, rate2, w, 'league average' AS predictor, 0.0::DOUBLE AS x FROM pairs UNION ALL SELECT fgroup, gender, metric, yr % 2, rate2, w, 'this season', rate FROM pairs), ln AS (SELECT fgroup, gender, metric, predictor, 1 - half AS half, coalesce(CASE WHEN " + f"{_VX} <> 0 THEN {_COV} / {_VX} END" + ", 0) AS b, sx / sw AS mx, sy / sw AS my FROM (SELECT fgroup, gender, metric, predictor, half, " + _SUMS("x", "rate2") + " FROM v GROUP BY ALL)), e AS (SELECT fgroup, gender, metric, predictor, sqrt(sum(w * (rate2 - (my + b * (x - mx))) ** 2) / sum(w)) AS rmse, " + _SUMS("x", "rate2") + " FROM v JOIN ln USING (fgroup, gender, metric, predictor, half) GROUP BY ALL), f AS (SELECT *, " + f"CASE WHEN {_VX} * {_VY} > 0 THEN {_COV} / sqrt({_VX} * {_VY}) END AS r, 1 - rmse / nullif(max(CASE WHEN predictor = 'league average' THEN rmse END) OVER (PARTITION BY fgroup, gender, metric), 0) AS gain FROM e)\n" + f"SELECT fgroup, gender, metric, predictor, {_r('r', 'r')}, {_r('gain', 'gain')}, CASE WHEN gain >= 0.1 THEN 'says a good deal' WHEN gain >= 0.02 THEN 'says a little' ELSE 'says no more than the league average' END AS words FROM f", bowling=True))
def study_gain(spark, sf_dir):
    rows = study.predictors(_pairs(spark, sf_dir), {"this season": F.col("rate")}).withColumn("words", F.regexp_extract(study.finding(F.col("gain"), F.col("r")), r"^([^(]*) \(", 1))
    return rounded(rows.select("fgroup", "gender", "metric", "predictor", "r", "gain", "words"))


@register("split_named", ledger.sql(f"SELECT innings::VARCHAR AS innings_no, count(*)::DOUBLE AS innings, {_r('6.0 * sum(runs) / nullif(sum(balls), 0)', 'economy')} FROM bowling WHERE player = 'Brand#11' GROUP BY 1", bowling=True))
def split_named(spark, sf_dir):
    """A split's column bears the split's name, and gives way to a metric of that name."""
    tables = ledger.tables(spark, sf_dir)
    rows = engine.query_stats(tables, "bowling", ["innings", "economy"], players=["Brand#11"], split_by="innings", named=True)
    return rounded(rows.select("innings_no", "innings", "economy"))
