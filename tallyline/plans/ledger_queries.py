"""Queries over the driver's tables seen as a ledger: state, innings tables, metrics, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import dimensions, flags
from tallyline.functions.metrics import REGISTRY
from tallyline.functions.scope import build as scope_of
from tallyline.operators import derive, engine

from . import ledger
from .registry import register


TINY = 1e-9


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show (a little above the exact halves
    that short decimals often are); counts as bigint."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(F.col(c) + TINY, places).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns))


def _r(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE + {TINY}, 4) AS {name}"


# --- minimum slice -------------------------------------------------------------------------------------


@register(
    "leaderboard_rate_qualified",
    """WITH q AS (SELECT l_suppkey, count(*) AS sample, sum((l_returnflag = 'R')::INT)::BIGINT AS events FROM lineitem GROUP BY 1),
    t AS (SELECT *, round(100.0 * events / sample, 4) AS rate, max(sample) OVER () AS top FROM q)
    SELECT row_number() OVER (ORDER BY rate DESC, sample DESC, l_suppkey)::BIGINT AS rank, l_suppkey AS supplier, n_name AS nation, sample, events, rate
    FROM t JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE sample >= greatest(30, 0.1 * top) ORDER BY rate DESC, sample DESC, supplier LIMIT 10""",
)
def leaderboard_rate_qualified(spark, sf_dir):
    lines = ledger.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("sample"), F.count_if(F.col("l_returnflag") == "R").alias("events"))
    names = ledger.table(spark, sf_dir, "supplier").join(ledger.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("nation"))
    rows = engine.qualified(lines, "sample").withColumn("rate", F.round(100.0 * F.col("events") / F.col("sample"), 4)).join(names, "supplier")
    order = [F.desc("rate"), F.desc("sample"), F.col("supplier")]
    top = rows.orderBy(*order).limit(10)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "supplier", "nation", "sample", "events", "rate")


# --- running state and derived tables ----------------------------------------------------------------------


@register("running_state", ledger.sql("SELECT match_id, innings, seq, score, wkts, ball_no, state_over FROM states"))
def running_state(spark, sf_dir):
    return rounded(ledger.states(spark, sf_dir).select("match_id", "innings", "seq", "score", "wkts", "ball_no", "state_over"))


@register("ball_flags", ledger.sql("SELECT fgroup, phase, sum(faced::INT)::BIGINT AS faced, sum(legal::INT)::BIGINT AS legal, sum(wide::INT)::BIGINT AS wides, sum(noball::INT)::BIGINT AS noballs, sum(four::INT)::BIGINT AS fours, sum(six::INT)::BIGINT AS sixes, sum(dot::INT)::BIGINT AS dots, sum(bowler_runs)::BIGINT AS bowler_runs, sum(credited)::BIGINT AS credited, sum(outs)::BIGINT AS outs, sum(in_play::INT)::BIGINT AS inplay FROM balls GROUP BY ALL"))
def ball_flags(spark, sf_dir):
    n = lambda c, name: F.count_if(c).alias(name)
    c = F.col
    return ledger.balls(spark, sf_dir).groupBy("fgroup", "phase").agg(n(c("faced"), "faced"), n(c("legal"), "legal"), n(c("wide"), "wides"), n(c("noball"), "noballs"), n(c("four"), "fours"), n(c("six"), "sixes"), n(c("dot"), "dots"), F.sum("bowler_runs").alias("bowler_runs"), F.sum("credited").alias("credited"), F.sum("outs").alias("outs"), n(flags.in_play(), "inplay"))


@register("expectation_fallback", ledger.sql(f"SELECT fgroup, gender, innings, state_over, wkts, yr, n::BIGINT AS n, {_r('e_runs', 'e_runs')}, {_r('e_outs', 'e_outs')}, {_r('e_bowl_runs', 'e_bowl_runs')}, {_r('e_bowl_wkts', 'e_bowl_wkts')}, {_r('x_bat_ct_field', 'x_bat_ct_field')}, {_r('x_bowl_dot', 'x_bowl_dot')} FROM expectation", expectation=True))
def expectation_fallback(spark, sf_dir):
    return rounded(derive.expectation(ledger.states(spark, sf_dir), ledger.THIN).select(*derive.CELL, "yr", "n", "e_runs", "e_outs", "e_bowl_runs", "e_bowl_wkts", "x_bat_ct_field", "x_bowl_dot"))


@register("above_expected", ledger.sql(f"SELECT batter, count(*) AS n, {_r('sum(CASE WHEN faced THEN runs_batter - e_runs END)', 'above')} FROM fullballs GROUP BY 1", expectation=True))
def above_expected(spark, sf_dir):
    f = ledger.full(spark, sf_dir)
    return rounded(f.groupBy("batter").agg(F.count("*").alias("n"), F.sum(F.when(F.col("faced"), F.col("runs_batter") - F.col("e_runs"))).alias("above")))


@register("arrival_position", ledger.sql("SELECT match_id, innings, player, position, entry_over, entry_score, entry_wkts, team FROM app", batting=True))
def arrival_position(spark, sf_dir):
    return rounded(derive.appearances(ledger.states(spark, sf_dir)).select("match_id", "innings", "player", "position", "entry_over", "entry_score", "entry_wkts", "team"))


_BAT_COLUMNS = ("match_id", "innings", "player", "position", "balls", "runs", "fours", "sixes", "dots", "balls_first5", "runs_first5", "out", "kind", "inplay_runs", "n_ct_field", "n_bowled", "e_runs", "e_outs", "e_first5", "x_ct_field", "x_inplay_runs", "mc_runs", "mc_outs", "era_runs", "era_outs")
_DOUBLES = ("e_runs", "e_outs", "e_first5", "x_ct_field", "x_inplay_runs", "mc_runs", "mc_outs", "mc_wkts", "era_runs", "era_outs", "e_wkts", "x_dot")
_TEXTS = ("player", "kind", "team", "opposition", "phase")
_columns_sql = lambda names: ", ".join(_r(c, c) if c in _DOUBLES else c if c in _TEXTS else f"{c}::BIGINT AS {c}" for c in names)


@register("batting_innings", ledger.sql(f"SELECT {_columns_sql(_BAT_COLUMNS)} FROM batting", batting=True))
def batting_innings(spark, sf_dir):
    return rounded(ledger.tables(spark, sf_dir)["batting_innings"].select(*_BAT_COLUMNS))


_BOWL_COLUMNS = ("match_id", "innings", "player", "deliveries", "balls", "runs", "wickets", "maidens", "fours", "dots", "inplay_runs", "n_ct_keeper", "n_run_out", "e_runs", "e_wkts", "x_dot", "mc_runs", "mc_wkts", "team", "opposition")


@register("bowling_innings", ledger.sql(f"SELECT {_columns_sql(_BOWL_COLUMNS)} FROM bowling", bowling=True))
def bowling_innings(spark, sf_dir):
    return rounded(ledger.tables(spark, sf_dir)["bowling_innings"].select(*_BOWL_COLUMNS))


@register("batting_phase", ledger.sql(f"""SELECT coalesce(f.match_id, o.match_id) AS match_id, coalesce(f.innings, o.innings)::BIGINT AS innings, coalesce(f.player, o.player) AS player, coalesce(f.phase, o.phase) AS phase, coalesce(f.balls, 0)::BIGINT AS balls, coalesce(f.runs, 0)::BIGINT AS runs, coalesce(o.out, 0)::BIGINT AS out, {_r('coalesce(f.e_runs, 0)', 'e_runs')}
    FROM (SELECT * FROM ({ledger._facing(', phase')}) WHERE phase IS NOT NULL AND balls > 0) f FULL JOIN (SELECT match_id, innings, player_out AS player, phase, 1 AS out FROM gone WHERE phase IS NOT NULL GROUP BY ALL) o ON f.match_id = o.match_id AND f.innings = o.innings AND f.player = o.player AND f.phase = o.phase""", batting=True))  # fmt: skip
def batting_phase(spark, sf_dir):
    return rounded(ledger.tables(spark, sf_dir)["batting_phase"].select("match_id", "innings", "player", "phase", "balls", "runs", "out", "e_runs"))


@register("bowling_phase", ledger.sql(f"SELECT {_columns_sql(('match_id', 'innings', 'player', 'phase', 'deliveries', 'balls', 'runs', 'wickets', 'e_runs'))} FROM ({ledger._bowling(', phase')}) WHERE phase IS NOT NULL", bowling=True))
def bowling_phase(spark, sf_dir):
    return rounded(ledger.tables(spark, sf_dir)["bowling_phase"].select("match_id", "innings", "player", "phase", "deliveries", "balls", "runs", "wickets", "e_runs"))


@register("maidens", ledger.sql("SELECT match_id, innings::BIGINT AS innings, bowler, sum((legal >= 6 AND runs = 0)::INT)::BIGINT AS maidens FROM (SELECT match_id, innings, bowler, ovr, sum(legal::INT) AS legal, sum(bowler_runs) AS runs FROM balls GROUP BY ALL) GROUP BY ALL"))
def maidens(spark, sf_dir):
    return rounded(derive.maidens(ledger.balls(spark, sf_dir)))


@register("era_range", ledger.sql(f"SELECT gender, fgroup, position::BIGINT AS position, yr::BIGINT AS yr, {_r('era_runs', 'era_runs')}, {_r('era_outs', 'era_outs')} FROM era", batting=True))
def era_range(spark, sf_dir):
    return rounded(derive.era_baseline(ledger.tables(spark, sf_dir)["batting_in_place"]).select("gender", "fgroup", "position", "yr", "era_runs", "era_outs"))


# --- the metric registry -----------------------------------------------------------------------------------

_reg = lambda x, e, n, k: f"((sum({x}) + 200.0 * sum({e}) / nullif(sum({n}), 0)) / nullif(sum({n}) + 200.0, 0))"
_FR = f"(sum(runs) - sum(inplay_runs) + CASE WHEN sum(n_inplay) = 0 THEN NULL ELSE sum(n_inplay) * {_reg('inplay_runs', 'x_inplay_runs', 'n_inplay', 'k')} END)"
_FO = f"(sum(out) - sum(n_ct_field) + sum(balls) * {_reg('n_ct_field', 'x_ct_field', 'balls', 'k')})"
_LUCKY = f"(sum(deliveries) * {_reg('n_ct_field', 'x_ct_field', 'deliveries', 'k')})"
_FW = f"(sum(wickets) - sum(n_ct_field) + {_LUCKY})"
_AVG, _EDGE = "(sum(runs)::DOUBLE / nullif(sum(out), 0))", "(sum(fours) + sum(sixes))"
_BAVG = "(sum(runs)::DOUBLE / nullif(sum(wickets), 0))"
_WIN = "100.0 * sum((result = 'won')::INT) / nullif(sum((result IN ('won', 'lost'))::INT), 0)"
METRIC_SQL = {
    "batting": {
        "matches": "count(DISTINCT match_id)", "innings": "count(*)", "not_outs": "count(*) - sum(out)", "dismissals": "sum(out)", "runs": "sum(runs)", "balls": "sum(balls)", "average": _AVG, "strike_rate": "100.0 * sum(runs) / nullif(sum(balls), 0)",
        "highest": "arg_max(runs || CASE WHEN out = 0 THEN '*' ELSE '' END, 2 * runs + CASE WHEN out = 0 THEN 1 ELSE 0 END)", "hundreds": "sum((runs >= 100)::INT)", "fifties": "sum((runs BETWEEN 50 AND 99)::INT)", "ducks": "sum((runs = 0 AND out = 1)::INT)", "fours": "sum(fours)", "sixes": "sum(sixes)",
        "dot_pct": "100.0 * sum(dots) / nullif(sum(balls), 0)", "boundary_pct": f"100.0 * {_EDGE} / nullif(sum(balls), 0)", "boundary_runs_pct": "100.0 * (4 * sum(fours) + 6 * sum(sixes)) / nullif(sum(runs), 0)", "balls_per_boundary": f"sum(balls)::DOUBLE / nullif({_EDGE}, 0)", "balls_per_six": "sum(balls)::DOUBLE / nullif(sum(sixes), 0)",
        "balls_per_dismissal": "sum(balls)::DOUBLE / nullif(sum(out), 0)", "runs_per_innings": "sum(runs)::DOUBLE / count(*)", "conversion_pct": "100.0 * sum((runs >= 100)::INT) / nullif(sum((runs >= 50)::INT), 0)", "thirty_plus_pct": "100.0 * avg((runs >= 30)::INT)", "median_score": "median(runs)", "consistency_cv": "stddev_samp(runs) / nullif(avg(runs), 0)",
        "expected_sr": "100 * sum(e_runs) / nullif(sum(balls), 0)", "true_sr": "100.0 * sum(runs) / nullif(sum(balls), 0) - 100 * sum(e_runs) / nullif(sum(balls), 0)", "expected_average": "sum(e_runs) / nullif(sum(e_outs), 0)", "true_average": f"{_AVG} - sum(e_runs) / nullif(sum(e_outs), 0)", "runs_above_expected": "sum(runs) - sum(e_runs)", "rae_per_innings": "(sum(runs) - sum(e_runs)) / count(*)",
        "match_factor": f"{_AVG} / nullif(sum(mc_runs) / nullif(sum(mc_outs), 0), 0)", "era_factor": f"{_AVG} / nullif(sum(era_runs) / nullif(sum(era_outs), 0), 0)", "first5_sr": "100.0 * sum(runs_first5) / nullif(sum(balls_first5), 0)", "true_first5_sr": "100 * (sum(runs_first5) - sum(e_first5)) / nullif(sum(balls_first5), 0)",
        "fib_average": f"{_FR} / nullif({_FO}, 0)", "fib_sr": f"100 * {_FR} / nullif(sum(balls), 0)", "runs_luck": f"sum(runs) - {_FR}", "dismissal_luck": f"{_FO} - sum(out)",
        "regressed_sr": f"100 * {_reg('runs', 'e_runs', 'balls', 'k')}", "regressed_average": f"{_reg('runs', 'e_runs', 'balls', 'k')} / nullif({_reg('out', 'e_outs', 'balls', 'k')}, 0)", "regressed_dot_pct": f"100 * {_reg('n_dot', 'x_dot', 'balls', 'k')}", "regressed_boundary_pct": f"100 * {_reg('n_four + n_six', 'x_four + x_six', 'balls', 'k')}",
        "avg_position": "avg(position)", "avg_entry_over": "avg(entry_over) + 1", "avg_entry_wickets": "avg(entry_wkts)", "team_win_pct": _WIN,
    },
    "bowling": {
        "matches": "count(DISTINCT match_id)", "innings": "count(*)", "balls": "sum(balls)", "runs": "sum(runs)", "wickets": "sum(wickets)", "average": _BAVG, "economy": "6.0 * sum(runs) / nullif(sum(balls), 0)", "strike_rate": "sum(balls)::DOUBLE / nullif(sum(wickets), 0)", "best": "arg_max(wickets || '/' || runs, 100000 * wickets - runs)",
        "four_wkt_hauls": "sum((wickets >= 4)::INT)", "five_wkt_hauls": "sum((wickets >= 5)::INT)", "maidens": "sum(maidens)", "dot_pct": "100.0 * sum(dots) / nullif(sum(balls), 0)", "boundary_pct": f"100.0 * {_EDGE} / nullif(sum(balls), 0)", "balls_per_boundary": f"sum(balls)::DOUBLE / nullif({_EDGE}, 0)", "wickets_per_innings": "sum(wickets)::DOUBLE / count(*)",
        "expected_economy": "6 * sum(e_runs) / nullif(sum(balls), 0)", "true_economy": "6 * sum(e_runs) / nullif(sum(balls), 0) - 6.0 * sum(runs) / nullif(sum(balls), 0)", "expected_wickets": "sum(e_wkts)", "true_wickets": "sum(wickets) - sum(e_wkts)", "runs_saved": "sum(e_runs) - sum(runs)", "match_factor": f"(sum(mc_runs) / nullif(sum(mc_wkts), 0)) / nullif({_BAVG}, 0)",
        "fib_economy": f"6 * {_FR} / nullif(sum(balls), 0)", "fib_wickets": _FW, "fib_average": f"{_FR} / nullif({_FW}, 0)", "fib_strike_rate": f"sum(balls) / nullif({_FW}, 0)", "wicket_luck": f"sum(n_ct_field) - {_LUCKY}", "runs_luck": f"{_FR} - sum(runs)", "inplay_runs_per_shot": "sum(inplay_runs)::DOUBLE / nullif(sum(n_inplay), 0)",
        "bowled_lbw_pct": "100.0 * (sum(n_bowled) + sum(n_lbw)) / nullif(sum(deliveries), 0)", "caught_behind_pct": "100.0 * sum(n_ct_keeper) / nullif(sum(deliveries), 0)", "caught_field_pct": "100.0 * sum(n_ct_field) / nullif(sum(deliveries), 0)",
        "regressed_economy": f"6 * {_reg('runs', 'e_runs', 'balls', 'k')}", "regressed_strike_rate": f"1 / nullif({_reg('wickets', 'e_wkts', 'balls', 'k')}, 0)", "regressed_average": f"{_reg('runs', 'e_runs', 'balls', 'k')} / nullif({_reg('wickets', 'e_wkts', 'balls', 'k')}, 0)", "regressed_dot_pct": f"100 * {_reg('n_dot', 'x_dot', 'deliveries', 'k')}", "regressed_boundary_pct": f"100 * {_reg('n_four + n_six', 'x_four + x_six', 'deliveries', 'k')}", "team_win_pct": _WIN,
    },
}


def metric_sql(role: str, names=None) -> str:
    return ", ".join(f"{e} AS {m}" if REGISTRY[role][m].kind == "text" else _r(e, m) for m, e in METRIC_SQL[role].items() if names is None or m in names)


def _registry_query(role: str, family: str) -> None:
    names = [m.id for m in REGISTRY[role].values() if m.family == family]

    @register(f"metrics_{role}_{family.replace(' ', '_').replace('-', '_')}", ledger.sql(f"SELECT player, {metric_sql(role, names)} FROM {role} GROUP BY player", **{role: True}))
    def query(spark, sf_dir):
        # Made where the balls lie: the era's means and the players' sums each pass them, and neither moves them.
        return rounded(ledger.tables(spark, sf_dir)[f"{role}_in_place"].groupBy("player").agg(*(REGISTRY[role][m].column() for m in names)))


for _role, _metrics in REGISTRY.items():
    for _family in dict.fromkeys(m.family for m in _metrics.values()):
        _registry_query(_role, _family)

# --- splits by every dimension ----------------------------------------------------------------------------------

_DIMENSION_SQL = {
    "season": "season", "year": "yr::VARCHAR", "format": "format", "competition": "coalesce(event, 'Bilateral / other')", "team": "team", "opposition": "opposition", "venue": "trim(replace(split_part(venue, ',', 1), '.', ''))", "innings": "innings::VARCHAR",
    "chase": "CASE WHEN fgroup = 'MULTI' THEN 'innings ' || innings WHEN innings = 1 THEN 'setting' ELSE 'chasing' END", "result": "result", "position": "position::VARCHAR", "entry_wickets": "CASE WHEN entry_wkts >= 5 THEN '5+' ELSE entry_wkts::VARCHAR END",
    "entry_phase": "CASE fgroup WHEN 'T20' THEN CASE WHEN entry_over < 6 THEN 'early' WHEN entry_over < 15 THEN 'middle' ELSE 'late' END WHEN 'ODI' THEN CASE WHEN entry_over < 10 THEN 'early' WHEN entry_over < 40 THEN 'middle' ELSE 'late' END ELSE CASE WHEN entry_over < 20 THEN 'early' WHEN entry_over < 60 THEN 'middle' ELSE 'late' END END", "dismissal": "coalesce(kind, 'not out')",
}


def _split_query(role: str, dimension: str) -> None:
    names = ("innings", "balls", "average", "strike_rate") if role == "batting" else ("innings", "balls", "economy", "wickets")

    @register(f"split_{role}_by_{dimension}", ledger.sql(f"SELECT coalesce({_DIMENSION_SQL[dimension]}, 'n/a') AS k, {metric_sql(role, names)} FROM {role} GROUP BY 1", **{role: True}))
    def query(spark, sf_dir):
        table = ledger.tables(spark, sf_dir)[f"{role}_innings"]
        return rounded(table.groupBy(dimensions.key(dimension).alias("k")).agg(*(REGISTRY[role][m].column() for m in names)))


for _d in _DIMENSION_SQL:
    _split_query("batting", _d)
for _d in ("season", "competition", "chase", "result"):
    _split_query("bowling", _d)
