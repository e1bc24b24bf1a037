"""Queries: the engine's views, scopes and the ball-level figures over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions.scope import build as scope_of
from tallyline.operators import ballstats, engine, models, study
from tallyline.sources.matches import upsert
from tallyline.sources.stored import cut

from . import ledger
from .ledger_queries import TINY, _r, metric_sql, rounded
from .registry import register

# --- leaderboards and views ---------------------------------------------------------------------------------


def _board(role: str, metrics: tuple, sort: str, better: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY s {better} NULLS LAST, sample DESC, player)::BIGINT AS rank, * EXCLUDE (s, top) FROM (
      SELECT *, max(sample) OVER () AS top FROM (SELECT player, mode_team AS team, {", ".join(metrics)}, sample, first_date, last_date, {sort} AS s FROM (
        SELECT player, {metric_sql(role, metrics)}, sum(balls)::BIGINT AS sample, min(date) AS first_date, max(date) AS last_date FROM {role} GROUP BY player)
        JOIN (SELECT player, team AS mode_team FROM (SELECT player, team, count(*) AS c FROM {role} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY player ORDER BY c DESC, team) = 1) USING (player)))
      WHERE sample >= greatest(30, 0.1 * top) ORDER BY rank LIMIT 10"""


@register("leaderboard_batting_strike_rate", ledger.sql(_board("batting", ("innings", "runs", "strike_rate"), "strike_rate", "DESC"), batting=True))
def leaderboard_batting(spark, sf_dir):
    return rounded(engine.query_stats(ledger.tables(spark, sf_dir), "batting", ["innings", "runs", "strike_rate"], sort_by="strike_rate", limit=10))


@register("leaderboard_bowling_economy", ledger.sql(_board("bowling", ("innings", "wickets", "economy"), "economy", "ASC"), bowling=True))
def leaderboard_bowling(spark, sf_dir):
    return rounded(engine.query_stats(ledger.tables(spark, sf_dir), "bowling", ["innings", "wickets", "economy"], sort_by="economy", limit=10))


@register("query_stats_player_split", ledger.sql(f"SELECT season AS k, arg_max(team, team) AS team, {metric_sql('bowling', ('innings', 'balls', 'runs', 'wickets', 'average', 'economy'))}, sum(balls)::BIGINT AS sample, min(date) AS first_date, max(date) AS last_date FROM bowling WHERE player = 'Brand#11' AND team = 'NATION_1' GROUP BY 1", bowling=True))
def query_stats_player_split(spark, sf_dir):
    scope = scope_of("bowling", team="NATION_1")
    return rounded(engine.query_stats(ledger.tables(spark, sf_dir), "bowling", players=["Brand#11"], split_by="season", scope=scope))


@register("luck_leaderboard", ledger.sql(f"SELECT row_number() OVER (ORDER BY runs_luck DESC, sample DESC, player)::BIGINT AS rank, * FROM (SELECT player, {metric_sql('batting', ('innings', 'balls', 'runs_luck'))}, sum(balls)::BIGINT AS sample FROM batting GROUP BY player) ORDER BY rank LIMIT 10", batting=True))
def luck_leaderboard(spark, sf_dir):
    return rounded(engine.luck_leaderboard(ledger.tables(spark, sf_dir), "batting", limit=10).drop("team", "first_date", "last_date"))


@register("split_by_phase", ledger.sql(f"SELECT player, phase AS k, {metric_sql('bowling', ('balls', 'runs', 'wickets', 'economy', 'dot_pct'))} FROM ({ledger._bowling(', phase')}) WHERE phase IS NOT NULL GROUP BY ALL", bowling=True))
def split_by_phase(spark, sf_dir):
    rows = ledger.tables(spark, sf_dir)["bowling_phase"]
    from tallyline.functions.metrics import get

    return rounded(rows.groupBy("player", F.col("phase").alias("k")).agg(*(get("bowling", m).column() for m in ("balls", "runs", "wickets", "economy", "dot_pct"))))


_SCOPES = {
    "isin": ({"gender": ["BUILDING", "MACHINERY"], "format": ["T20", "ODI"]}, "gender IN ('BUILDING', 'MACHINERY') AND format IN ('T20', 'ODI')"),
    "years": ({"from_year": "1996", "to_year": 1999}, "yr BETWEEN 1996 AND 1999"),
    "season": ({"season": "1998"}, "season = '1998'"),
    "result_innings": ({"result": "wins", "innings": 2}, "result = 'won' AND innings = 2"),
    "position": ({"position": "openers"}, "position BETWEEN 1 AND 2"),
    "entry_wickets": ({"entry_wickets": "1+"}, "entry_wkts >= 1"),
    "entry_phase": ({"entry_phase": "early", "competition": "ASIA"}, "event = 'ASIA' AND ((fgroup = 'T20' AND entry_over < 6) OR (fgroup = 'ODI' AND entry_over < 10) OR (fgroup = 'MULTI' AND entry_over < 20))"),
    "team_opposition": ({"team": "NATION_1", "opposition": ["NATION_2", "NATION_3"]}, "team = 'NATION_1' AND opposition IN ('NATION_2', 'NATION_3')"),
}


def _scope_query(name: str) -> None:
    filters, where = _SCOPES[name]

    @register(f"scope_{name}", ledger.sql(f"SELECT fgroup, count(*) AS n, sum(runs)::BIGINT AS runs, sum(balls)::BIGINT AS balls, sum(out)::BIGINT AS outs FROM batting WHERE {where} GROUP BY 1", batting=True))
    def query(spark, sf_dir):
        rows = scope_of("batting", **filters).apply(ledger.tables(spark, sf_dir)["batting_innings"])
        return rounded(rows.groupBy("fgroup").agg(F.count("*").alias("n"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.sum("out").alias("outs")))


for _name in _SCOPES:
    _scope_query(_name)


@register("scope_positions", ledger.sql("SELECT position::BIGINT AS position, count(*) AS n, sum(runs)::BIGINT AS runs FROM batting WHERE position BETWEEN 4 AND 7 AND result = 'tied' AND entry_wkts BETWEEN 0 AND 2 GROUP BY 1", batting=True))
def scope_positions(spark, sf_dir):
    rows = scope_of("batting", order="middle order", match_result="tie", wickets_down="0-2").apply(ledger.tables(spark, sf_dir)["batting_innings"])
    return rounded(rows.groupBy("position").agg(F.count("*").alias("n"), F.sum("runs").alias("runs")))


@register("scope_drawn", ledger.sql("SELECT result, fgroup, count(*) AS n, sum(wickets)::BIGINT AS wickets FROM bowling WHERE result = 'drawn' GROUP BY ALL", bowling=True))
def scope_drawn(spark, sf_dir):
    rows = scope_of("bowling", result="draws").apply(ledger.tables(spark, sf_dir)["bowling_innings"])
    return rounded(rows.groupBy("result", "fgroup").agg(F.count("*").alias("n"), F.sum("wickets").alias("wickets")))


@register("ball_scope_bowling", ledger.sql(f", r AS (SELECT match_id, innings, team AS k, bowler AS player, sum(b) AS balls, sum(r) AS runs, sum(w) AS wickets FROM (SELECT match_id, innings, team, bowler, ovr, sum(legal::INT) AS b, sum(bowler_runs) AS r, sum(credited) AS w FROM balls WHERE opposition IN ('NATION_1', 'NATION_2') AND gender = 'BUILDING' AND phase = 'death' AND yr >= 1993 GROUP BY ALL) GROUP BY ALL)\nSELECT player, k, count(*) AS innings, sum(balls)::BIGINT AS balls, sum(runs)::BIGINT AS runs, sum(wickets)::BIGINT AS wickets, {_r('6.0 * sum(runs) / nullif(sum(balls), 0)', 'economy')} FROM r GROUP BY ALL"))
def ball_scope_bowling(spark, sf_dir):
    scope = scope_of("bowling", team=["NATION_1", "NATION_2"], gender="BUILDING", phase="death", since=1993)
    figures = ballstats.player_stats(ledger.balls(spark, sf_dir), "bowling", split_by="opposition", scope=scope)
    return rounded(figures.select("player", "k", "innings", "balls", "runs", "wickets", "economy"))


@register("ball_scope_batting", ledger.sql(f", mine AS (SELECT * FROM balls WHERE team = 'NATION_1' AND season = '1998'), there AS (SELECT DISTINCT match_id, innings, venue AS k, unnest([batter, non_striker]) AS player FROM mine), f AS (SELECT match_id, innings, venue AS k, batter AS player, sum(runs_batter) AS runs, sum(faced::INT) AS balls FROM mine GROUP BY ALL), o AS (SELECT DISTINCT match_id, innings, k, player, 1 AS out FROM (SELECT match_id, innings, venue AS k, player_out AS player FROM mine WHERE is_out UNION ALL SELECT match_id, innings, venue, non_striker FROM mine WHERE second_out))\nSELECT player, k, count(*) AS innings, (count(*) - coalesce(sum(out), 0))::BIGINT AS not_outs, coalesce(sum(runs), 0)::BIGINT AS runs, {_r('coalesce(sum(runs), 0)::DOUBLE / nullif(sum(out), 0)', 'average')} FROM there LEFT JOIN f USING (match_id, innings, k, player) LEFT JOIN o USING (match_id, innings, k, player) GROUP BY ALL"))
def ball_scope_batting(spark, sf_dir):
    scope = scope_of("batting", team="NATION_1", year="1998")
    figures = ballstats.player_stats(ledger.balls(spark, sf_dir), "batting", split_by="venue", scope=scope)
    return rounded(figures.select("player", "k", "innings", "not_outs", "runs", "average"))


@register("ball_compare", ledger.sql(f"SELECT bowler AS player, sum(legal::INT)::BIGINT AS balls, sum(bowler_runs)::BIGINT AS runs, sum(credited)::BIGINT AS wickets FROM balls WHERE bowler IN ('Brand#22', 'Brand#11') AND innings = 2 GROUP BY 1"))
def ball_compare(spark, sf_dir):
    rows = ballstats.compare(ledger.balls(spark, sf_dir), "bowling", ["Brand#22", "Brand#11"], scope_of("bowling", innings=2))
    return rounded(rows.select("player", "balls", "runs", "wickets"))


@register("scope_latest_season", ledger.sql("SELECT season, count(*) AS n, sum(runs)::BIGINT AS runs FROM bowling WHERE gender = 'BUILDING' AND season = (SELECT season FROM bowling WHERE gender = 'BUILDING' ORDER BY date DESC NULLS LAST, season DESC LIMIT 1) GROUP BY 1", bowling=True))
def scope_latest(spark, sf_dir):
    rows = ledger.tables(spark, sf_dir)["bowling_innings"]
    scope = scope_of("bowling", rows, gender="BUILDING", season="latest")
    return rounded(scope.apply(rows).groupBy("season").agg(F.count("*").alias("n"), F.sum("runs").alias("runs")))


_FORM_SQL = """SELECT player, match_id, innings, row_number() OVER o AS n, {rolling}, {to_date} FROM bowling
  WINDOW o AS (PARTITION BY player ORDER BY date, match_id, innings), r AS (PARTITION BY player ORDER BY date, match_id, innings ROWS 9 PRECEDING), t AS (PARTITION BY player ORDER BY date, match_id, innings ROWS UNBOUNDED PRECEDING)"""


@register("rolling_form", ledger.sql(_FORM_SQL.format(rolling=_r("6.0 * sum(runs) OVER r / nullif(sum(balls) OVER r, 0)", "rolling"), to_date=_r("6.0 * sum(runs) OVER t / nullif(sum(balls) OVER t, 0)", "to_date")), bowling=True))
def rolling_form(spark, sf_dir):
    return rounded(engine.player_form(ledger.tables(spark, sf_dir)["bowling_innings"], "bowling", "economy", 10).select("player", "match_id", "innings", "n", "rolling", "to_date"))


@register("career_pivot", ledger.sql(f"""SELECT n, max(v) FILTER (player = 'Brand#11') AS a, max(v) FILTER (player = 'Brand#22') AS b FROM (SELECT player, row_number() OVER t AS n, {_r("6.0 * sum(runs) OVER t / nullif(sum(balls) OVER t, 0)", "v")} FROM bowling WHERE player IN ('Brand#11', 'Brand#22') WINDOW t AS (PARTITION BY player ORDER BY date, match_id, innings ROWS UNBOUNDED PRECEDING)) GROUP BY n""", bowling=True))
def career_pivot(spark, sf_dir):
    return rounded(engine.career_arc(ledger.tables(spark, sf_dir)["bowling_innings"], "bowling", "economy", ["Brand#11", "Brand#22"]).withColumnsRenamed({"Brand#11": "a", "Brand#22": "b"}))


@register("percentiles_midrank", ledger.sql(f""", q AS (SELECT player, 6.0 * sum(runs) / nullif(sum(balls), 0) AS v, sum(balls) AS balls FROM bowling GROUP BY player), p AS (SELECT player, v FROM q WHERE balls >= greatest(60, 0.1 * (SELECT max(balls) FROM q)))
SELECT player, 'economy' AS metric, {_r('v', 'value')}, {_r('100 - 100 * ((SELECT count(*) FROM p b WHERE b.v < a.v) + (SELECT count(*) FROM p b WHERE b.v = a.v) / 2.0) / (SELECT count(*) FROM p)', 'percentile')} FROM p a""", bowling=True))
def percentiles_midrank(spark, sf_dir):
    return rounded(engine.percentiles(ledger.tables(spark, sf_dir)["bowling_innings"], "bowling", ["economy"]))


@register("entry_heatmap", ledger.sql(f"SELECT CASE fgroup WHEN 'T20' THEN CASE WHEN entry_over < 6 THEN 'early' ELSE 'middle' END WHEN 'ODI' THEN CASE WHEN entry_over < 10 THEN 'early' ELSE 'middle' END ELSE CASE WHEN entry_over < 20 THEN 'early' ELSE 'middle' END END AS entry, CASE WHEN entry_wkts >= 5 THEN '5+' ELSE entry_wkts::VARCHAR END AS down, count(*) AS n, {_r('sum(runs)::DOUBLE / nullif(sum(out), 0)', 'value')} FROM batting GROUP BY ALL", batting=True))
def entry_heatmap(spark, sf_dir):
    return rounded(engine.entry_heatmap(ledger.tables(spark, sf_dir)["batting_innings"]))


_POOL = "SELECT player, 100.0 * sum(dots) / nullif(sum(balls), 0) AS x, 6.0 * sum(runs) / nullif(sum(balls), 0) AS y, sum(balls) AS balls FROM bowling GROUP BY player"


@register("scatter_zscore", ledger.sql(f"SELECT player, round(x, 4) AS x, round(y, 4) AS y, round((x - avg(x) OVER ()) / stddev_pop(x) OVER () - (y - avg(y) OVER ()) / stddev_pop(y) OVER (), 3) AS z FROM ({_POOL})", bowling=True))
def scatter_zscore(spark, sf_dir):
    rows = engine.scatter(ledger.tables(spark, sf_dir)["bowling_innings"], "bowling", "dot_pct", "economy")
    return rows.select("player", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 3).alias("z"))


@register("similar_topk", ledger.sql(""", q AS (SELECT player, 100.0 * sum(dots) / nullif(sum(balls), 0) AS x, 6.0 * sum(runs) / nullif(sum(balls), 0) AS y, sum(balls) AS balls FROM bowling GROUP BY player), pool AS (SELECT * FROM q WHERE player = 'Brand#11' OR balls >= greatest(120, 0.25 * (SELECT balls FROM q WHERE player = 'Brand#11'))),
z AS (SELECT player, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS zy, balls FROM pool)
SELECT a.player, a.balls::BIGINT AS sample, round(sqrt((a.zx - b.zx) ** 2 + (a.zy - b.zy) ** 2) + 1e-9, 4) AS distance, round(100 / (1 + sqrt((a.zx - b.zx) ** 2 + (a.zy - b.zy) ** 2)) + 1e-9, 4) AS score FROM z a, z b WHERE b.player = 'Brand#11' AND a.player <> b.player ORDER BY distance, a.player LIMIT 10""", bowling=True))
def similar_topk(spark, sf_dir):
    return rounded(engine.similar_players(ledger.tables(spark, sf_dir)["bowling_innings"], "bowling", "Brand#11", ["dot_pct", "economy"]))


@register("facets_self_excluding", ledger.sql("SELECT * FROM (SELECT 'competition' AS facet, event AS value, count(DISTINCT match_id) AS n FROM bowling WHERE season = '1998' GROUP BY 2 ORDER BY n DESC, value LIMIT 150) UNION ALL SELECT * FROM (SELECT 'team', team, count(DISTINCT match_id) AS n FROM bowling WHERE season = '1998' AND event = 'ASIA' GROUP BY 2 ORDER BY n DESC, team LIMIT 250) UNION ALL SELECT * FROM (SELECT 'venue', venue, count(DISTINCT match_id) AS n FROM bowling WHERE season = '1998' AND event = 'ASIA' GROUP BY 2 ORDER BY n DESC, venue LIMIT 300) UNION ALL SELECT * FROM (SELECT 'season', season, count(DISTINCT match_id) AS n FROM bowling WHERE event = 'ASIA' GROUP BY 2 ORDER BY n DESC, season LIMIT 80)", bowling=True))
def facets_self_excluding(spark, sf_dir):
    return engine.facets(ledger.tables(spark, sf_dir)["bowling_innings"], scope_of("bowling", season="1998", competition="ASIA"))


@register("player_profile", ledger.sql(f"SELECT 'bowling' AS role, k, count(*) AS n, {_r('6.0 * sum(runs) / nullif(sum(balls), 0)', 'economy')}, 'bowling' AS primary FROM (SELECT *, unnest(['all', format]) AS k FROM bowling WHERE player = 'Brand#11') GROUP BY k", bowling=True).replace("AS primary", 'AS "primary"'))
def player_profile(spark, sf_dir):
    return rounded(engine.player_profile(ledger.tables(spark, sf_dir), "Brand#11").select("role", "k", "n", F.col("metrics")["economy"].alias("economy"), "primary"))


# --- ball-level figures ----------------------------------------------------------------------------------------


@register("batting_figures", ledger.sql(f", there AS (SELECT DISTINCT match_id, innings, unnest([batter, non_striker]) AS player FROM balls), f AS (SELECT match_id, innings, batter AS player, sum(runs_batter) AS runs, sum(faced::INT) AS balls FROM balls GROUP BY ALL), o AS (SELECT DISTINCT match_id, innings, player, 1 AS out FROM (SELECT match_id, innings, player_out AS player FROM balls WHERE is_out UNION ALL SELECT match_id, innings, non_striker FROM balls WHERE second_out))\nSELECT player, count(*) AS innings, (count(*) - coalesce(sum(out), 0))::BIGINT AS not_outs, coalesce(sum(runs), 0)::BIGINT AS runs, coalesce(sum(balls), 0)::BIGINT AS balls, coalesce(max(runs), 0)::BIGINT AS highest, {_r('coalesce(sum(runs), 0)::DOUBLE / nullif(sum(out), 0)', 'average')} FROM there LEFT JOIN f USING (match_id, innings, player) LEFT JOIN o USING (match_id, innings, player) GROUP BY player"))
def batting_figures(spark, sf_dir):
    return rounded(ballstats.batting(ledger.balls(spark, sf_dir)).select("player", "innings", "not_outs", "runs", "balls", "highest", "average"))


@register("bowling_figures", ledger.sql(f", r AS (SELECT match_id, innings, bowler AS player, sum(b) AS balls, sum(r) AS runs, sum(w) AS wickets, sum((b >= 6 AND r = 0)::INT) AS maidens FROM (SELECT match_id, innings, bowler, ovr, sum(legal::INT) AS b, sum(bowler_runs) AS r, sum(credited) AS w FROM balls GROUP BY ALL) GROUP BY ALL)\nSELECT player, count(*) AS innings, sum(balls)::BIGINT AS balls, sum(runs)::BIGINT AS runs, sum(wickets)::BIGINT AS wickets, sum(maidens)::BIGINT AS maidens, max(wickets)::BIGINT AS best_wickets, arg_max(runs, 100000 * wickets - runs)::BIGINT AS best_runs, {_r('sum(runs)::DOUBLE / nullif(sum(wickets), 0)', 'average')}, {_r('6.0 * sum(runs) / nullif(sum(balls), 0)', 'economy')} FROM r GROUP BY player"))
def bowling_figures(spark, sf_dir):
    return rounded(ballstats.bowling(ledger.balls(spark, sf_dir)))


@register("fielding_explode", ledger.sql("SELECT CASE WHEN kind = 'caught and bowled' THEN bowler ELSE fielder END AS player, sum((kind IN ('caught', 'caught and bowled'))::INT)::BIGINT AS catches, sum((kind = 'stumped')::INT)::BIGINT AS stumpings, sum((kind = 'run out')::INT)::BIGINT AS run_outs FROM balls WHERE kind IN ('caught', 'caught and bowled', 'stumped', 'run out') GROUP BY 1"))
def fielding_explode(spark, sf_dir):
    text = F.to_json(F.array("fielder"))  # names kept as JSON text, as old tables have them
    rows = ledger.balls(spark, sf_dir).withColumn("fielders_text", text).withColumn("fielders", ballstats.fielders_from_text("fielders_text"))
    return ballstats.fielding(rows)


@register("matchup_pairs", ledger.sql(f"SELECT * FROM (SELECT batter, bowler, sum(faced::INT)::BIGINT AS balls, sum(runs_batter)::BIGINT AS runs, sum((credited > 0 AND player_out = batter)::INT)::BIGINT AS outs, sum((faced AND dot)::INT)::BIGINT AS dots, sum((four OR six)::INT)::BIGINT AS boundaries, {_r('100.0 * sum(runs_batter) / nullif(sum(faced::INT), 0)', 'strike_rate')} FROM balls GROUP BY ALL) WHERE balls >= 12"))
def matchup_pairs(spark, sf_dir):
    return rounded(ballstats.matchups(ledger.balls(spark, sf_dir)))


@register("records_batting", ledger.sql("SELECT match_id, innings, batter AS who, sum(runs_batter)::BIGINT AS a, sum(faced::INT)::BIGINT AS b FROM balls GROUP BY ALL ORDER BY a DESC, b, match_id, innings, who LIMIT 10"))
def records_batting(spark, sf_dir):
    return rounded(ballstats.top_performances(ledger.balls(spark, sf_dir), "batting"))


@register("records_bowling", ledger.sql("SELECT match_id, innings, bowler AS who, sum(credited)::BIGINT AS a, sum(bowler_runs)::BIGINT AS b FROM balls GROUP BY ALL ORDER BY a DESC, b, match_id, innings, who LIMIT 10"))
def records_bowling(spark, sf_dir):
    return rounded(ballstats.top_performances(ledger.balls(spark, sf_dir), "bowling"))


@register("records_totals", ledger.sql("SELECT match_id, innings, max(team) AS who, sum(runs_total)::BIGINT AS a, sum(outs)::BIGINT AS b FROM balls GROUP BY ALL ORDER BY a DESC, b, match_id, innings, who LIMIT 10"))
def records_totals(spark, sf_dir):
    return rounded(ballstats.top_performances(ledger.balls(spark, sf_dir), "totals"))


@register("semi_join_player_matches", ledger.sql("SELECT batter, count(*) AS n FROM balls WHERE match_id IN (SELECT match_id FROM balls WHERE batter = 's7' OR non_striker = 's7') GROUP BY 1"))
def semi_join_player_matches(spark, sf_dir):
    return ballstats.matches_of(ledger.balls(spark, sf_dir), "s7").groupBy("batter").agg(F.count("*").alias("n"))


_SIDES = "sides AS (SELECT o_orderkey AS match_id, o_orderdate AS date, unnest([{'t': cn.n_name, 'o': 'N' || o_custkey % 7}, {'t': 'N' || o_custkey % 7, 'o': cn.n_name}]) AS s, CASE o_orderstatus WHEN 'F' THEN cn.n_name WHEN 'O' THEN 'N' || o_custkey % 7 END AS winner, cn.n_name AS toss, o_custkey % 2 = 0 AS bat FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"


def _matches(spark, sf_dir):
    t = lambda n: ledger.table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    other = F.concat(F.lit("N"), (F.col("o_custkey") % 7).cast("string"))
    winner = F.when(F.col("o_orderstatus") == "F", F.col("n_name")).when(F.col("o_orderstatus") == "O", other)
    return rows.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("date"), F.col("n_name").alias("team1"), other.alias("team2"), winner.alias("winner"), F.col("n_name").alias("toss_winner"), F.when(F.col("o_custkey") % 2 == 0, "bat").otherwise("field").alias("toss_decision"))


@register("team_union", f"WITH {_SIDES} SELECT s.t AS team, count(*) AS played, count(*) FILTER (winner = s.t) AS won, count(*) FILTER (winner = s.o) AS lost, count(*) FILTER (winner IS NULL) AS no_result, count(*) FILTER ((toss = s.t) = bat) AS first, count(*) FILTER ((toss = s.t) = bat AND winner = s.t) AS won_first, count(*) FILTER ((toss = s.t) <> bat AND winner = s.t) AS won_chasing, count(*) FILTER (toss = s.t) AS tosses, count(*) FILTER (toss = s.t AND winner = s.t) AS won_after_toss, l.last_five FROM sides JOIN (SELECT s.t AS team, string_agg(CASE WHEN winner = s.t THEN 'W' WHEN winner = s.o THEN 'L' ELSE 'N' END, '' ORDER BY date DESC, match_id DESC) AS last_five FROM (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY s.t ORDER BY date DESC, match_id DESC) <= 5) GROUP BY 1) l ON l.team = s.t GROUP BY s.t, l.last_five")
def team_union(spark, sf_dir):
    return ballstats.team_stats(ballstats.teams(_matches(spark, sf_dir)))


@register("head_to_head", f"WITH {_SIDES} SELECT s.t AS team, s.o AS opponent, count(*) AS played, count(*) FILTER (winner = s.t) AS won, count(*) FILTER (winner = s.o) AS lost FROM sides GROUP BY ALL")
def head_to_head(spark, sf_dir):
    return ballstats.head_to_head(ballstats.teams(_matches(spark, sf_dir)))


@register("team_leaderboard", f"WITH {_SIDES} SELECT * FROM (SELECT s.t AS team, count(*) AS played, count(*) FILTER (winner = s.t) AS won, count(*) FILTER (winner = s.o) AS lost, {_r('100.0 * count(*) FILTER (winner = s.t) / nullif(count(*) FILTER (winner IS NOT NULL), 0)', 'win_pct')} FROM sides GROUP BY ALL) WHERE won + lost >= 10")
def team_leaderboard(spark, sf_dir):
    return rounded(ballstats.team_leaderboard(ballstats.teams(_matches(spark, sf_dir))))


_TOTALS = "totals AS (SELECT match_id, innings, venue, format, date, sum(runs_total)::BIGINT AS total, sum(outs)::BIGINT AS wickets, sum(legal::INT)::BIGINT AS balls FROM balls GROUP BY ALL)"


@register("venue_bands", ledger.sql(f", {_TOTALS}\nSELECT venue, format, count(DISTINCT match_id) AS matches, {_r('avg(total) FILTER (innings = 1)', 'first')}, {_r('avg(total) FILTER (innings = 2)', 'second')}, max(total) AS highest, min(total) AS lowest FROM totals GROUP BY ALL"))
def venue_bands(spark, sf_dir):
    return rounded(ballstats.venue_stats(ballstats.innings_totals(ledger.balls(spark, sf_dir))))


# --- models ------------------------------------------------------------------------------------------------------


@register("par_last20", ledger.sql(f", {_TOTALS}\nSELECT match_id, count(*) OVER g AS earlier, round(CASE WHEN count(*) OVER g >= 3 THEN avg(total) OVER g ELSE avg(total) OVER f END + 1e-9, 4) AS par FROM (SELECT * FROM totals WHERE innings = 1) WINDOW g AS (PARTITION BY venue, format ORDER BY date, match_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY format ORDER BY date, match_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"))
def par_last20(spark, sf_dir):
    first = ballstats.innings_totals(ledger.balls(spark, sf_dir)).filter("innings = 1")
    return rounded(models.venue_par(first).select("match_id", "earlier", "par"))


@register("win_states", ledger.sql("SELECT match_id, innings, seq, (sum(runs_total) OVER w)::BIGINT AS score_after, (sum(legal::INT) OVER w)::BIGINT AS legal_after, (sum(outs) OVER w)::BIGINT AS wickets_after FROM balls WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)"))
def win_states(spark, sf_dir):
    return rounded(models.ball_states(ledger.balls(spark, sf_dir)).select("match_id", "innings", "seq", "score_after", "legal_after", "wickets_after"))


@register("form_before", ledger.sql("SELECT player, gender, match_id, coalesce(sum(runs) OVER w, 0)::BIGINT AS runs_before, coalesce(sum(balls) OVER w, 0)::BIGINT AS balls_before FROM (SELECT player, gender, date, match_id, sum(runs) AS runs, sum(balls) AS balls FROM bowling GROUP BY ALL) WINDOW w AS (PARTITION BY player, gender ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", bowling=True))
def form_before(spark, sf_dir):
    return models.form_before(ledger.tables(spark, sf_dir)["bowling_innings"], ["runs", "balls"]).select("player", "gender", "match_id", "runs_before", "balls_before")


@register("full_outer_form", ledger.sql("SELECT coalesce(a.player, b.player) AS player, coalesce(a.gender, b.gender) AS gender, coalesce(bat_runs, 0)::BIGINT AS bat_runs, coalesce(bat_balls, 0)::BIGINT AS bat_balls, coalesce(bowl_runs, 0)::BIGINT AS bowl_runs, coalesce(bowl_balls, 0)::BIGINT AS bowl_balls, coalesce(bowl_wickets, 0)::BIGINT AS bowl_wickets FROM (SELECT batter AS player, gender, sum(runs_batter) AS bat_runs, sum(faced::INT) AS bat_balls FROM balls WHERE innings = 1 GROUP BY ALL) a FULL JOIN (SELECT CASE WHEN bowler < 'Brand#30' THEN batter ELSE bowler END AS player, gender, sum(bowler_runs) AS bowl_runs, sum(legal::INT) AS bowl_balls, sum(credited) AS bowl_wickets FROM balls WHERE innings = 2 GROUP BY ALL) b ON a.player = b.player AND a.gender = b.gender"))
def full_outer_form(spark, sf_dir):
    b = ledger.balls(spark, sf_dir)
    bat = b.filter("innings = 1").select(F.col("batter").alias("player"), "gender", F.col("runs_batter").alias("runs"), F.col("faced").cast("int").alias("balls"))
    who = F.when(F.col("bowler") < "Brand#30", F.col("batter")).otherwise(F.col("bowler"))
    bowl = b.filter("innings = 2").select(who.alias("player"), "gender", F.col("bowler_runs").alias("runs"), F.col("legal").cast("int").alias("balls"), F.col("credited").alias("wickets"))
    return models.career_snapshot(bat, bowl)


@register("situation_lookup", ledger.sql(f", base AS (SELECT runs_batter, count(*)::DOUBLE / (SELECT count(*) FROM balls) AS base FROM balls GROUP BY 1), cells AS (SELECT fgroup, innings, count(*) AS n FROM balls GROUP BY ALL), seen AS (SELECT fgroup, innings, runs_batter, count(*) AS c FROM balls GROUP BY ALL)\nSELECT fgroup, innings, runs_batter::BIGINT AS runs_batter, n, {_r('(coalesce(c, 0) + 50 * base) / (n + 50)', 'p')} FROM cells CROSS JOIN base LEFT JOIN seen USING (fgroup, innings, runs_batter)"))
def situation_lookup(spark, sf_dir):
    return rounded(models.situation_lookup(ledger.balls(spark, sf_dir), ["fgroup", "innings"], "runs_batter"))


@register("model_evaluation", ledger.sql(f", s AS (SELECT round(least(greatest(1 / (1 + exp(-(-1.0 + 0.3 * (runs_batter - 3.0) / 2.0 + 0.2 * (ovr - 3.0)))), 0.001), 0.999), 9) AS p, (outs > 0)::INT AS y FROM balls), v AS (SELECT p AS v, count(*) AS m, sum(y) AS k FROM s GROUP BY 1), w AS (SELECT sum(k * (zb + (m - k) / 2)) AS wins FROM (SELECT *, coalesce(sum(m - k) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zb FROM v))\nSELECT count(*) AS n, {_r('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')}, {_r('avg((p - y) ** 2)', 'brier')}, {_r('any_value(wins) / (sum(y) * (count(*) - sum(y)))', 'auc')}, {_r('(SELECT sum(m * gap) / sum(m) FROM (SELECT count(*) AS m, abs(avg(p) - avg(y)) AS gap FROM s GROUP BY least(floor(p * 20), 19)))', 'ece')} FROM s, w"))
def model_evaluation(spark, sf_dir):
    rows = ledger.balls(spark, sf_dir)
    odds = models.logistic(["runs_batter", "over"], [3.0, 3.0], [2.0, 1.0], [0.3, 0.2], -1.0)
    return rounded(models.evaluation(rows.select(F.round(models.probability(odds), 9).alias("p"), (F.col("outs") > 0).cast("int").alias("y"))))


@register("elo_fold")
def elo_fold(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumns({"pool": F.concat(F.lit("p"), (F.col("match_id") % 4).cast("string")), "tied": F.lit(False)})
    return rounded(models.elo(m))


def _scored(spark, sf_dir):
    s = models.ball_states(ledger.balls(spark, sf_dir))
    return s.withColumn("p", models.probability(F.col("score_after") / 20.0 - F.col("wickets_after") - 0.5))


@register("key_swings", ledger.sql("SELECT match_id, innings, seq, round(p - lag(p) OVER (PARTITION BY match_id ORDER BY innings, seq) + 1e-9, 4) AS swing FROM (SELECT *, least(greatest(1 / (1 + exp(-(sum(runs_total) OVER w / 20.0 - sum(outs) OVER w - 0.5))), 0.001), 0.999) AS p FROM balls WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING))"))
def key_swings(spark, sf_dir):
    return rounded(models.swings(_scored(spark, sf_dir)).select("match_id", "innings", "seq", "swing"))


@register("key_moments")
def key_moments(spark, sf_dir):
    s = models.swings(_scored(spark, sf_dir)).filter("swing is not null")
    at = (F.col("innings") * 100_000 + F.col("seq")).cast("long")
    return rounded(models.key_moments(s.select("match_id", at.alias("start"), at.alias("stop"), "swing")))


@register("story_by_over", ledger.sql("SELECT match_id, innings, ovr AS over_no, sum(runs_total)::BIGINT AS runs, arg_max(score, seq)::BIGINT AS score, arg_max(wk, seq)::BIGINT AS wickets FROM (SELECT *, sum(runs_total) OVER w AS score, sum(outs) OVER w AS wk FROM balls WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY ALL"))
def story_by_over(spark, sf_dir):
    return rounded(models.story(_scored(spark, sf_dir)).drop("p").withColumnRenamed("over", "over_no"))


# --- study -----------------------------------------------------------------------------------------------------------

_HALF = "(('0x' || substr(md5(match_id::VARCHAR), 1, 8))::BIGINT % 2)"
_SEASONS = f", seasons AS (SELECT fgroup, gender, player, yr, {_HALF} AS half, m.metric AS metric, sum(m.n)::DOUBLE AS n, sum(m.x)::DOUBLE AS x FROM (SELECT *, unnest([{{'metric': 'dot', 'n': deliveries, 'x': n_dot}}, {{'metric': 'wickets', 'n': deliveries, 'x': wickets}}]) AS m FROM bowling) GROUP BY ALL)"
_YEARS = ", years AS (SELECT fgroup, gender, player, metric, yr, sum(n) AS n, sum(x) AS x, sum(x) / sum(n) AS rate FROM seasons GROUP BY ALL HAVING sum(n) >= 5), pairs AS (SELECT a.*, b.n AS n2, b.rate AS rate2, a.n * b.n / (a.n + b.n) AS w FROM years a JOIN years b ON a.fgroup = b.fgroup AND a.gender = b.gender AND a.player = b.player AND a.metric = b.metric AND b.yr = a.yr + 1)"
_COV, _VX, _VY = "(sxy / sw - sx * sy / (sw * sw))", "(sxx / sw - sx * sx / (sw * sw))", "(syy / sw - sy * sy / (sw * sw))"
_SUMS = lambda x, y: f"sum(w) AS sw, sum(w * {x}) AS sx, sum(w * {y}) AS sy, sum(w * {x} * {y}) AS sxy, sum(w * {x} * {x}) AS sxx, sum(w * {y} * {y}) AS syy"
_MINE = lambda df: df.filter(F.col("metric").isin("dot", "wickets"))


def _bowl(spark, sf_dir):
    return ledger.tables(spark, sf_dir)["bowling_in_place"]


def _pairs(spark, sf_dir):
    """Pairs of years, which are written once: the lines and what they miss both read them."""
    return cut(_MINE(study.next_year(study.yearly(study.seasons(_bowl(spark, sf_dir), "bowling"), 5))), "pairs")


@register("study_halves_k", (ledger.sql(_SEASONS + ", h AS (SELECT fgroup, gender, player, yr, metric, sum(n) FILTER (half = 0) AS na, sum(n) FILTER (half = 1) AS nb, sum(x) FILTER (half = 0) AS xa, sum(x) FILTER (half = 1) AS xb FROM seasons GROUP BY ALL HAVING na >= 4 AND nb >= 4), g AS (SELECT fgroup, gender, metric, count(*) AS seasons, sum(xa + xb) / sum(na + nb) AS p, median(na + nb) AS typical, " + _SUMS("a", "b") + " FROM (SELECT *, xa / na AS a, xb / nb AS b, na * nb / (na + nb) AS w FROM h) GROUP BY ALL)\n" + f"SELECT fgroup, gender, metric, seasons, {_r('p', 'p')}, {_r('p * (1 - p)', 'sigma2')}, round({_COV}, 6) AS tau2, {_r('typical', 'typical')}, {_r(f'CASE WHEN {_VX} * {_VY} > 0 THEN {_COV} / sqrt({_VX} * {_VY}) END', 'r_half')} FROM g", bowling=True)))
def study_halves_k(spark, sf_dir):
    s = _MINE(study.stability(_bowl(spark, sf_dir), "bowling", 4))
    return s.select("fgroup", "gender", "metric", "seasons", *(F.round(F.col(c) + TINY, 4).alias(c) for c in ("p", "sigma2", "typical", "r_half")), F.round("tau2", 6).alias("tau2"))


@register("study_year_pairs", (ledger.sql(_SEASONS + _YEARS + "\n" + f"SELECT fgroup, gender, metric, pairs, {_r(f'CASE WHEN {_VX} * {_VY} > 0 THEN {_COV} / sqrt({_VX} * {_VY}) END', 'r')} FROM (SELECT fgroup, gender, metric, count(*) AS pairs, {_SUMS('rate', 'rate2')} FROM pairs GROUP BY ALL)", bowling=True)))
def study_year_pairs(spark, sf_dir):
    return rounded(_MINE(study.year_to_year(_bowl(spark, sf_dir), "bowling", 5)))


@register("study_predictors", (ledger.sql(_SEASONS + _YEARS + ", v AS (SELECT fgroup, gender, metric, yr % 2 AS half, rate2, w, 'league average' AS predictor, 0.0::DOUBLE AS x FROM pairs UNION ALL SELECT fgroup, gender, metric, yr % 2, rate2, w, 'this season', rate FROM pairs UNION ALL SELECT fgroup, gender, metric, yr % 2, rate2, w, 'regressed', (x + 4.0) / (n + 40.0) FROM pairs), ln AS (SELECT fgroup, gender, metric, predictor, 1 - half AS half, coalesce(CASE WHEN " + f"{_VX} <> 0 THEN {_COV} / {_VX} END" + ", 0) AS b, sx / sw AS mx, sy / sw AS my FROM (SELECT fgroup, gender, metric, predictor, half, " + _SUMS("x", "rate2") + " FROM v GROUP BY ALL))\n" + f"SELECT fgroup, gender, metric, predictor, count(*) AS pairs, {_r('sqrt(sum(w * (rate2 - (my + b * (x - mx))) ** 2) / sum(w))', 'rmse')} FROM v JOIN ln USING (fgroup, gender, metric, predictor, half) GROUP BY ALL", bowling=True)))
def study_predictors(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    candidates = {"this season": F.col("rate"), "regressed": (F.col("x") + 4.0) / (F.col("n") + 40.0)}
    return rounded(study.predictors(pairs, candidates).select("fgroup", "gender", "metric", "predictor", "pairs", "rmse"))


@register("study_prediction", (ledger.sql(_SEASONS + _YEARS + ", ln AS (SELECT fgroup, gender, metric, 1 - yr % 2 AS fold, coalesce(" + f"{_COV} / nullif({_VX}, 0)" + ", 0) AS b, sx / sw AS mx, sy / sw AS my FROM (SELECT fgroup, gender, metric, yr % 2 AS yr, " + _SUMS("rate", "rate2") + " FROM pairs GROUP BY fgroup, gender, metric, yr % 2))\n" + f"SELECT p.fgroup, p.gender, p.metric, count(*) AS pairs, {_r('sqrt(sum(w * (rate2 - (my + b * (rate - mx))) ** 2) / sum(w))', 'rmse')} FROM pairs p JOIN ln ON p.fgroup = ln.fgroup AND p.gender = ln.gender AND p.metric = ln.metric AND p.yr % 2 = ln.fold GROUP BY ALL", bowling=True)))
def study_prediction(spark, sf_dir):
    return rounded(study.prediction(_pairs(spark, sf_dir), "rate"))


@register("sample_variance", ledger.sql(f"SELECT fgroup, gender, 'runs' AS metric, {_r('var_pop(runs_batter) FILTER (faced)', 'sigma2')} FROM balls GROUP BY ALL UNION ALL SELECT fgroup, gender, 'inplay', {_r('var_pop(runs_batter) FILTER (in_play)', 'sigma2')} FROM balls GROUP BY ALL"))
def sample_variance(spark, sf_dir):
    return rounded(study.sample_variance(ledger.balls(spark, sf_dir)))


@register("upsert_merge", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_merge(spark, sf_dir):
    old = ledger.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return upsert(old, old.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")
