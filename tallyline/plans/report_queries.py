"""Queries: results in words, highlights, model inputs and scores, identities, curation scores, sliding windows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyline.functions.metrics import get
from tallyline.operators import ballstats, curation, derive, engine, insights, models, resolve, study
from tallyline.sources import matches as sources
from tallyline.streaming import feeds

from . import ledger
from .ledger_queries import _r, rounded
from .registry import register
from .view_queries import _SEASONS, _YEARS

t = ledger.table

# --- views ----------------------------------------------------------------------------------------------------


@register("matches_played", "SELECT l_suppkey AS player, count(DISTINCT l_orderkey) AS matches FROM lineitem GROUP BY 1")
def matches_played(spark, sf_dir):
    return ballstats.matches_played(t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("match_id")))


@register("result_words", """WITH m AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'home' WHEN 'O' THEN 'away' END AS winner, o_custkey % 3 AS r, o_custkey % 4 AS w, CASE WHEN o_custkey % 7 = 0 THEN 'tie' END AS kind FROM orders)
    SELECT CASE WHEN winner IS NOT NULL THEN winner || ' won' || CASE WHEN r > 0 THEN ' by ' || r || ' runs' WHEN w > 0 THEN ' by ' || w || ' wickets' ELSE '' END ELSE coalesce(kind, 'no result') END AS words, count(*) AS n FROM m GROUP BY 1""")
def result_words(spark, sf_dir):
    winner = F.when(F.col("o_orderstatus") == "F", "home").when(F.col("o_orderstatus") == "O", "away")
    rows = t(spark, sf_dir, "orders").select(winner.alias("winner"), (F.col("o_custkey") % 3).alias("win_by_runs"), (F.col("o_custkey") % 4).alias("win_by_wickets"), F.when(F.col("o_custkey") % 7 == 0, "tie").alias("result_type"))
    return rows.groupBy(models.result_text().alias("words")).agg(F.count("*").alias("n"))


@register("season_labels", """WITH s AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN year(o_orderdate) || '/x' ELSE (year(o_orderdate) - o_custkey % 3)::VARCHAR END AS season, max(year(o_orderdate))::VARCHAR AS y, count(*) AS n FROM orders GROUP BY 1)
    SELECT season, CASE WHEN count(*) OVER (PARTITION BY y) = 1 THEN y ELSE season END AS label, n FROM s""")
def season_labels(spark, sf_dir):
    year = F.year("o_orderdate")
    season = F.when(F.col("o_custkey") % 2 == 0, F.concat(year.cast("string"), F.lit("/x"))).otherwise((year - F.col("o_custkey") % 3).cast("string"))
    rows = t(spark, sf_dir, "orders").select(season.alias("season"), F.col("o_orderdate").alias("date"))
    return engine.season_labels(rows).groupBy("season", "label").agg(F.count("*").alias("n"))


@register("highlights", ledger.sql(""", q AS (SELECT player, sum(wickets) AS wickets, 6.0 * sum(runs) / nullif(sum(balls), 0) AS economy, sum(balls) AS sample FROM bowling GROUP BY player), m AS (SELECT list_sort(list(sample))[count(*) // 2 + 1] AS med FROM q),
l AS (SELECT player, sample, 'wickets' AS metric, wickets::DOUBLE AS value, wickets::DOUBLE AS s, false AS rate FROM q UNION ALL SELECT player, sample, 'economy', economy, -economy, true FROM q)
SELECT metric, player, round(value + 1e-9, 4) AS value FROM l, m WHERE value IS NOT NULL AND (NOT rate OR sample >= 0.25 * med) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY s DESC, sample DESC, player) = 1""", bowling=True))
def highlights(spark, sf_dir):
    chosen = [get("bowling", "wickets"), get("bowling", "economy")]
    rows = ledger.tables(spark, sf_dir)["bowling_innings"].groupBy("player").agg(*(m.column() for m in chosen), F.sum("balls").alias("sample"))
    return rounded(engine.highlights(rows, "player", chosen))


@register("phase_compare", ledger.sql(f"SELECT player, phase AS k, sum(balls)::BIGINT AS balls, sum(runs)::BIGINT AS runs, {_r('6.0 * sum(runs) / nullif(sum(balls), 0)', 'economy')} FROM ({ledger._bowling(', phase')}) WHERE phase IS NOT NULL AND player IN ('Brand#11', 'Brand#22') GROUP BY ALL", bowling=True))
def phase_compare(spark, sf_dir):
    return rounded(engine.by_phase(ledger.tables(spark, sf_dir), "bowling", ["Brand#11", "Brand#22"], ["balls", "runs", "economy"]).select("player", "k", "balls", "runs", "economy"))


@register("season_pairs_top", ledger.sql(_SEASONS + _YEARS + f"\nSELECT fgroup, gender, player, yr::BIGINT AS yr, {_r('rate', 'rate')}, {_r('rate2', 'rate2')}, {_r('w', 'w')} FROM pairs WHERE metric = 'wickets' ORDER BY pairs.w DESC, player, yr, fgroup, gender LIMIT 20", bowling=True))
def season_pairs_top(spark, sf_dir):
    bowling = ledger.tables(spark, sf_dir)["bowling_in_place"]
    pairs = study.next_year(study.yearly(study.seasons(bowling, "bowling"), 5)).filter("metric = 'wickets'")
    return rounded(pairs.orderBy(F.desc("w"), "player", "yr", "fgroup", "gender").limit(20).select("fgroup", "gender", "player", "yr", "rate", "rate2", "w"))


# --- models ---------------------------------------------------------------------------------------------------


@register("next_ball_rows", ledger.sql("""SELECT * EXCLUDE (faced) FROM (SELECT match_id, innings, seq, coalesce(sum(runs_total) OVER i, 0)::BIGINT AS score, coalesce(sum(outs) OVER i, 0)::BIGINT AS wickets, coalesce(sum(faced::INT) OVER s, 0)::BIGINT AS striker_balls, coalesce(sum(runs_batter) OVER s, 0)::BIGINT AS striker_runs,
  coalesce(sum(legal::INT) OVER b, 0)::BIGINT AS bowler_balls, coalesce(sum(bowler_runs) OVER b, 0)::BIGINT AS bowler_conceded, CASE WHEN outs > 0 THEN 'W' ELSE runs_batter::VARCHAR END AS outcome, faced
FROM balls WINDOW i AS (PARTITION BY match_id, innings ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY match_id, innings, batter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY match_id, innings, bowler ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE faced"""))
def next_ball_rows(spark, sf_dir):
    return rounded(models.next_ball_rows(ledger.balls(spark, sf_dir)).drop("batter", "bowler", "gender"))


@register("next_ball_form", ledger.sql(f", f AS (SELECT player, gender, match_id, (coalesce(sum(runs) OVER w, 0) + 120.0 * m) / (coalesce(sum(balls) OVER w, 0) + 120.0) AS form FROM (SELECT player, gender, date, match_id, sum(runs) AS runs, sum(balls) AS balls FROM bowling GROUP BY ALL), (SELECT sum(runs)::DOUBLE / sum(balls) AS m FROM bowling) WINDOW w AS (PARTITION BY player, gender ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))\nSELECT bowler, count(*) AS n, {_r('avg(form)', 'form')} FROM balls LEFT JOIN f ON bowler = player AND balls.gender = f.gender AND balls.match_id = f.match_id WHERE faced GROUP BY 1", bowling=True))
def next_ball_form(spark, sf_dir):
    tables = ledger.tables(spark, sf_dir)
    rows = models.next_ball_form(models.next_ball_rows(tables["balls"]), tables["batting_in_place"], tables["bowling_in_place"], ledger.tasks(spark, sf_dir))
    return rounded(rows.groupBy("bowler").agg(F.count("*").alias("n"), F.avg("bowler_form").alias("form")))


@register("win_rows", ledger.sql(f", s AS (SELECT *, sum(runs_total) OVER w AS score_after, sum(legal::INT) OVER w AS legal_after, least(sum(outs) OVER w, 10) AS gone FROM balls WHERE fgroup IN ('T20', 'ODI') WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)), t AS (SELECT *, CASE WHEN innings = 2 THEN max(CASE WHEN innings = 1 THEN score_after END) OVER (PARTITION BY match_id) + 1 END AS target, CASE fgroup WHEN 'T20' THEN 120 ELSE 300 END AS balls_total FROM s)\nSELECT match_id, innings::BIGINT AS innings, seq::BIGINT AS seq, (10 - gone)::BIGINT AS wickets_left, greatest(balls_total - legal_after, 0)::BIGINT AS balls_left, target::BIGINT AS target, (target - score_after)::BIGINT AS needed, {_r('6.0 * (target - score_after) / greatest(balls_total - legal_after, 1)', 'required')}, (CASE result WHEN 'won' THEN 1 WHEN 'lost' THEN 0 END)::BIGINT AS won FROM t"))
def win_rows(spark, sf_dir):
    return rounded(models.win_rows(ledger.balls(spark, sf_dir)).drop("score_after", "balls_total"))


@register("team_top3", ledger.sql("SELECT player, list(team ORDER BY n DESC, team) AS teams FROM (SELECT * FROM (SELECT player, team, count(DISTINCT match_id) AS n FROM bowling GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, team) <= 3) GROUP BY 1", bowling=True))
def team_top3(spark, sf_dir):
    return engine.top_teams(ledger.tables(spark, sf_dir)["bowling_innings"], ["player"])


@register("best_and_worst", ledger.sql(f"SELECT arg_min(player, (-e, player)) AS best, arg_min(player, (e, player)) AS worst, {_r('max(e)', 'best_value')}, {_r('min(e)', 'worst_value')} FROM (SELECT player, sum(wickets)::DOUBLE AS e FROM bowling GROUP BY 1)", bowling=True))
def best_and_worst(spark, sf_dir):
    rows = ledger.tables(spark, sf_dir)["bowling_innings"].groupBy("player").agg(F.sum("wickets").alias("e"))
    return rounded(insights.best_and_worst(rows, "player", "e"))


@register("shrunk_form", ledger.sql(f"SELECT player, gender, match_id, {_r('(coalesce(sum(runs) OVER w, 0) + 120.0 * 1.2) / (coalesce(sum(balls) OVER w, 0) + 120.0)', 'form')} FROM (SELECT player, gender, date, match_id, sum(runs) AS runs, sum(balls) AS balls FROM bowling GROUP BY ALL) WINDOW w AS (PARTITION BY player, gender ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", bowling=True))
def shrunk_form(spark, sf_dir):
    rows = models.form_before(ledger.tables(spark, sf_dir)["bowling_innings"], ["runs", "balls"])
    return rounded(rows.select("player", "gender", "match_id", models.shrunk_form("runs_before", "balls_before", 1.2).alias("form")))


@register("time_split", ledger.sql("SELECT CASE WHEN yr <= 1996 THEN 'train' WHEN yr <= 1998 THEN 'check' ELSE 'test' END AS part, count(*) AS n FROM balls GROUP BY 1"))
def time_split(spark, sf_dir):
    return ledger.balls(spark, sf_dir).groupBy(models.time_split("yr", 1996, 1998).alias("part")).agg(F.count("*").alias("n"))


_TREES = json.dumps([{"feature": 0, "threshold": 3.0, "default_left": True, "left": -0.5, "right": {"feature": 1, "threshold": 2.0, "default_left": False, "left": 0.25, "right": 0.75}}, 0.1])
_TREES_SQL = "(CASE WHEN runs_batter <= 3 THEN -0.5::DOUBLE WHEN ovr IS NULL THEN 0.75 WHEN ovr <= 2 THEN 0.25 ELSE 0.75 END + 0.1)"
_LINEAR_SQL = "(-1.0 + 0.3 * (runs_batter - 3.0) / 2.0 + 0.2 * (ovr - 3.0))::DOUBLE"


@register("tree_scores", ledger.sql(f"SELECT fgroup, count(*) AS n, {_r(f'avg({_TREES_SQL})', 'score')}, {_r(f'max({_TREES_SQL})', 'most')} FROM balls GROUP BY 1"))
def tree_scores(spark, sf_dir):
    rows = ledger.balls(spark, sf_dir).select("fgroup", models.tree_scorer(_TREES, ["runs_batter", "over"]).alias("score"))
    return rounded(rows.groupBy("fgroup").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.max("score").alias("most")))


@register("blended_forecast", ledger.sql(f"SELECT fgroup, {_r(f'avg(least(greatest(1 / (1 + exp(-({_TREES_SQL} + {_LINEAR_SQL}) / 2)), 0.001), 0.999))', 'p')} FROM balls GROUP BY 1"))
def blended_forecast(spark, sf_dir):
    linear = models.logistic(["runs_batter", "over"], [3.0, 3.0], [2.0, 1.0], [0.3, 0.2], -1.0)
    rows = ledger.balls(spark, sf_dir).select("fgroup", linear.alias("a"), models.tree_scorer(_TREES, ["runs_batter", "over"]).alias("b"))
    return rounded(rows.groupBy("fgroup").agg(F.avg(models.blended([F.col("a"), F.col("b")])).alias("p")))


# --- identities and names ---------------------------------------------------------------------------------------


@register("identity_map", """WITH p AS (SELECT o_orderkey AS match_id, 'p' || o_custkey % 100 AS name, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS id FROM orders)
    SELECT match_id, name, coalesce(c_name, name) AS person FROM p LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = id""")
def identity_map(spark, sf_dir):
    key = F.col("o_custkey")
    players = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.concat(F.lit("p"), (key % 100).cast("string")).alias("player"), F.when(key % 4 > 0, key).alias("player_id"))
    register_ = t(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("identifier"), F.col("c_name").alias("unique_name"))
    return derive.identities(players, register_)


@register("keeper_inference", ledger.sql(", st AS (SELECT match_id, fielder AS player FROM balls WHERE kind = 'stumped' AND fielder IS NOT NULL), here AS (SELECT match_id, player, count(*) AS h FROM st GROUP BY ALL), career AS (SELECT player, count(*) AS c FROM st GROUP BY 1), p AS (SELECT DISTINCT match_id, opposition AS team, fielder AS player FROM balls WHERE fielder IS NOT NULL)\nSELECT match_id, team, player AS keeper FROM p JOIN career USING (player) LEFT JOIN here USING (match_id, player) QUALIFY row_number() OVER (PARTITION BY match_id, team ORDER BY coalesce(h, 0) DESC, c DESC, player) = 1"))
def keeper_inference(spark, sf_dir):
    rows = ledger.balls(spark, sf_dir).filter("fielder is not null")
    players = rows.select("match_id", F.col("opposition").alias("team"), F.col("fielder").alias("player")).distinct()
    return derive.keepers(players, rows.select("match_id", "kind", F.array("fielder").alias("fielders")))


@register("register_names", """WITH n AS (SELECT s_suppkey % 50 AS identifier, s_name AS name FROM supplier), p AS (SELECT s_suppkey AS identifier, s_name AS name FROM supplier WHERE s_suppkey % 2 = 1)
    SELECT * FROM n UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.identifier = p.identifier AND n.name = p.name)""")
def register_names(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    names = s.select((F.col("s_suppkey") % 50).alias("identifier"), F.col("s_name").alias("name"))
    return sources.alternate_names(names, s.filter("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("identifier"), F.col("s_name").alias("name")))


@register("autocomplete", "SELECT c_name AS player, max(c_nationkey)::BIGINT AS matches FROM customer WHERE starts_with(replace(lower(c_name), '#', ''), 'customer00000001') GROUP BY 1 ORDER BY matches DESC, player LIMIT 8")
def autocomplete(spark, sf_dir):
    names = t(spark, sf_dir, "customer").select(F.col("c_name").alias("player"), F.col("c_nationkey").cast("long").alias("matches"), F.lit(False).alias("international"))
    return resolve.autocomplete(resolve.catalog(names), "Customer00000001")


# --- curation ----------------------------------------------------------------------------------------------------


@register("leak_words", "SELECT p_partkey, n AS leaked FROM part, (VALUES ('Ring'), ('bolt')) v(n) WHERE list_contains(string_split(lower(p_name), ' '), lower(n))")
def leak_words(spark, sf_dir):
    names = spark.createDataFrame([("Ring",), ("bolt",)], "name string")
    return curation.leaks(t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text")), names).select("p_partkey", "leaked")


@register("paraphrases", "WITH p AS (SELECT p_type, p_partkey, p_name || ' ' || p_size AS a, p_type || ' item ' || (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS b FROM part) SELECT p_type, count(*) AS n FROM p WHERE p_partkey % 3 > 0 AND length(b) <= 1.5 * length(a) GROUP BY 1")
def paraphrases(spark, sf_dir):
    size = F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    pairs = t(spark, sf_dir, "part").select("p_type", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("original"), F.concat_ws(" item ", "p_type", size.cast("string")).alias("rewrite"))
    return curation.accepted_paraphrases(pairs, 1.5).groupBy("p_type").agg(F.count("*").alias("n"))


@register("tool_choice", f"""WITH e AS (SELECT event_type AS expected_tool, user_id % 4 > 0 OR event_type = 'view' AS same, user_id % 5 AS k FROM events)
    SELECT expected_tool, count(*) AS n, {_r('avg(same::INT)', 'tool')}, {_r('avg((k <> 0)::INT)', 'valid')}, {_r('avg((same AND k > 1)::INT)', 'exact')}, {_r('avg((same AND k > 1)::INT)', 'required')} FROM e GROUP BY 1""")
def tool_choice(spark, sf_dir):
    k = F.col("user_id") % 5
    rows = t(spark, sf_dir, "events").select(
        F.col("event_type").alias("expected_tool"), F.when(F.col("user_id") % 4 == 0, "view").otherwise(F.col("event_type")).alias("tool"),
        F.col("props").alias("expected_args"), F.when(k == 0, "{oops").when(k == 1, '{"j": 1}').otherwise(F.col("props")).alias("args"),
    )
    return rounded(curation.tool_choice(rows))


@register("answer_scores", f"SELECT count(*) AS n, {_r('avg((event_id % 3 > 0)::INT)', 'right')}, {_r('avg(user_id % 5)', 'calls')}, {_r('median(value)', 'seconds')} FROM events".replace("AS right", 'AS "right"'))
def answer_scores(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, "nothing").otherwise(F.col("event_type"))
    rows = t(spark, sf_dir, "events").select(F.array(F.initcap("event_type")).alias("expected"), F.concat(F.lit("It was a "), said, F.lit(".")).alias("answer"), (F.col("user_id") % 5).alias("calls"), F.col("value").alias("seconds"))
    return rounded(curation.answers(rows))


# --- feeds ---------------------------------------------------------------------------------------------------------


@register("events_sliding", f"SELECT start, event_type, count(*) AS n, {_r('sum(value)', 'total')} FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start, event_type, value FROM events) GROUP BY ALL")
def events_sliding(spark, sf_dir):
    rows = feeds.windowed(t(spark, sf_dir, "events"), "1 hour", slide="30 minutes")
    return rounded(rows.withColumn("start", F.col("start").cast("timestamp_ntz")))
