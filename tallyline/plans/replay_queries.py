"""Queries of replay bundles, and of names that mean the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import groups, models, replay

from . import ledger
from .registry import register

_OVERS = tuple(models.OVERS)


def bundled(spark, sf_dir):
    """Bundles of the ledger's limited-overs matches; the ball's number within its over is its seq."""
    tables = ledger.tables(spark, sf_dir)
    balls = models.ball_states(tables["balls"].filter(F.col("fgroup").isin(*_OVERS))).withColumns({"ball": F.col("seq"), "p": F.lit(None).cast("double")})
    balls = balls.withColumn("player_out", F.get("wickets", F.lit(0))["player_out"])
    last = F.max("date").alias("date")
    winner = F.when(F.col("result") == "won", F.col("team")).when(F.col("result") == "lost", F.col("opposition"))
    result = F.when(F.col("result") == "tied", "tie").when(F.col("result").isin("no result", "drawn"), "no result")
    matches = balls.groupBy("match_id").agg(last, F.min(winner).alias("winner"), F.min(result).alias("result"), F.when(F.col("match_id") % 11 == 0, "D/L").alias("method"), (F.col("match_id") % 4 * 3).alias("win_by_runs"), (F.col("match_id") % 3).alias("win_by_wickets"))
    limited = matches.select("match_id")
    return replay.bundles(matches, balls, tables["batting_innings"].join(limited, "match_id", "left_semi"), tables["bowling_innings"].join(limited, "match_id", "left_semi"))


@register("replay_bundles", ledger.sql(f""", s AS (SELECT *, sum(runs_total) OVER w AS sc, sum(legal::INT) OVER w AS lg, sum(outs) OVER w AS wk FROM balls WHERE fgroup IN {_OVERS} WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT match_id, min(CASE result WHEN 'won' THEN team WHEN 'lost' THEN opposition END) AS winner, min(CASE WHEN result = 'tied' THEN 'tie' WHEN result IN ('no result', 'drawn') THEN 'no result' END) AS result, match_id % 11 = 0 AS rain, match_id % 4 * 3 AS r, match_id % 3 AS w FROM s GROUP BY match_id),
b AS (SELECT match_id, count(*) AS n_balls, md5(string_agg(innings || '/' || seq || '/' || sc || '/' || wk || '/' || lg || '/' || ovr || '.' || seq || ': ' || CASE WHEN kind IS NOT NULL THEN coalesce(player_out, batter) || ' ' || kind || CASE WHEN kind IN ('run out', 'retired hurt', 'obstructing the field') THEN '' ELSE ', ' || bowler END
    WHEN runs_batter IN (4, 6) THEN batter || ' hits ' || bowler || ' for ' || runs_batter ELSE batter || ' ' || runs_total || ' off ' || bowler END, ';' ORDER BY innings, seq)) AS balls FROM s GROUP BY match_id),
i AS (SELECT match_id, innings, max(sc) AS sc, arg_max(wk, seq) AS wk, arg_max(lg, seq) AS lg, arg_max(team, seq) AS team FROM s GROUP BY ALL),
j AS (SELECT i.match_id, string_agg(innings || ' ' || team || ' ' || sc || '/' || wk || ' ' || lg // 6 || '.' || lg % 6 || ' ' || CASE WHEN innings = 2 THEN coalesce((SELECT (f.sc + 1)::VARCHAR FROM i f WHERE f.match_id = i.match_id AND f.innings = 1), '-') ELSE '-' END, '; ' ORDER BY innings) AS innings FROM i GROUP BY i.match_id),
c AS (SELECT match_id, string_agg(innings || ' ' || position || ' ' || player || ' ' || runs || ' ' || balls || ' ' || coalesce(kind, 'not out'), '; ' ORDER BY innings, position) AS batting FROM batting WHERE balls > 0 GROUP BY match_id),
d AS (SELECT match_id, string_agg(innings || ' ' || player || ' ' || wickets || '-' || runs, '; ' ORDER BY innings, -wickets, runs, player) AS bowling FROM bowling GROUP BY match_id)
SELECT m.match_id, CASE WHEN result = 'no result' THEN 'No result' WHEN result = 'tie' THEN 'Tied' || CASE WHEN winner IS NULL THEN '' ELSE ' (' || winner || ' won the super over)' END
  WHEN winner IS NULL THEN 'No result' ELSE winner || ' won' || CASE WHEN r <> 0 THEN ' by ' || r || ' runs' WHEN w <> 0 THEN ' by ' || w || ' wickets' ELSE '' END || CASE WHEN rain THEN ' (DLS)' ELSE '' END END AS summary,
  n_balls, b.balls, j.innings, c.batting, d.bowling, rain FROM m JOIN b USING (match_id) JOIN j USING (match_id) LEFT JOIN c USING (match_id) LEFT JOIN d USING (match_id)""", batting=True, bowling=True))
def replay_bundles(spark, sf_dir):
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    lines = lambda name, between, f: F.array_join(F.transform(name, f), between)
    return bundled(spark, sf_dir).select(
        "match_id", F.col("match.summary").alias("summary"), F.size("balls").cast("long").alias("n_balls"),
        F.md5(lines("balls", ";", lambda b: text(b["innings"], "/", b["seq"], "/", b["score"], "/", b["wickets"], "/", b["legal"], "/", b["text"])).cast("binary")).alias("balls"),
        lines("innings", "; ", lambda i: text(i["innings"], " ", i["team"], " ", i["score"], "/", i["wickets"], " ", i["overs"], " ", F.coalesce(i["target"].cast("string"), F.lit("-")))).alias("innings"),
        F.nullif(lines("batting", "; ", lambda b: text(b["innings"], " ", b["position"], " ", b["player"], " ", b["runs"], " ", b["balls"], " ", F.coalesce(b["kind"], F.lit("not out")))), F.lit("")).alias("batting"),
        F.nullif(lines("bowling", "; ", lambda b: text(b["innings"], " ", b["player"], " ", b["wickets"], "-", b["runs"])), F.lit("")).alias("bowling"), "rain",
    )


# --- names that mean the same ------------------------------------------------------------------------------


@register("competition_groups", """WITH RECURSIVE e AS (SELECT o_orderpriority || ' ' || year(o_orderdate) AS event, count(*) AS matches FROM orders GROUP BY 1),
k AS (SELECT event, matches, split_part(event, '-', 1) AS series FROM e), f AS (SELECT event, matches, CASE WHEN series IN ('1', '2') THEN 'top' ELSE event END AS g FROM k)
SELECT event, first_value(event) OVER (PARTITION BY g ORDER BY matches DESC, event) AS competition, (SELECT string_agg(x.event, '|' ORDER BY x.event) FROM f x WHERE x.g = f.g) AS events, (sum(matches) OVER (PARTITION BY g))::BIGINT AS matches FROM f""")
def competition_groups(spark, sf_dir):
    """The orders' priorities by year are events; those of 1-URGENT are chained year by year, as are those of 2-HIGH, and one alias spans both."""
    event = lambda p, y: F.concat(p, F.lit(" "), y.cast("string"))
    orders = ledger.table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"))
    years = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).distinct()
    chain = years.select(event(F.col("o_orderpriority"), F.col("y") - 1).alias("alias"), event(F.col("o_orderpriority"), F.col("y")).alias("event"))
    spans = years.groupBy().agg(F.min("y").alias("y")).select(event(F.lit("1-URGENT"), F.col("y")).alias("alias"), event(F.lit("2-HIGH"), F.col("y")).alias("event"))
    events = orders.groupBy(event(F.col("o_orderpriority"), F.col("y")).alias("event")).agg(F.count("*").alias("matches"))
    found = groups.competition_groups(events, chain.unionByName(spans))
    return found.select("event", "competition", F.array_join("events", "|").alias("events"), "matches")


@register("venue_ladder", """WITH p AS (SELECT p_brand || ' ' || p_type AS name, split_part(p_name, ' ', 1) AS part, split_part(p_name, ' ', 2) AS town, p_size FROM part),
v AS (SELECT name || CASE WHEN p_size % 3 = 0 THEN ', ' || part ELSE '' END AS venue, CASE WHEN p_size % 5 = 0 THEN NULL ELSE town END AS city, count(*) AS matches FROM p GROUP BY ALL),
g AS (SELECT venue, lower(replace(split_part(venue, ',', 1), '#', '')) AS base, coalesce(city, '') AS city, matches FROM v),
q AS (SELECT DISTINCT name AS request, lower(replace(name, '#', '')) AS base, 'name' AS how FROM p),
c AS (SELECT q.request, how, g.venue, g.city, sum(g.matches) OVER (PARTITION BY q.request, g.city) AS weight FROM q JOIN g USING (base)),
n AS (SELECT *, first_value(city) OVER (PARTITION BY request ORDER BY city = '', weight DESC, city) AS own FROM c),
r AS (SELECT request, how, string_agg(DISTINCT venue, '|' ORDER BY venue) AS venues FROM n WHERE city IN ('', own) GROUP BY ALL),
t AS (SELECT DISTINCT town AS request FROM p)
SELECT * FROM r UNION ALL SELECT t.request, 'city', string_agg(DISTINCT g.venue, '|' ORDER BY g.venue) FROM t JOIN g ON g.city = t.request GROUP BY t.request""")
def venue_ladder(spark, sf_dir):
    """Grounds are the parts' brands and types, cities the last words of their names; requested are all names and all cities."""
    part = ledger.table(spark, sf_dir, "part")
    name, word = F.concat("p_brand", F.lit(" "), "p_type"), lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    venue = F.concat(name, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(", "), word(1))).otherwise(""))
    venues = part.groupBy(venue.alias("venue"), F.when(F.col("p_size") % 5 != 0, word(2)).alias("city")).agg(F.count("*").alias("matches"))
    asked = part.select(name.alias("request")).union(part.select(word(2).alias("request"))).distinct()
    return groups.resolve_venues(groups.grounds(venues), asked).filter("venues is not null").select("request", "how", F.array_join("venues", "|").alias("venues"))


@register("close_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name[1:4] || name[6:] AS request, name FROM n WHERE length(name) > 4")
def close_names(spark, sf_dir):
    """Names of parts without their fifth letter, each with the name that is closest to it."""
    kind = ledger.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    asked = kind.select(F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")).alias("request"))
    return groups.close_names(asked, kind).groupBy("request").agg(F.max_by("name", "ratio").alias("name"))
