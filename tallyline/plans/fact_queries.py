"""Queries of facts: ranks, quadrants, what recurs across boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import insights

from . import ledger
from .ledger_queries import _r, rounded
from .registry import register


def _economies(spark, sf_dir):
    bowling = ledger.tables(spark, sf_dir)["bowling_innings"]
    return bowling.groupBy("player").agg((6.0 * F.sum("runs") / F.nullif(F.sum("balls"), F.lit(0))).alias("economy"), F.sum("wickets").alias("wickets"))


_ECONOMY = ", e AS (SELECT player, 6.0 * sum(runs) / nullif(sum(balls), 0) AS economy, sum(wickets)::DOUBLE AS wickets FROM bowling GROUP BY 1)"


@register("ranked_facts", ledger.sql(_ECONOMY + f"""\nSELECT count(*) AS n, arg_min(player, (economy, player)) AS best, arg_max(player, (economy, player)) AS worst, {_r('median(economy)', 'median')}, {_r('avg(economy)', 'mean')}, {_r('max(economy) - min(economy)', 'spread')},
  (SELECT string_agg(player, '|' ORDER BY economy, player) FROM (SELECT * FROM e ORDER BY economy, player LIMIT 8)) AS ranked FROM e""", bowling=True))
def ranked_facts(spark, sf_dir):
    found = insights.ranked_facts(_economies(spark, sf_dir), "player", "economy", False)
    return rounded(found.select("n", F.col("best.key").alias("best"), F.col("worst.key").alias("worst"), "median", "mean", "spread", F.array_join(F.transform("ranked", lambda x: x["key"]), "|").alias("ranked")))


@register("scatter_quadrants", ledger.sql(_ECONOMY + """, m AS (SELECT median(economy) AS mx, median(wickets) AS my FROM e), q AS (SELECT player, CASE WHEN economy < mx AND wickets >= my THEN 'both' WHEN economy < mx THEN 'x only' WHEN wickets >= my THEN 'y only' ELSE 'neither' END AS quadrant, wickets / my - economy / mx AS merit FROM e, m)
SELECT player, quadrant, row_number() OVER (PARTITION BY quadrant ORDER BY merit DESC, player)::BIGINT AS place FROM q""", bowling=True))
def scatter_quadrants(spark, sf_dir):
    return rounded(insights.quadrants(_economies(spark, sf_dir), "player", "economy", "wickets", False, True).select("player", "quadrant", "place"))


@register("recurring_players", ledger.sql(_ECONOMY + """, c AS (SELECT player FROM (SELECT * FROM e ORDER BY economy, player LIMIT 12) UNION ALL SELECT player FROM (SELECT * FROM e ORDER BY wickets DESC, player LIMIT 12) UNION ALL SELECT player FROM (SELECT * FROM e ORDER BY player LIMIT 12))
SELECT player, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, player LIMIT 8""", bowling=True))
def recurring_players(spark, sf_dir):
    rows = _economies(spark, sf_dir)
    return insights.recurring({"economy": rows.orderBy("economy", "player").limit(12), "wickets": rows.orderBy(F.desc("wickets"), "player").limit(12), "names": rows.orderBy("player").limit(12)})
