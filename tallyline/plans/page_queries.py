"""Queries that read pages: coverage and missing matches, on pages that Spark writes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.sources import outline

from . import ledger
from .registry import register

_ORDERS = """o AS (SELECT r_name AS region, n_name AS nation, c_mktsegment IN ('BUILDING', 'MACHINERY') AS women, o_orderstatus = 'F' AS done, o_orderdate, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _orders(spark, sf_dir):
    t = lambda name: ledger.table(spark, sf_dir, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("page_id"), F.col("n_name").alias("nation"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("women"), (F.col("o_orderstatus") == "F").alias("done"), "o_orderdate", "o_custkey", "o_orderstatus")


def _table(rows, keys, order, *columns):
    """keys, html: a table row for each row, in order."""
    line = F.concat(F.lit("<tr>"), *(x for c in columns for x in (F.lit("<td class='x'>"), c, F.lit("</td>\n"))), F.lit("</tr>"))
    lines = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("h")))).alias("r"))
    return lines.select(*keys, F.concat(F.lit("<TABLE><tr><th>Competition</th><th>a</th><th>b</th></tr>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</TABLE>")).alias("html"))


def _coverage_pages(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    counted = orders.groupBy("page_id", "nation", "women").agg(F.count("*").alias("total"), F.count_if("done").alias("have"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    month = lambda c: F.date_format(c, "MMM yyyy")
    of = F.concat(F.format_number("have", 0), F.lit(" of "), F.format_number("total", 0))
    percent = F.format_string("%.1f", 100 * F.col("have") / F.col("total"))
    name = F.concat(F.lit("<a href='#'>"), F.col("nation"), F.lit("</a> &amp; Sons"))
    keys = ["page_id", "women"]
    periods = _table(counted, keys, "nation", name, month("first"), month("last")).withColumnRenamed("html", "p")
    numbers = _table(counted, keys, "nation", name, of, percent).withColumnRenamed("html", "n")
    teams = counted.groupBy("page_id", "nation").agg(F.sum("have").alias("have"), F.sum("total").alias("total"))
    teams = _table(teams, ["page_id"], "nation", F.col("nation"), of, F.lit("")).withColumnRenamed("html", "t")
    both = periods.join(numbers, keys).groupBy("page_id").agg(*(F.max(F.when(F.col("women") == w, F.col(c))).alias(f"{c}{int(w)}") for w in (False, True) for c in "pn"))
    text = lambda s: F.lit(s)
    html = F.concat(
        text("<h3>Time <b>periods</b></h3><h4>Women's Matches</h4>"), F.coalesce("p1", text("")), text("<!-- <h4>Hidden</h4> --><h4>Men&#39;s Matches</h4>"), F.coalesce("p0", text("")), text("<h3>Numbers of matches</h3><h4>By Competition</h4>"),
        F.coalesce("n0", text("")), text("<h6>Women</h6>"), F.coalesce("n1", text("")), text("<h6>Men</h6>"), F.coalesce("n0", text("")), text("<h4>By Team</h4>"), "t", text("<h3>Other</h3>"), "t",
    )
    return both.join(teams, "page_id").select("page_id", html.alias("html"))


_CELLS = f"WITH {_ORDERS}, c AS (SELECT region, nation, women, count(*) AS total, count(*) FILTER (done) AS have, min(o_orderdate) AS first, max(o_orderdate) AS last FROM o GROUP BY ALL)"


@register("coverage_periods", f"{_CELLS} SELECT region AS page_id, CASE WHEN women THEN 'female' ELSE 'male' END AS gender, 'competition' AS kind, nation || ' & Sons' AS name, strftime(first, '%Y-%m') AS earliest_checked, strftime(last, '%Y-%m') AS earliest_provided FROM c")
def coverage_periods(spark, sf_dir):
    return outline.coverage(_coverage_pages(spark, sf_dir))[0]


@register("coverage_counts", f"""{_CELLS} SELECT region AS page_id, CASE WHEN women THEN 'female' ELSE 'male' END AS gender, 'competition' AS kind, nation || ' & Sons' AS name, have::BIGINT AS have, total::BIGINT AS total, printf('%.1f', 100.0 * have / total)::DOUBLE AS pct FROM c
    UNION ALL SELECT region, NULL, 'team', nation, sum(have)::BIGINT, sum(total)::BIGINT, NULL FROM c GROUP BY ALL""")
def coverage_counts(spark, sf_dir):
    return outline.coverage(_coverage_pages(spark, sf_dir))[1]


def _missing_pages(spark, sf_dir):
    pending = _orders(spark, sf_dir).filter("o_orderstatus = 'P'").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat(F.lit("<dd>"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit(" vs\n "), F.col("nation"), F.lit("</dd>"))
    days = pending.groupBy("page_id", "nation", "women", "day").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("dd"))
    lists = days.groupBy("page_id", "nation", "women").agg(F.sort_array(F.collect_list(F.struct("day", F.concat(F.lit("<dt>"), F.col("day"), F.lit("</dt>"), F.col("dd")).alias("h")))).alias("r"))
    part = F.concat(F.when(F.col("women"), "<h6>Women</h6><dl>").otherwise("<h6>Men</h6><dl>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</dl>"))
    nations = lists.groupBy("page_id", "nation").agg(F.array_join(F.sort_array(F.collect_list(part)), "").alias("h"))
    sections = nations.withColumn("h", F.concat(F.lit("<h5>"), F.initcap("nation"), F.lit(" Matches</h5>"), F.col("h")))
    return sections.groupBy("page_id").agg(F.concat(F.lit("<h3>Missing</h3><dl><dt>x</dt><dd>no vs name</dd></dl><h4>By competition</h4>"), F.array_join(F.sort_array(F.collect_list("h")), "")).alias("html"))


@register("missing_matches", f"WITH {_ORDERS.replace('o_custkey FROM', 'o_custkey, o_orderstatus FROM')} SELECT region AS page_id, 'competition' AS kind, nation AS name, CASE WHEN women THEN 'female' ELSE 'male' END AS gender, strftime(o_orderdate, '%Y-%m-%d') AS date, 'c' || o_custkey AS team1, nation AS team2 FROM o WHERE o_orderstatus = 'P'")
def missing_matches(spark, sf_dir):
    names = ledger.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return outline.missing(_missing_pages(spark, sf_dir), competitions=names)


@register("page_gate", f"{_CELLS} SELECT 'periods' AS \"table\", count(*) AS rows, 'ok' AS verdict FROM c UNION ALL SELECT 'missing', 0, 'fail' UNION ALL SELECT 'withheld', NULL, 'warn'")
def page_gate(spark, sf_dir):
    pages = _coverage_pages(spark, sf_dir)
    return outline.page_gate({"periods": outline.coverage(pages)[0], "missing": outline.missing(pages), "withheld": None})
