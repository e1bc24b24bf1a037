"""Names that mean the same: components over alias edges, competitions in all their naming eras, grounds by
city, and names by close spelling."""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import norm
from tallyline.sources.stored import cut

#: Spellings are close from this share of matching letters on.
CLOSE = 0.8


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component: the smallest node that can be reached, for every node of an edge.

    Each round every node takes the smallest component of its neighbours and then that one's own, so
    the rounds are about the logarithm of the longest way. A node with very many neighbours is an
    aggregate that is summed up before its exchange, no group of rows."""
    both = edges.filter("a is not null and b is not null").select("a", "b")
    links = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "components")
    while True:
        near = links.join(found, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = found.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("before"))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        found = cut(step.join(up, "next").select("node", F.least("next", "jump").alias("component"), "before"), "components")
        if not found.filter("component != before").limit(1).count():
            return found.select("node", "component")
        found = found.drop("before")


def alike(a: str, b: str) -> float:
    """Twice the letters in matching blocks, found longest first, to the letters of both names."""
    return difflib.SequenceMatcher(None, a, b, False).ratio()


def pieces(name: Column) -> Column:
    """The different pairs of neighbouring letters of a name, its ends being letters too."""
    edged = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(edged) - 1), lambda i: F.substring(edged, i, F.lit(2))))


def close_names(asked: DataFrame, known: DataFrame, least: float = CLOSE) -> DataFrame:
    """asked (request), known (name) -> request, name, ratio of all different pairs with a ratio of at least
    `least`, which is 0.8 or more (below that, close names may share no pair of letters).

    Of two names with T letters together at most (1 - least) T lie in no matching block. Each of these
    spoils at most two pairs of neighbouring letters, so all other pairs are common: names are joined by
    their pairs, lengths and the number of common pairs are compared, then letters, and only what is
    left is matched block by block."""
    if least < CLOSE:
        raise ValueError(f"close names are found from {CLOSE} on")
    asked = asked.filter("request is not null and request != ''").select("request").distinct()
    known = known.filter("name is not null and name != ''").select("name").distinct()
    letters = lambda df, c: df.select(c, F.size(pieces(F.col(c))).alias(f"{c}_pieces"), F.explode(pieces(F.col(c))).alias("p"))
    shared = letters(asked, "request").join(letters(known, "name"), "p").filter("request != name")
    total = F.length("request") + F.length("name")
    shared = shared.filter(2 * F.least(F.length("request"), F.length("name")) >= least * total - 1e-9)
    unlike = F.floor((1 - least) * total + 1e-9)
    pairs = shared.groupBy("request", "name").agg(F.count("*").alias("n"), F.max(F.greatest("request_pieces", "name_pieces")).alias("most"))
    pairs = pairs.filter(F.col("n") >= F.col("most") - 2 * unlike).select("request", "name")
    # Letters that one name has over the other, summed over the different letters.
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split("request", "")), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.least(count(F.col("request"), c), count(F.col("name"), c))))
    pairs = pairs.filter(2 * common >= least * total - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [alike(a, b) for a, b in zip(batch.column("request").to_pylist(), batch.column("name").to_pylist())]
            yield batch.append_column("ratio", pa.array(ratios, pa.float64()))

    return pairs.mapInArrow(run, "request string, name string, ratio double").filter(F.col("ratio") >= least)


def competition_groups(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """events (event, matches) and aliases (alias, event: what a name, also an earlier one, stands for) ->
    event, competition (the group's event with most matches, the smaller name among equals), events of
    the group, matches of all. Events whose names differ only in case, accents or punctuation are one;
    so are events that an alias, or a chain of them, connects."""
    named = events.filter("event is not null").groupBy("event").agg(F.sum("matches").alias("matches"))
    key = lambda c: norm(c)
    edges = named.select(key("event").alias("a"), key("event").alias("b")).unionByName(aliases.select(key("alias").alias("a"), key("event").alias("b")))
    grouped = named.withColumn("node", key("event")).join(components(edges), "node").select("event", "matches", "component")
    whole = grouped.groupBy("component").agg(F.min_by("event", F.struct(-F.col("matches"), "event")).alias("competition"), F.sort_array(F.collect_list("event")).alias("events"), F.sum("matches").alias("all"))
    return grouped.join(whole, "component").select("event", "competition", "events", F.col("all").alias("matches"))


def grounds(venues: DataFrame, city_aliases: dict[str, str] | None = None) -> DataFrame:
    """venues (venue, city, matches) -> venue, base, city, matches: the name before its first comma and the
    city, both normalised, renamed cities under one name."""
    city = norm(F.coalesce("city", F.lit("")))
    now = F.create_map(*(F.lit(x) for pair in city_aliases.items() for x in pair))[city] if city_aliases else F.lit(None).cast("string")
    rows = venues.filter("venue is not null").groupBy("venue", F.coalesce(now, city).alias("city")).agg(F.sum("matches").alias("matches"))
    return rows.select("venue", norm(F.split_part("venue", F.lit(","), F.lit(1))).alias("base"), "city", "matches")


def resolve_venues(found: DataFrame, requests: DataFrame, aliases: dict[str, str] | None = None, dominance: float = 3.0) -> DataFrame:
    """grounds() and requests (request) -> request, how, venues, candidates.

    A request is, in this order: a ground's name or an alias of one (a|b: of several), words of a name,
    a city (then all of its grounds are meant), or a close spelling of a name (candidates only). Of
    several names the one with most matches is meant if the next has at most a `dominance`-th; else venues
    is null and the candidates are listed. Of grounds that share a name those of the city with most
    matches are meant, with those of no city. A request that fits nothing has no how."""
    asked = requests.filter("request is not null").select("request").distinct().withColumn("r", norm("request"))
    named = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[F.col("r")] if aliases else F.lit(None).cast("string")
    targets = asked.withColumn("all", F.split(F.coalesce(named, F.col("r")), r"\|")).select("request", "r", F.size("all").alias("n"), F.explode("all").alias("t")).filter("t != ''")
    bases = found.groupBy("base").agg(F.sum("matches").alias("matches"))
    exact = targets.join(bases, F.col("t") == F.col("base")).select("request", "n", "base", "matches", F.lit(0).alias("how"))
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    wanted = targets.select("request", "n", "t", F.size(F.array_distinct(F.split("t", " "))).alias("k"), word("t"))
    within = wanted.join(bases.select("base", "matches", word("base")), "w").groupBy("request", "n", "t", "base", "matches", "k").agg(F.count("*").alias("c")).filter("c = k")
    hits = exact.unionByName(within.select("request", "n", "base", "matches", F.lit(1).alias("how"))).distinct()
    hits = hits.withColumn("best", F.min("how").over(Window.partitionBy("request"))).filter("how = best")
    place = Window.partitionBy("request").orderBy(F.desc("matches"), "base")
    hits = hits.withColumns({"place": F.row_number().over(place), "next": F.lead("matches").over(place)})
    clear = F.max(F.when(F.col("place") == 1, (F.col("n") > 1) | F.coalesce(dominance * F.col("next") <= F.col("matches"), F.lit(True)))).over(Window.partitionBy("request"))
    hits = hits.withColumn("clear", clear)
    meant = hits.filter("clear and (n > 1 or place = 1)").join(found.drop("matches"), "base")
    # A name in several cities: the one with most matches, and what has no city.
    weight = found.groupBy("base", "city").agg(F.sum("matches").alias("weight"))
    first = F.min(F.struct(F.col("city") == "", -F.col("weight"), "city")).over(Window.partitionBy("request"))["city"]
    meant = meant.join(weight, ["base", "city"]).withColumn("own", first).filter("n > 1 or city = '' or city = own")
    by_name = meant.groupBy("request", "how").agg(F.sort_array(F.collect_set("venue")).alias("venues"))
    unclear = hits.filter("not clear and place <= 8").groupBy("request", "how").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "base"))), lambda x: x["base"]).alias("candidates"))
    named = by_name.unionByName(unclear, allowMissingColumns=True)
    rest = asked.join(hits.select("request").distinct(), "request", "left_anti")
    cities = rest.join(found.filter("city != ''"), F.col("r") == F.col("city")).groupBy("request").agg(F.sort_array(F.collect_set("venue")).alias("venues")).withColumn("how", F.lit(2))
    rest = rest.join(cities.select("request"), "request", "left_anti")
    close = close_names(rest.select(F.col("r").alias("request")), bases.select(F.col("base").alias("name"))).withColumnRenamed("request", "r")
    close = rest.join(close, "r").groupBy("request").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("ratio"), "name"))), 1, 5), lambda x: x["name"]).alias("candidates")).withColumn("how", F.lit(3))
    out = named.unionByName(cities, allowMissingColumns=True).unionByName(close, allowMissingColumns=True)
    how = F.get(F.array(*map(F.lit, ("name", "words", "city", "close"))), F.col("how"))
    return asked.select("request").join(out, "request", "left").select("request", how.alias("how"), "venues", "candidates")
