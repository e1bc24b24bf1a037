"""Resolving plain words to players, teams, venues, formats.

The catalog is a table of names with their weight (matches). Candidates are found by blocking on the
last name and scored natively; only the few best rows of one request come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import initials_fit, norm, tokens

from .groups import close_names

#: Scores by kind of agreement, and what a misspelt last name costs.
EXACT, GIVEN, INITIALS, LAST, MISSPELT = 100, 85, 75, 60, 30
#: How close a spelling must be, and how many last names a misspelt one may mean.
CLOSE, SPELLINGS = 0.8, 4


def catalog(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(player, matches, international) plus aliases (player, alias) -> player, norm_name, last, given, matches, international."""
    rows = names.select("player", "matches", "international", F.col("player").alias("name"))
    if aliases is not None:
        rows = rows.unionByName(names.join(aliases, "player").select("player", "matches", "international", F.col("alias").alias("name")))
    t = tokens("name")
    return rows.select("player", "matches", "international", norm("name").alias("norm_name"), F.try_element_at(t, F.lit(-1)).alias("last"), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("given"))


def rank_players(cat: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request) -> request, player, score, base, matches, place: agreement of the names (base), plus 20 log10(matches
    + 1), plus 8 for internationals. Exact names, then the same last name with fitting given names or
    initials; if there are none, last names of close spelling (matching blocks) whose given names fit, at 30 less."""
    t = tokens("request")
    asked = requests.select("request", norm("request").alias("r_norm"), F.try_element_at(t, F.lit(-1)).alias("r_last"), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("r_given"))
    bonus = 20 * F.log10(F.coalesce("matches", F.lit(0)) + 1) + F.when(F.col("international"), 8).otherwise(0)
    block = cat.join(asked, F.col("last") == F.col("r_last"))
    whole = F.forall(F.zip_with("r_given", "given", lambda a, b: a.eqNullSafe(b)), lambda x: x)
    base = F.when(F.col("norm_name") == F.col("r_norm"), EXACT).when(F.size("r_given") == 0, LAST).when(whole, GIVEN).when(initials_fit(F.col("r_given"), F.col("given")), INITIALS)
    named = block.withColumn("base", base.cast("double")).withColumn("score", F.col("base") + bonus).filter("score is not null")
    unknown = asked.join(named.select("request").distinct(), "request", "left_anti")
    spelt = close_names(unknown.select(F.col("r_last").alias("request")), cat.select(F.col("last").alias("name")), CLOSE)
    nearest = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("ratio"), F.desc("name")))
    spelt = spelt.withColumn("place", nearest).filter(F.col("place") <= SPELLINGS).select(F.col("request").alias("r_last"), F.col("name").alias("last"))
    near = unknown.join(spelt, "r_last").join(cat, "last")
    fits = F.when(F.size("r_given") == 0, LAST).when(whole, GIVEN).when(initials_fit(F.col("r_given"), F.col("given")), INITIALS)
    typo = near.withColumn("base", (fits - MISSPELT).cast("double")).withColumn("score", F.col("base") + bonus).filter("score is not null").select(*named.columns)
    rows = named.unionByName(typo).groupBy("request", "player").agg(F.max(F.struct("score", "base", "matches")).alias("m"))
    return rows.select("request", "player", "m.*").withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "player")))


def decide(ranked: DataFrame) -> DataFrame:
    """request, player, candidates: the first, unless another is about as likely meant; then player is
    null and the candidates are listed. Where the last name is all there is, that is a second one with
    over a third of the first's matches; else one within 4 points and with over half of them."""
    top = ranked.filter("place <= 5").groupBy("request").agg(F.sort_array(F.collect_list(F.struct("place", "player", "score", "base", "matches"))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    known = lambda times: second["matches"] * times > first["matches"]
    doubt = F.when(first["base"] <= LAST, known(3)).otherwise((first["score"] - second["score"] < 4) & known(2))
    clear = ~F.coalesce(doubt, F.lit(False))
    return top.select("request", F.when(clear, F.get("c", F.lit(0))["player"]).alias("player"), F.transform("c", lambda x: x["player"]).alias("candidates"))


def autocomplete(cat: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    p = prefix.strip().lower()
    rows = cat.filter(F.col("norm_name").startswith(p) | F.col("last").startswith(p)).groupBy("player").agg(F.max("matches").alias("matches"))
    return rows.orderBy(F.desc("matches"), "player").limit(limit)


def venues(matches: DataFrame) -> DataFrame:
    """raw venue -> base (before the first comma, dots dropped, normalised) and city, with all raw names of the group."""
    base = norm(F.split_part("venue", F.lit(","), F.lit(1)))
    rows = matches.filter("venue is not null").groupBy(base.alias("base"), F.coalesce("city", F.lit("")).alias("city")).agg(F.sort_array(F.collect_set("venue")).alias("names"), F.count("*").alias("matches"))
    return rows


def containing(groups: DataFrame, column: str, words: str, weight: str = "matches", dominance: float = 3.0) -> DataFrame:
    """Groups whose name holds all words; only the first if it outweighs the second `dominance` times."""
    hits = groups
    for w in words.lower().split():
        hits = hits.filter(F.array_contains(F.split(column, " "), w))
    ranked = hits.orderBy(F.desc(weight), column).limit(50)
    second = ranked.agg(F.sort_array(F.collect_list(weight), False).alias("w")).select(F.coalesce(F.get("w", F.lit(0)) >= dominance * F.coalesce(F.get("w", F.lit(1)), F.lit(0)), F.lit(True)).alias("clear"), F.get("w", F.lit(0)).alias("top"))
    return ranked.crossJoin(F.broadcast(second)).filter(~F.col("clear") | (F.col(weight) == F.col("top"))).drop("clear", "top")


#: How a name was found, best first; and the share of a name that a misspelt one must match.
HOW, NEAR = ("exact", "alias", "words", "close"), 0.75


def entities(names: DataFrame, requests: DataFrame, aliases: dict[str, str] | None = None, groups: Sequence[Sequence[str]] = (), dominance: float = 3.0) -> DataFrame:
    """Teams, competitions or venues: names (name, weight) and requests (request) -> request, name, how,
    names, candidates.

    A request is a name itself, an alias of one, words that all stand in one, or a misspelt name. Of
    several the heaviest is meant if it outweighs the second `dominance` times; else name is null
    and the candidates are listed. names: all of the group (former names) that the name belongs to.
    Words and three-letter pieces are joined by equality, so neither table need be small.
    """
    known = names.filter("name is not null").select("name", "weight", norm("name").alias("n"))
    asked = requests.select("request", norm("request").alias("r")).filter("r <> ''").distinct()
    hit = lambda df, how: df.select("request", "name", "weight", F.lit(HOW.index(how)).alias("how"))
    exact = hit(known.join(asked, F.col("n") == F.col("r")), "exact")
    meant = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[F.col("r")] if aliases else F.lit(None).cast("string")
    named = hit(asked.withColumn("name", meant).filter("name is not null").join(known, "name"), "alias")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    wanted = asked.select("request", F.size(F.array_distinct(F.split("r", " "))).alias("k"), words("r"))
    within = wanted.join(known.select("name", "weight", words("n")), "w").groupBy("request", "name", "weight", "k").agg(F.count("*").alias("c")).filter("c = k")
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).alias("p")
    pairs = asked.select("request", "r", pieces(F.col("r"))).join(known.select("name", "weight", "n", pieces(F.col("n"))), "p").select("request", "r", "name", "weight", "n").distinct()
    near = pairs.filter(1 - F.levenshtein("r", "n") / F.greatest(F.length("r"), F.length("n")) >= NEAR)
    rows = exact.unionByName(named).unionByName(hit(within, "words")).unionByName(hit(near, "close"))
    best = F.min("how").over(Window.partitionBy("request"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("weight"), "name"))
    rows = rows.withColumn("best", best).filter("how = best").withColumn("place", place).filter("place <= 8")
    found = rows.groupBy("request", "how").agg(F.sort_array(F.collect_list(F.struct("place", "name", "weight"))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    clear = F.coalesce(first["weight"] >= dominance * second["weight"], F.lit(True))
    name = F.when(clear, first["name"])
    every = {n: list(g) for g in groups for n in g}
    of = F.create_map(*(x for n, g in every.items() for x in (F.lit(n), F.array(*map(F.lit, g)))))[name] if every else F.lit(None).cast("array<string>")
    out = found.select("request", name.alias("name"), F.element_at(F.array(*map(F.lit, HOW)), F.col("how") + 1).alias("how"), F.coalesce(of, F.when(name.isNotNull(), F.array(name))).alias("names"), F.transform("c", lambda x: x["name"]).alias("candidates"))
    return requests.select("request").distinct().join(out, "request", "left")


# Words for formats, genders and phases.
FORMATS = {"t20": "T20", "twenty20": "T20", "t20i": "T20I", "odi": "ODI", "one day": "ODI", "test": "Test", "first class": "first-class", "list a": "List A"}
GENDERS = {"men": "male", "mens": "male", "male": "male", "m": "male", "women": "female", "womens": "female", "female": "female", "w": "female", "f": "female"}
PHASE_WORDS = {"powerplay": "powerplay", "pp": "powerplay", "middle": "middle", "middle overs": "middle", "death": "death", "death overs": "death", "slog": "death"}


def word(text: str, table: dict[str, str], what: str) -> str:
    found = table.get(" ".join(text.lower().replace("-", " ").replace("'", "").split()))
    if not found:
        raise ValueError(f"unknown {what} {text!r}; try one of: {', '.join(sorted(set(table.values())))}")
    return found


def lookup(cat: DataFrame, words: Sequence[str]) -> DataFrame:
    spark = cat.sparkSession
    return decide(rank_players(cat, spark.createDataFrame([(w,) for w in words], "request string")))
