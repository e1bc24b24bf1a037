"""Curating text corpora: hold-outs, overlap with evaluations, conversation structure, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import norm

ROLES = ("system", "user", "assistant")


def held_out(column, share: int = 15, salt: str = "") -> Column:
    """`share` percent of the entities by a hash that every engine computes alike."""
    digest = F.sha1(F.concat(F.lit(salt), F.col(column).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < share


def weighted_pool(entities: DataFrame, weight: str, least: float) -> DataFrame:
    """Entities of at least `least` weight, drawn by the root of it: share of the pool."""
    rows = entities.filter(F.col(weight) >= least).withColumn("root", F.sqrt(weight))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("root").alias("_all")))).withColumn("share", F.col("root") / F.col("_all")).drop("root", "_all")


def overlapping(texts: DataFrame, items: DataFrame, text: str = "text", same=norm) -> DataFrame:
    """Texts that equal an evaluation item once normalised by `same`. norm leaves nothing of many a text,
    which tells nothing; with another one, empty texts are equal like any others."""
    keys = items.select(same(text).alias("_n")).distinct()
    if same is norm:
        keys = keys.filter("_n <> ''")
    return texts.withColumn("_n", same(text)).join(keys, "_n", "left_semi").drop("_n")


def without_overlap(texts: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    keys = items.select(norm(text).alias("_n")).filter("_n <> ''").distinct()
    return texts.withColumn("_n", norm(text)).join(keys, "_n", "left_anti").drop("_n")


def leaks(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """(text row, name): held-out one-word names that occur as whole words, by a join on the words."""
    words = texts.select("*", F.explode(F.array_distinct(F.split(F.lower(text), r"\W+"))).alias("_w"))
    return words.join(names.select(F.lower(name).alias("_w"), F.col(name).alias("leaked")).distinct(), "_w").drop("_w")


#: Signs that may stand about a word and are no part of it.
_ABOUT = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def leaked_names(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """texts with leaked, a name of one or more words that stands whole in the text: its words in a row, as
    they are written, and no word that begins with a capital right after them ('Nepal', not 'Nepal
    Premier League'). One row for each text row and name; null texts and names have none.

    The names' lengths in words are a few; all groups of so many words of a text are joined with the
    names by equality, so neither table need be small."""
    known = names.select(F.trim(F.regexp_replace(name, r"\s+", " ")).alias("_name")).filter("_name != ''").distinct()
    lengths = known.select(F.size(F.split("_name", " ")).alias("_k")).groupBy("_k").count().select("_k")
    bare = lambda w: F.regexp_replace(w, _ABOUT, "")
    rows = texts.withColumns({"_id": F.monotonically_increasing_id(), "_words": F.filter(F.split(text, r"\s+"), lambda w: w != "")}).filter(F.size("_words") > 0)
    rows = rows.crossJoin(F.broadcast(lengths))  # a few lengths
    places = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.col("_k") + 1, F.lit(1)))
    at = rows.filter(F.size("_words") >= F.col("_k")).withColumn("_at", F.explode(places))
    last = F.element_at("_words", F.col("_at") + F.col("_k") - 1)
    inner = F.transform(F.slice("_words", F.col("_at"), F.col("_k")), lambda w, i: F.when((i == 0) & (F.col("_k") == 1), bare(w)).when(i == 0, F.regexp_replace(w, r"^[^\p{L}\p{N}]+", "")).when(i == F.col("_k") - 1, F.regexp_replace(w, r"[^\p{L}\p{N}]+$", "")).otherwise(w))
    goes_on = last.rlike(r"[\p{L}\p{N}]$") & F.coalesce(F.try_element_at("_words", F.col("_at") + F.col("_k")).rlike("^[A-Z]"), F.lit(False))
    found = at.filter(~goes_on).withColumn("_name", F.array_join(inner, " ")).join(known, "_name")
    return found.dropDuplicates(["_id", "_name"]).withColumn("leaked", F.col("_name")).select(*texts.columns, "leaked")


def call_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, kind, call_id; kind is 'call', 'result' or anything else) -> conv_id, calls, fault
    (the first one) and ok: each result closes an open call of its id, no id is opened twice before it is
    closed, none stays open, and a call's result is the turn right after it ('late' if not).

    What is open of one id is told by that id's turns before, so the groups are those of single calls."""
    rows = turns.withColumn("_next", F.lead("call_id").over(Window.partitionBy("conv_id").orderBy("turn")))
    mine = rows.filter(F.col("kind").isin("call", "result"))
    own = Window.partitionBy("conv_id", "call_id").orderBy("turn")
    before, after = F.lag("kind").over(own), F.lead("kind").over(own)
    fault = (
        F.when((F.col("kind") == "result") & ~F.coalesce(before == "call", F.lit(False)), "result without call")
        .when((F.col("kind") == "call") & (before == "call"), "call twice")
        .when((F.col("kind") == "call") & after.isNull(), "call without result")
        .when((F.col("kind") == "call") & ~F.coalesce(F.col("_next") == F.col("call_id"), F.lit(False)), "late")
    )
    found = mine.withColumn("fault", fault).groupBy("conv_id").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct("turn", "call_id"))).alias("fault"))
    return turns.select("conv_id").distinct().join(found, "conv_id", "left").select("conv_id", F.coalesce("calls", F.lit(0)).alias("calls"), "fault", F.col("fault").isNull().alias("ok"))


def undo_trivial(pairs: DataFrame) -> DataFrame:
    """pairs (original, rewrite) with undone: rewrites that change only capitals, signs or spacing add no
    variety and give way to the original. A null rewrite is the original too."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    same = F.coalesce(key("original") == key("rewrite"), F.col("rewrite").isNull())
    return pairs.withColumns({"undone": same, "rewrite": F.when(same, F.col("original")).otherwise(F.col("rewrite"))})


def conversation_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turns, ok and the first fault: conversations open with system or user, have known roles,
    numbered turns without gaps, no role twice in a row, no empty text, and close with the assistant."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    first = F.row_number().over(w) == 1
    fault = (
        F.when(~F.col("role").isin(*ROLES), "unknown role")
        .when(first & ~F.col("role").isin("system", "user"), "opens wrongly")
        .when(F.col("turn") != F.row_number().over(w) - 1, "gap")
        .when(F.col("role") == F.lag("role").over(w), "role twice")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty")
        .when(last & (F.col("role") != "assistant"), "closes wrongly")
    )
    rows = turns.withColumn("fault", fault)
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("turn"))).alias("fault")).withColumn("ok", F.col("fault").isNull())


def ungrounded_numbers(turns: DataFrame) -> DataFrame:
    """Assistant turns with numbers that no earlier turn of the conversation has: conv_id, turn, numbers."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), 0))
    rows = turns.withColumn("own", numbers)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.flatten(F.collect_list("own").over(w))
    return rows.withColumn("loose", F.array_sort(F.array_except("own", seen))).filter((F.col("role") == "assistant") & (F.size("loose") > 0)).select("conv_id", "turn", "loose")


def accepted_paraphrases(pairs: DataFrame, growth: float = 2.5) -> DataFrame:
    """Pairs (original, rewrite) that keep every number, are at most `growth` times as long, and differ
    by more than case and punctuation."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), 0)
    kept = F.size(F.array_except(numbers("original"), numbers("rewrite"))) == 0
    return pairs.filter(kept & (F.length("rewrite") <= growth * F.length("original")) & (norm("original") != norm("rewrite")))


def length_stats(texts: DataFrame, keys: tuple = (), text: str = "text") -> DataFrame:
    """n, median, p95 and longest in units of four characters."""
    n = F.length(text) / 4
    return texts.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.95)).alias("p95"), F.max(n).alias("longest"))


def tool_choice(rows: DataFrame) -> DataFrame:
    """From expected_tool, tool, expected_args, args (JSON text) to shares by tool: same tool, valid JSON,
    same arguments, required arguments present."""
    want, got = F.from_json("expected_args", "map<string,string>"), F.from_json("args", "map<string,string>")
    same = F.col("tool").eqNullSafe(F.col("expected_tool"))
    exact = F.array_sort(F.map_entries(want)) == F.array_sort(F.map_entries(got))
    present = F.size(F.array_except(F.map_keys(want), F.map_keys(got))) == 0
    valid = F.try_parse_json("args").isNotNull()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy("expected_tool").agg(F.count("*").alias("n"), share(same).alias("tool"), share(valid).alias("valid"), share(same & exact).alias("exact"), share(same & present).alias("required"))


def answers(rows: DataFrame) -> DataFrame:
    """One row from expected (array of tokens), answer, calls, seconds: share right, mean calls, median seconds."""
    words = F.transform(F.split(F.lower("answer"), r"[^a-z0-9.]+"), lambda w: F.regexp_replace(w, r"\.+$", ""))
    right = F.size(F.array_except(F.transform("expected", lambda t: F.lower(t)), words)) == 0
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("right"), F.avg("calls").alias("calls"), F.median("seconds").alias("seconds"))
