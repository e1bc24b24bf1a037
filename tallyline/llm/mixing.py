"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha lies between 0 (equal
weights) and 1 (the shares themselves) and is found by bisection: the largest alpha whose weights
reach the target entropy, or, if that repeats some source more often than the limit allows, the
smallest alpha that keeps within the limit. The weights become token budgets, and a budget a stream
of whole epochs over the source's documents and a part of one more; each epoch walks the source's
blocks (documents dealt by a hash of their id) in another pseudo-random order, and each block's
documents in another one, so the part is a random choice of blocks plus one block's beginning.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Target entropy of the weights as a share of the largest possible, log(number of sources).
ENTROPY = 0.97
#: Most times that a source may be passed through.
REPEATS = 4.0
#: Documents in one block, about.
BLOCK = 256
#: Blocks in one band of a source's key range, about.
BAND = 1024
#: Exponents tried in one pass over the sources.
TRIED = 31
SEED = 17


def _sums(shares: DataFrame, alphas: list[float]) -> list:
    """For each exponent a the sums over the sources of share**a (z) and of that times log share (l), and
    the largest and smallest share**(a - 1) (m, n). Only these come to the driver."""
    tried = shares.select("share", F.posexplode(F.array(*map(F.lit, alphas))).alias("k", "a"))
    power = F.exp(F.col("a") * F.log("share"))
    sums = {"z": F.sum(power), "l": F.sum(power * F.log("share")), "m": F.max(power / F.col("share")), "n": F.min(power / F.col("share"))}
    return tried.groupBy("k").agg(*(c.alias(n) for n, c in sums.items())).orderBy("k").collect()


def at_exponents(shares: DataFrame, alphas: list[float], budget: float | None) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights share**alpha / sum, and the most passes that any
    source gets. budget: tokens as a multiple of the corpus; None: as many as it takes for every
    source to be passed through once at least."""
    return [(log(r["z"]) - a * r["l"] / r["z"], r["m"] / r["n"] if budget is None else r["m"] / r["z"] * budget) for a, r in zip(alphas, _sums(shares, alphas))]


def _bisect(ok) -> float:
    """The largest alpha in [0, 1] for which ok holds, ok(0) given and ok falling with alpha, to about
    1e-12. ok takes a list: each pass cuts the interval into TRIED + 1 parts instead of two."""
    low, high = 0.0, 1.0
    if ok([1.0])[0]:
        return 1.0
    while high - low > 1e-12:
        tried = [low + (high - low) * (k + 1) / (TRIED + 1) for k in range(TRIED)]
        good = sum(ok(tried))
        low, high = ([low, *tried][good], [*tried, high][good])
    return low


def temperature(shares: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> float:
    """Alpha for the token shares (source, share over 0) of any number of sources."""
    n = shares.count()
    if n < 2:
        return 1.0
    alpha = _bisect(lambda tried: [h >= target * log(n) - 1e-12 for h, _ in at_exponents(shares, tried, budget)])
    (_, here), (_, plain) = at_exponents(shares, [alpha, 1.0], budget)
    if here <= repeats + 1e-9 or plain > repeats + 1e-9:
        return alpha if here <= repeats + 1e-9 else 1.0
    return 1 - _bisect(lambda tried: [p <= repeats + 1e-9 for _, p in at_exponents(shares, [1 - b for b in tried], budget)])


def counted(docs: DataFrame) -> DataFrame:
    """Adds source_key (null source: '') and n_tokens (words between ASCII white space)."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")
    return docs.withColumn("_source", F.coalesce(F.col("source"), F.lit(""))).withColumn("_tokens", words)


def _hash(*parts):
    return F.xxhash64(*parts)


def schedule(docs: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """From rows (_row, doc_id, _source, _tokens) to (_row, doc_id, source, epoch, n_tokens, weight,
    alpha, block, block_key, doc_key): one row for each time a document is used.

    A document belongs to the mix whole; the last epoch's budget ends with the document that fills
    it. Documents without tokens go along in every whole epoch. Sources with no tokens at all are
    passed through once.
    """
    totals = docs.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = materialize(totals, "mix-sources")
    every = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").select("_source", (F.col("tokens") / F.lit(max(every, 1))).alias("share"))
    alpha = temperature(shares, target, repeats, budget) if every else 1.0
    z, least = next(((r["z"], r["n"]) for r in _sums(shares, [alpha])), (1.0, 1.0))
    weight = F.coalesce(F.exp(alpha * F.log(F.nullif(F.col("tokens"), F.lit(0)) / every)) / z, F.lit(0.0)) if every else F.lit(0.0)
    # How often a source is passed through: its weight over its share, times the budget.
    passes = weight / (F.col("tokens") / F.lit(max(every, 1))) * (z / least if budget is None else budget) if every else F.lit(1.0)
    times = F.when(F.col("tokens") > 0, passes).otherwise(1.0) + 1e-9
    plan = totals.select("_source", weight.alias("weight"), F.lit(alpha).alias("alpha"), F.floor(times).cast("int").alias("whole"), ((times % 1) * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("int").alias("blocks"))
    rows = docs.join(plan, "_source")
    rows = rows.withColumn("block", F.pmod(_hash(F.lit(SEED), "doc_id", "_row"), F.col("blocks")).cast("int"))
    whole = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    # The part of an epoch: blocks in the order of their keys until the budget is met, then within the last block.
    part = rows.filter("rest >= 1").withColumn("epoch", F.col("whole"))
    # A source's blocks lie in bands of its key range: sums over the bands before, then within the band.
    sums = part.groupBy("_source", "epoch", "block", "blocks").agg(F.sum("_tokens").alias("held")).withColumn("key", _hash(F.lit(SEED), "_source", "epoch", "block"))
    bands = F.ceil(F.col("blocks") / BAND)
    sums = sums.withColumn("band", F.least(bands - 1, F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * bands)))
    ahead = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = sums.groupBy("_source", "band").agg(F.sum("held").alias("held"))
    earlier = earlier.select("_source", "band", ahead(Window.partitionBy("_source").orderBy("band")).alias("earlier"))
    sums = sums.join(earlier, ["_source", "band"]).withColumn("ahead", F.col("earlier") + ahead(Window.partitionBy("_source", "band").orderBy("key", "block")))
    sums = sums.select("_source", "block", "ahead")
    part = part.join(sums, ["_source", "block"]).filter("ahead < rest")
    inside = Window.partitionBy("_source", "block").orderBy(_hash(F.lit(SEED), "epoch", "doc_id", "_row"), "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).filter("ahead < rest").drop("ahead")
    keys = _hash(F.lit(SEED), "_source", "epoch", "block").alias("block_key"), _hash(F.lit(SEED), "epoch", "doc_id", "_row").alias("doc_key")
    return whole.unionByName(part).select("_row", "doc_id", F.col("_source").alias("source"), "epoch", F.col("_tokens").alias("n_tokens"), "weight", "alpha", "block", *keys)


def _units(docs: DataFrame) -> DataFrame:
    """One row for each document: rows alike in doc_id, source and text go together, with the sum of
    their tokens."""
    rows = counted(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_source", F.xxhash64("text").alias("_row"), "_tokens")
    return materialize(rows.groupBy("doc_id", "_source", "_row").agg(F.sum("_tokens").alias("_tokens")), "mix-tokens")


def mix_plan(docs: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """doc_id, source (null: ''), epoch, n_tokens, weight, alpha, block, block_key, doc_key: one row for
    each time the mix uses a document; (block_key, block, doc_key, doc_id) orders a source's epoch.

    Repeated rows count as one document with the sum of their tokens; null text has no tokens; other
    columns are ignored; an empty table gives no rows.
    """
    return schedule(_units(docs), target, repeats, budget).drop("_row")


def mix(docs: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """The documents as the mix uses them, with all their columns: a document that is used n times
    has n rows (repeated rows each)."""
    used = schedule(_units(docs), target, repeats, budget).groupBy("doc_id", "source", "_row").agg(F.count("*").cast("int").alias("uses"))
    i, s, r, uses, use = unused(docs, "_i", "_s", "_r", "_uses", "_use")
    used = used.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("_row").alias(r), F.col("uses").alias(uses))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.coalesce(F.col("source"), F.lit("")) == F.col(s)) & (F.xxhash64("text") == F.col(r))
    return docs.join(used, same).withColumn(use, F.explode(F.sequence(F.lit(1), F.col(uses)))).select(*docs.columns)
