"""Facts about result tables: columns, series, scatters, thin samples, coverage, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTLIER, FLAT, BANDS = 2.0, 0.05, (0.4, 0.7)
#: Samples under which a figure is called thin.
THIN = {"balls": 120, "overs": 20, "innings": 8, "matches": 5}


def column_facts(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, median, sd (sample), lowest, highest."""
    c = F.col(column).cast("double")
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_samp(c).alias("sd"), F.min(c).alias("lowest"), F.max(c).alias("highest"))


#: How many rows a digest names at each level of detail.
NAMED = (3, 5, 8)


def ranked_facts(rows: DataFrame, key: str, column: str, higher_is_better: bool = True, detail: int = 2) -> DataFrame:
    """One row: n, best and worst (key, value), median, mean, spread, ranked (the first few, with rank; of
    three rows or more) and leader_share, the best one's part of the total where that is above 0. Nulls
    have no say; of equal values the smaller key is better."""
    value = F.col(column).cast("double")
    kept = rows.filter(value.isNotNull()).select(F.col(key).cast("string").alias("key"), value.alias("value"))
    better, worse = (F.desc("value"), F.asc("value")) if higher_is_better else (F.asc("value"), F.desc("value"))
    top = kept.orderBy(better, "key").limit(NAMED[detail]).withColumn("rank", F.row_number().over(Window.orderBy(better, "key")))
    ranked = top.agg(F.sort_array(F.collect_list(F.struct("rank", "key", "value"))).alias("ranked"))
    last = kept.orderBy(worse, F.desc("key")).limit(1).select(F.struct("key", "value").alias("worst"))
    stats = kept.agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("spread"), F.sum("value").alias("total"))
    out = stats.crossJoin(F.broadcast(ranked)).join(F.broadcast(last), F.lit(True))
    first = F.get("ranked", F.lit(0))
    return out.select("n", F.struct(first["key"].alias("key"), first["value"].alias("value")).alias("best"), "worst", "median", "mean", "spread", F.when(F.col("n") > 2, F.col("ranked")).alias("ranked"), F.when(F.lit(higher_is_better) & (F.col("total") > 0), first["value"] / F.col("total")).alias("leader_share"))


def quadrants(rows: DataFrame, key: str, x: str, y: str, higher_x: bool = True, higher_y: bool = True) -> DataFrame:
    """key, x, y, quadrant ('both', 'x only', 'y only', 'neither': where the row is at least as good as the
    median) and place, its rank in its quadrant by the sum of both over the medians' size. Rows without
    both values are left out."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    kept = rows.filter(X.isNotNull() & Y.isNotNull()).select(F.col(key).alias(key), X.alias("x"), Y.alias("y"))
    middle = kept.agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    good = lambda v, m, up: (F.col(v) >= F.col(m)) == F.lit(up)
    size = lambda m: F.when(F.col(m) == 0, 1.0).otherwise(F.abs(m))
    gx, gy = good("x", "mx", higher_x), good("y", "my", higher_y)
    where = F.when(gx & gy, "both").when(gx, "x only").when(gy, "y only").otherwise("neither")
    merit = (1 if higher_x else -1) * F.col("x") / size("mx") + (1 if higher_y else -1) * F.col("y") / size("my")
    found = kept.crossJoin(F.broadcast(middle)).withColumns({"quadrant": where, "_merit": merit})
    return found.withColumn("place", F.row_number().over(Window.partitionBy("quadrant").orderBy(F.desc("_merit"), key))).select(key, "x", "y", "quadrant", "place")


def recurring(cards: dict[str, DataFrame], key: str = "player", most: int = 8) -> DataFrame:
    """key, n: what stands in more than one of the cards that have such a column, commonest first."""
    own = [df.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct() for df in cards.values() if key in df.columns]
    every = own[0] if own else next(iter(cards.values())).select(F.lit(None).cast("string").alias(key)).limit(0)
    for df in own[1:]:
        every = every.unionByName(df)
    return every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), key).limit(most)


def board_digest(name: str, cards: dict[str, tuple[DataFrame, str, str, bool]], budget: int = 7000) -> str:
    """A board (title -> rows, key, column, whether higher is better) as text of at most `budget` characters: each
    card's facts and what recurs across cards. Detail is lowered until it fits; then cards are cut
    from the end and counted. Only facts come to the driver."""
    facts = {title: ranked_facts(rows, key, column, up).first() for title, (rows, key, column, up) in cards.items()}
    again = [r[0] for r in recurring({t: c[0] for t, c in cards.items()}).collect()]
    figure = lambda v: "-" if v is None else f"{v:,.2f}".rstrip("0").rstrip(".")
    for detail in (2, 1, 0):
        parts = [name]
        for title, f in facts.items():
            if not f["n"]:
                parts.append(f"{title}: no result")
                continue
            names = ", ".join(f"{r['key']} {figure(r['value'])}" for r in (f["ranked"] or [f["best"]])[: NAMED[detail]])
            rest = f"; median {figure(f['median'])}, spread {figure(f['spread'])}" if detail else ""
            parts.append(f"{title} ({f['n']}): {names}; last {f['worst']['key']} {figure(f['worst']['value'])}{rest}")
        if again:
            parts.append("in several cards: " + ", ".join(again))
        if sum(map(len, parts)) + len(parts) <= budget:
            return "\n".join(parts)
    return digest(parts, budget)


def outliers(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Rows at least OUTLIER deviations off the mean: key, value, z, share of the total."""
    stats = rows.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("sd"), F.sum(column).alias("total"))
    z = (F.col(column) - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(stats)).select(key, F.col(column).cast("double").alias("value"), z.alias("z"), (F.col(column) / F.nullif(F.col("total"), F.lit(0.0))).alias("share")).filter(F.abs("z") >= OUTLIER)


def series_facts(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key: slope, mean, trend (flat under FLAT of the mean for each step), where the peak and trough are, latest against the mean."""
    agg = rows.groupBy(*keys).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.avg(y).alias("mean"), F.max_by(x, F.struct(F.col(y), -F.col(x))).alias("peak"), F.min_by(x, F.struct(F.col(y), F.col(x))).alias("trough"), F.max_by(y, x).alias("latest"))
    trend = F.when(F.abs("slope") < FLAT * F.abs("mean"), "flat").when(F.col("slope") > 0, "rising").otherwise("falling")
    return agg.withColumns({"trend": trend, "latest_over_mean": F.col("latest") / F.nullif(F.col("mean"), F.lit(0.0))})


def correlation_facts(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    r = rows.groupBy(*keys).agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count("*").alias("n"))
    size = F.abs("r")
    return r.withColumn("strength", F.when(size >= BANDS[1], "strong").when(size >= BANDS[0], "moderate").otherwise("weak"))


def thin_samples(rows: DataFrame, kind: str, sample: str) -> DataFrame:
    return rows.filter(F.col(sample) < THIN[kind])


def regressed_gap(rows: DataFrame, raw: str, regressed: str, least: float = 0.05) -> DataFrame:
    """Rows whose regressed value is more than `least` of it away from the raw one."""
    return rows.withColumn("gap", (F.col(raw) - F.col(regressed)) / F.nullif(F.abs(regressed), F.lit(0.0))).filter(F.abs("gap") > least)


def digest(parts: Sequence[str], budget: int = 7000) -> str:
    """Parts in their order until the characters are used up; what does not fit is counted."""
    out, used = [], 0
    for k, part in enumerate(parts):
        if used + len(part) > budget:
            out.append(f"({len(parts) - k} more left out)")
            break
        out.append(part)
        used += len(part) + 1
    return "\n".join(out)


# --- coverage ----------------------------------------------------------------------------------------------------


def coverage(held: DataFrame, missing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys: held, missing, pct of all known, in one pass over each side."""
    a = held.groupBy(*keys).agg(F.count("*").alias("held"))
    b = missing.groupBy(*keys).agg(F.count("*").alias("missing"))
    both = a.join(b, list(keys), "full").fillna(0, subset=["held", "missing"])
    return both.withColumn("pct", 100.0 * F.col("held") / F.nullif(F.col("held") + F.col("missing"), F.lit(0)))


def missing_list(missing: DataFrame, words: str | None, columns: Sequence[str], order: Sequence[str], limit: int = 50) -> DataFrame:
    """The missing in whose columns the words occur, in any case, with the number of all such rows."""
    rows = missing
    if words:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.col(c).ilike(f"%{words}%")
        rows = rows.filter(hit)
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(*order).limit(limit)


def gaps(missing: DataFrame, first: Column, last: Column) -> DataFrame:
    """The missing whose date lies between a player's first and last appearance."""
    return missing.filter(F.col("date").between(first, last))


# --- audits --------------------------------------------------------------------------------------------------------


def check(name: str, observed: Column, expected: Column, tolerance: float = 0.0) -> Column:
    """A struct (name, observed, expected, ok): within the tolerance, relative to the expected."""
    o, e = observed.cast("double"), expected.cast("double")
    return F.struct(F.lit(name).alias("name"), o.alias("observed"), e.alias("expected"), (F.abs(o - e) <= tolerance * F.abs(e)).alias("ok"))


def checks(one_row: DataFrame, *found: Column) -> DataFrame:
    return one_row.select(F.explode(F.array(*found)).alias("c")).select("c.*")


def conserved(balls: DataFrame, innings: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Runs, balls and dismissals of the innings table against the balls'; a player is out once in an
    innings."""
    from tallyline.operators.derive import dismissals

    a = balls.agg(F.sum("runs_batter").alias("b_runs"), F.count_if("faced").alias("b_balls"))
    gone = dismissals(balls).select("match_id", "innings", "player").distinct().agg(F.count("*").alias("b_outs"))
    a = a.crossJoin(F.broadcast(gone))  # one row each
    b = innings.agg(F.sum("runs").alias("i_runs"), F.sum("out").alias("i_outs"), F.sum("balls").alias("i_balls"))
    c = F.col
    return checks(a.crossJoin(F.broadcast(b)), check("runs", c("i_runs"), c("b_runs"), tolerance), check("balls", c("i_balls"), c("b_balls"), tolerance), check("outs", c("i_outs"), c("b_outs"), tolerance))


def zero_sum(innings: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Expected runs and catches add up to the observed ones."""
    s = lambda n: F.sum(n)
    return checks(innings.agg(s("runs").alias("r"), s("e_runs").alias("er"), s("n_ct_field").alias("c"), s("x_ct_field").alias("ec")), check("expected_runs", F.col("er"), F.col("r"), tolerance), check("expected_catches", F.col("ec"), F.col("c"), 2 * tolerance))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent has; null keys are no orphans."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def gate(new: DataFrame, old: DataFrame, most: float = 0.005) -> DataFrame:
    """The checks that a rebuilt table must pass before it takes the old one's place: no column lost,
    rows at all, and no more than the tolerated share of them lost."""
    lost = F.lit(float(len(set(old.columns) - set(new.columns))))
    rows = new.agg(F.count("*").alias("n")).crossJoin(F.broadcast(old.agg(F.count("*").alias("o"))))
    least = F.ceil(F.col("o") * (1 - most))
    found = [F.struct(F.lit(n).alias("name"), o.cast("double").alias("observed"), e.cast("double").alias("expected"), ok.alias("ok")) for n, o, e, ok in (("columns lost", lost, F.lit(0), lost == 0), ("rows", F.col("n"), least, (F.col("n") > 0) & (F.col("n") >= least)))]
    return checks(rows, *found)


def best_and_worst(rows: DataFrame, key: str, column: str, higher_is_better: bool = True) -> DataFrame:
    """One row: the keys with the best and the worst value (smaller keys among equals) and the values."""
    value = F.col(column).cast("double")
    order = F.struct((value if higher_is_better else -value).alias("v"), F.col(key).alias("k"))
    back = F.struct((-value if higher_is_better else value).alias("v"), F.col(key).alias("k"))
    kept = rows.filter(F.col(column).isNotNull())
    best, worst = F.min_by(F.struct(F.col(key).alias("k"), value.alias("v")), back), F.min_by(F.struct(F.col(key).alias("k"), value.alias("v")), order)
    return kept.agg(best.alias("b"), worst.alias("w")).select(F.col("b.k").alias("best"), F.col("b.v").alias("best_value"), F.col("w.k").alias("worst"), F.col("w.v").alias("worst_value"))


def frozen(frozen_totals: DataFrame, recomputed: DataFrame, derived: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose totals differ between the frozen record, a recomputation and the derived table."""
    r = recomputed.select(key, *(F.col(c).alias(f"r_{c}") for c in columns))
    d = derived.select(key, *(F.col(c).alias(f"d_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}")) & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    return frozen_totals.join(r, key, "left").join(d, key, "left").filter(~same)
