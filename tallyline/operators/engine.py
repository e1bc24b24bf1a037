"""Query views over the innings tables: leaderboards, splits, form, arcs, percentiles, similarity.

Every view is one lazy DataFrame; names are resolved and filters read before it is built. A value that
all rows share, such as the busiest player's sample, is an aggregate of one row that is broadcast, never
a window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import dimensions
from tallyline.functions.metrics import Metric, get
from tallyline.functions.metrics import search as catalog_search  # noqa: F401  (part of this module's surface)
from tallyline.functions.scope import Scope, ScopeError

DEFAULTS = {"batting": ("innings", "runs", "balls", "average", "strike_rate"), "bowling": ("innings", "balls", "runs", "wickets", "average", "economy")}
MOST_ROWS = 200
QUALIFY = (30, 0.1)
QUALIFY_POOL = (60, 0.1)


def metrics_for(role: str, names: Sequence[str] | None, in_phase: bool) -> list[Metric]:
    """Metrics by name; a phase refuses those that it cannot give, and drops them from the defaults."""
    if not names:
        return [m for m in (get(role, n) for n in DEFAULTS[role]) if m.phase or not in_phase]
    found = [get(role, n) for n in names]
    for m in found:
        if in_phase and not m.phase:
            raise ScopeError(f"{m.id} has no meaning within a phase")
    return found


def qualified(df: DataFrame, sample: str = "_balls", least: float = QUALIFY[0], share: float = QUALIFY[1]) -> DataFrame:
    """Rows with a sample of at least max(least, share of the largest sample)."""
    top = df.agg(F.max(sample).alias("_top"))
    return df.crossJoin(F.broadcast(top)).filter(F.col(sample) >= F.greatest(F.lit(float(least)), share * F.col("_top"))).drop("_top")


def top_team(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The commonest team of each key, the smaller name among equals."""
    return df.groupBy(*keys).agg(F.mode("team", True).alias("team"))


def top_teams(df: DataFrame, keys: Sequence[str], most: int = 3) -> DataFrame:
    """keys, teams: each key's commonest teams by matches, commonest first, smaller names first among equals."""
    counts = df.groupBy(*keys, "team").agg(F.countDistinct("match_id").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "team"))
    rows = counts.withColumn("place", place).filter(F.col("place") <= most)
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "team"))), lambda x: x["team"]).alias("teams"))


def named_split(result: DataFrame, split_by: str) -> DataFrame:
    """The column k under its split's name, which gives way to a metric of that name."""
    return result.withColumnRenamed("k", f"{split_by}_no" if split_by in result.columns else split_by)


def upper_median(column: str) -> Column:
    """The upper of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def query_stats(tables: dict[str, DataFrame], role: str = "batting", metrics: Sequence[str] | None = None, players: Sequence[str] | None = None, split_by: str | None = None, sort_by: str | None = None, ascending: bool | None = None, min_balls: int | None = None, limit: int = 25, scope: Scope | None = None, named: bool = False) -> DataFrame:
    """Metrics by player, by player and split value, or, for one named player with a split, by value.

    A leaderboard (no players) is ordered by its metric, better first, nulls last, then by balls and
    player; one on a rate asks for the qualification. Columns: rank, player, team, k, metrics, balls,
    first_date, last_date, as far as they apply. named: k bears the split's name (see named_split).
    """
    scope = scope or Scope({})
    finish = lambda df: named_split(df, split_by) if named and split_by else df
    in_phase = bool(scope.phase) or split_by == "phase"
    if split_by in dimensions.BATTING_ONLY and role != "batting":
        raise ScopeError(f"split_by {split_by!r} is only there for batting")
    if in_phase and split_by in dimensions.NOT_IN_PHASE:
        raise ScopeError(f"split_by {split_by!r} does not go with a phase")
    chosen = metrics_for(role, metrics, in_phase)
    sort = get(role, sort_by) if sort_by else (None if players else chosen[0])
    if sort and in_phase and not sort.phase:
        raise ScopeError(f"{sort.id} cannot sort within a phase")
    base = scope.apply(tables[f"{role}_{'phase' if in_phase else 'innings'}"])
    if players:
        base = base.filter(F.col("player").isin(*players))
    by_player = not (players and len(players) == 1 and split_by)
    keys = (["player"] if by_player else []) + (["k"] if split_by else [])
    if split_by:
        base = base.withColumn("k", dimensions.key(split_by))
    extra = [sort] if sort and sort not in chosen else []
    aggs = [m.column() for m in (*chosen, *extra)]
    own = [F.sum("balls").alias("_balls"), F.count("*").alias("_innings"), F.mode("team", True).alias("team"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    out = base.groupBy(*keys).agg(*aggs, *own) if keys else base.agg(*aggs, *own)
    if min_balls is not None:
        out = out.filter(F.col("_balls") >= min_balls)
    elif not players and sort and sort.rate:
        out = qualified(out)
    shown = [m.id for m in chosen] + [m.id for m in extra]
    if players:
        order = [dimensions.order_key(split_by, F.col("k")), F.col("k")] if split_by else []
        return finish(out.select(*keys, "team", *shown, F.col("_balls").alias("sample"), "first_date", "last_date").orderBy(*(["player"] if by_player else []), *order))
    down = not (ascending if ascending is not None else not sort.higher_is_better)
    value = F.desc_nulls_last(sort.id) if down else F.asc_nulls_last(sort.id)
    order = [value, F.desc("_balls"), *(F.asc(k) for k in keys)]
    top = out.orderBy(*order).limit(max(1, min(limit, MOST_ROWS)))
    return finish(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", *keys, "team", *shown, F.col("_balls").alias("sample"), "first_date", "last_date"))


def luck_leaderboard(tables: dict[str, DataFrame], role: str, unlucky: bool = False, limit: int = 25, scope: Scope | None = None) -> DataFrame:
    return query_stats(tables, role, ["innings", "balls", "runs_luck"], sort_by="runs_luck", ascending=unlucky, limit=limit, scope=scope)


def player_profile(tables: dict[str, DataFrame], player: str, scope: Scope | None = None) -> DataFrame:
    """Both roles, overall and by format: role, k ('all' or a format) and the default metrics' values.
    primary: batting if the player's batting innings are at least half the bowling ones."""
    parts = []
    for role in ("batting", "bowling"):
        base = (scope or Scope({})).apply(tables[f"{role}_innings"]).filter(F.col("player") == player)
        chosen = [get(role, m) for m in DEFAULTS[role]]
        values = F.map_from_arrays(F.array(*(F.lit(m.id) for m in chosen)), F.array(*(m.build() for m in chosen)))
        parts.append(base.withColumn("k", F.explode(F.array(F.lit("all"), F.col("format")))).groupBy("k").agg(values.alias("metrics"), F.count("*").alias("n")).withColumn("role", F.lit(role)))
    both = parts[0].unionByName(parts[1])
    n = both.filter("k = 'all'").agg(F.sum(F.when(F.col("role") == "batting", F.col("n"))).alias("a"), F.sum(F.when(F.col("role") == "bowling", F.col("n"))).alias("b"))
    primary = F.when(F.coalesce("a", F.lit(0)) >= 0.5 * F.coalesce("b", F.lit(0)), "batting").otherwise("bowling")
    return both.crossJoin(F.broadcast(n.select(primary.alias("primary")))).select("role", "k", "n", "metrics", "primary")


#: What makes an innings later than another.
CHRONOLOGICAL = ("date", "match_id", "innings")


def player_form(innings: DataFrame, role: str, metric: str, window: int = 10) -> DataFrame:
    """Each player's innings in order with n, the metric over the last `window` (2 to 100) innings and
    over all so far, and whether the rolling value is the player's peak or trough among full windows."""
    window = max(2, min(window, 100))
    m = get(role, metric)
    order = Window.partitionBy("player").orderBy(*CHRONOLOGICAL)
    out = innings.withColumn("n", F.row_number().over(order))
    out = out.withColumn("rolling", m.framed(order.rowsBetween(-(window - 1), 0))).withColumn("to_date", m.framed(order.rowsBetween(Window.unboundedPreceding, 0)))
    full, own = F.when(F.col("n") >= window, F.col("rolling")), Window.partitionBy("player")
    return out.withColumns({"is_peak": F.coalesce(full == F.max(full).over(own), F.lit(False)), "is_trough": F.coalesce(full == F.min(full).over(own), F.lit(False))})


def rolling_metrics(innings: DataFrame, role: str, metrics: Sequence[str], window: int = 10) -> DataFrame:
    """Each player's innings in order with n and every named metric over the last `window` innings: one
    exchange and one sort for all of them. What places an innings gives way to a metric of its name
    (innings_no)."""
    order = Window.partitionBy("player").orderBy(*CHRONOLOGICAL)
    last = order.rowsBetween(-(max(2, min(window, 100)) - 1), 0)
    return innings.select("player", *(F.col(c).alias(f"{c}_no" if c in metrics else c) for c in CHRONOLOGICAL), F.row_number().over(order).alias("n"), *(get(role, m).framed(last).alias(m) for m in metrics))


def career_arc(innings: DataFrame, role: str, metric: str, players: Sequence[str]) -> DataFrame:
    """Career-to-date values, a column for each player, aligned on the innings number."""
    named = innings.filter(F.col("player").isin(*players))
    order = Window.partitionBy("player").orderBy(*CHRONOLOGICAL)
    rows = named.select("player", F.row_number().over(order).alias("n"), get(role, metric).framed(order.rowsBetween(Window.unboundedPreceding, 0)).alias("v"))
    return rows.groupBy("n").pivot("player", list(players)).agg(F.min("v")).orderBy("n")


def percentiles(innings: DataFrame, role: str, metrics: Sequence[str]) -> DataFrame:
    """player, metric, value, percentile: mid-rank among the qualified, turned round where lower is
    better. Ranks come from the counts of distinct values, so ties are one row."""
    ms = [get(role, m) for m in metrics]
    pool = qualified(innings.groupBy("player").agg(*(m.column() for m in ms), F.sum("balls").alias("_balls")), "_balls", *QUALIFY_POOL)
    pairs = F.explode(F.array(*(F.struct(F.lit(m.id).alias("metric"), F.lit(m.higher_is_better).alias("up"), F.col(m.id).cast("double").alias("value")) for m in ms)))
    rows = pool.select("player", pairs.alias("p")).select("player", "p.*").filter("value is not null")
    counts = rows.groupBy("metric", "value").agg(F.count("*").alias("equal"))
    w = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("equal").over(Window.partitionBy("metric"))
    counts = counts.select("metric", "value", ((F.coalesce(F.sum("equal").over(w), F.lit(0)) + F.col("equal") / 2) / total * 100).alias("p"))
    return rows.join(counts, ["metric", "value"]).select("player", "metric", "value", F.when(F.col("up"), F.col("p")).otherwise(100 - F.col("p")).alias("percentile"))


def scatter(innings: DataFrame, role: str, x: str, y: str, top: int = 5) -> DataFrame:
    """player, x, y of the qualified with the pool's upper medians, z-sum (population deviation, better
    is higher) and whether it is among the `top` largest."""
    mx, my = get(role, x), get(role, y)
    pool = qualified(innings.groupBy("player").agg(mx.build().alias("x"), my.build().alias("y"), F.sum("balls").alias("_balls")), "_balls", *QUALIFY_POOL).filter("x is not null and y is not null")
    stats = pool.agg(upper_median("x").alias("median_x"), upper_median("y").alias("median_y"), *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    sign = lambda m: 1 if m.higher_is_better else -1
    z = sign(mx) * (F.col("x") - F.col("mean_x")) / F.nullif(F.col("sd_x"), F.lit(0.0)) + sign(my) * (F.col("y") - F.col("mean_y")) / F.nullif(F.col("sd_y"), F.lit(0.0))
    rows = pool.crossJoin(F.broadcast(stats)).withColumn("z", z)
    best = rows.orderBy(F.desc_nulls_last("z"), "player").limit(top).select("player", F.lit(True).alias("top"))
    return rows.join(F.broadcast(best), "player", "left").select("player", "x", "y", "median_x", "median_y", "z", F.coalesce("top", F.lit(False)).alias("is_top"))


def entry_heatmap(innings: DataFrame, metric: str = "average") -> DataFrame:
    """Arrival phase by wickets down: innings and the metric."""
    cells = innings.withColumns({"entry": dimensions.key("entry_phase"), "down": dimensions.key("entry_wickets")})
    return cells.groupBy("entry", "down").agg(F.count("*").alias("n"), get("batting", metric).build().alias("value"))


def similar_players(innings: DataFrame, role: str, player: str, features: Sequence[str], limit: int = 10, least: int = 120, share: float = 0.25) -> DataFrame:
    """The nearest players by Euclidean distance of standardised features, score 100 / (1 + d).

    Pool: at least max(least, share of the player's own balls). A missing feature counts as the pool's
    worst. A feature without spread has no say."""
    ms = [get(role, f) for f in features]
    every = innings.groupBy("player").agg(*(m.column() for m in ms), F.sum("balls").alias("_balls"))
    own = every.filter(F.col("player") == player).select(F.col("_balls").alias("_own"))
    pool = every.crossJoin(F.broadcast(own)).filter((F.col("player") == player) | (F.col("_balls") >= F.greatest(F.lit(float(least)), share * F.col("_own"))))
    worst = pool.agg(*((F.min if m.higher_is_better else F.max)(m.id).alias(f"w_{m.id}") for m in ms))
    filled = pool.crossJoin(F.broadcast(worst)).select("player", "_balls", *(F.coalesce(m.id, f"w_{m.id}").alias(m.id) for m in ms))
    stats = filled.agg(*(f(m.id).alias(f"{n}_{m.id}") for m in ms for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    z = filled.crossJoin(F.broadcast(stats)).select("player", "_balls", *(F.coalesce((F.col(m.id) - F.col(f"mean_{m.id}")) / F.nullif(F.col(f"sd_{m.id}"), F.lit(0.0)), F.lit(0.0)).alias(m.id) for m in ms))
    me = z.filter(F.col("player") == player).select(*(F.col(m.id).alias(f"me_{m.id}") for m in ms))
    d = F.sqrt(sum(((F.col(m.id) - F.col(f"me_{m.id}")) ** 2 for m in ms), F.lit(0.0)))
    rows = z.filter(F.col("player") != player).crossJoin(F.broadcast(me)).withColumn("distance", d)
    return rows.orderBy("distance", "player").limit(max(1, min(limit, 50))).select("player", F.col("_balls").alias("sample"), "distance", (100 / (1 + F.col("distance"))).alias("score"))


#: Facet -> (column, most values listed).
FACETS = {"competition": ("event", 150), "team": ("team", 250), "venue": ("venue", 300), "season": ("season", 80)}


def facets(innings: DataFrame, scope: Scope) -> DataFrame:
    """facet, value, n: the values of each facet under all filters but its own, commonest first.

    One scan feeds all facets: a row that every filter takes counts in each of them, one that a single
    filter leaves out in that filter's own facet."""
    failed = {name: ~F.coalesce(c, F.lit(False)) for name, c in zip(scope.filters, scope.columns())}
    failures = sum((c.cast("int") for c in failed.values()), F.lit(0))
    one = lambda name, column: F.when((F.col("_failures") == 0) | failed.get(name, F.lit(False)), F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value")))
    fed = F.filter(F.array(*(one(name, column) for name, (column, _) in FACETS.items())), lambda x: x["value"].isNotNull())
    rows = innings.withColumn("_failures", failures).filter("_failures <= 1").select("match_id", F.explode(fed).alias("f")).select("match_id", "f.*")
    counted = rows.groupBy("facet", "value").agg(F.countDistinct("match_id").alias("n"))
    most = F.create_map(*(F.lit(x) for name, (_, most) in FACETS.items() for x in (name, most)))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).filter((F.col("place") <= max(m for _, m in FACETS.values())) & (F.col("place") <= most[F.col("facet")])).drop("place")


def by_phase(tables: dict[str, DataFrame], role: str, players: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Named players by phase, phases in play order."""
    rows = query_stats(tables, role, metrics, players=players, split_by="phase") if len(players) > 1 else query_stats(tables, role, metrics, players=players, split_by="phase").withColumn("player", F.lit(players[0]))
    return rows.orderBy(dimensions.order_key("phase", F.col("k")), "player")


def compare(tables: dict[str, DataFrame], role: str, players: Sequence[str], metric: str) -> dict[str, DataFrame]:
    """The parts of a comparison: table, percentiles, arc and phases."""
    innings = tables[f"{role}_innings"]
    return {
        "table": query_stats(tables, role, players=players),
        "percentiles": percentiles(innings, role, [metric]).filter(F.col("player").isin(*players)),
        "arc": career_arc(innings, role, metric, players),
        "by_phase": by_phase(tables, role, players),
    }


def season_labels(rows: DataFrame) -> DataFrame:
    """Adds label: the calendar year of a split season if no other season of the rows shows that year."""
    year = F.coalesce(F.year(F.max("date")).cast("string"), F.col("season"))
    seasons = rows.groupBy("season").agg(year.alias("year"))
    alone = seasons.groupBy("year").agg(F.count("*").alias("n"))
    named = seasons.join(alone, "year").select("season", F.when(F.col("n") == 1, F.col("year")).otherwise(F.col("season")).alias("label"))
    return rows.join(named, "season")


def highlights(rows: DataFrame, key: str, metrics: Sequence[Metric], sample: str = "sample", thin: float = 0.25) -> DataFrame:
    """metric, key, value: the best row of each metric; rows of a rate whose sample is under a quarter
    of the upper median sample have no say."""
    median = rows.agg(upper_median(sample).alias("_median"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m.id).alias("metric"), F.lit(m.rate).alias("rate"), F.lit(1.0 if m.higher_is_better else -1.0).alias("sign"), F.col(m.id).cast("double").alias("value")) for m in metrics)))
    long = rows.crossJoin(F.broadcast(median)).select(key, sample, "_median", pairs.alias("p")).select(key, sample, "_median", "p.*")
    fair = long.filter("value is not null").filter(~F.col("rate") | (F.col(sample) >= thin * F.col("_median")))
    best = F.max_by(F.struct(F.col(key).cast("string").alias("key"), "value"), F.struct(F.col("sign") * F.col("value"), F.col(sample)))
    return fair.groupBy("metric").agg(best.alias("b")).select("metric", F.col("b.key").alias(key), F.col("b.value").alias("value"))
