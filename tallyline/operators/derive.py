"""From balls to innings: running state, expectations, appearances, innings and phase tables.

balls, the flagged ledger, has: match_id, innings, seq (total order within the innings), over, batter,
non_striker, bowler, team, opposition, venue, event, gender, fgroup, format, season, yr, date, result,
faced, legal, wide, noball, four, six, dot (booleans), runs_batter, runs_total, bowler_runs,
wickets (an array, see flags), what flags.wicket_columns() makes of it, phase.

All windows and sums of one match share one exchange on match_id: nothing after it is joined but small
tables that are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import flags
from tallyline.functions.metrics import SHRUNK

MATCH = ("team", "opposition", "venue", "event", "gender", "fgroup", "format", "season", "yr", "date", "result")
CELL = ("fgroup", "gender", "innings", "state_over", "wkts")
#: Balls below which a year's cell gives way to that of all years.
THIN = 300
ERA_YEARS, ERA_POSITIONS, CONTEXT_POSITIONS, FIRST = 2, 11, 7, 5


def flag(deliveries: DataFrame, matches: DataFrame, phase_ends: dict | None = None) -> DataFrame:
    """Deliveries with their match's data and the row flags; super overs (marked, or innings over 2 of
    limited-overs games where there is no mark) are left out. Old tables without the array wickets have
    the one wicket of kind and player_out. Draws and ties are told from matches without a result by
    the match's result_type, where there is one."""
    m = matches.withColumn("fgroup", flags.format_group()).withColumn("format", flags.format_label()).withColumn("yr", F.year(F.to_date("date")))
    keep = [c for c in m.columns if c not in deliveries.columns or c == "match_id"]
    if "wickets" not in deliveries.columns:
        one = F.struct(F.col("kind"), F.col("player_out"), F.col("fielders") if "fielders" in deliveries.columns else F.lit(None).cast("array<string>").alias("fielders"))
        deliveries = deliveries.withColumn("wickets", F.when(F.col("kind").isNotNull(), F.array(one)))
    d = deliveries.join(m.select(*keep), "match_id")
    d = d.withColumn("wickets", F.transform("wickets", lambda w: F.struct(w["kind"].alias("kind"), w["player_out"].alias("player_out"), w["fielders"].alias("fielders"), F.lit(False).alias("keeper_catch"))))
    over = F.coalesce(F.col("super_over"), F.lit(False)) if "super_over" in deliveries.columns else (F.col("fgroup") != "MULTI") & (F.col("innings") > 2)
    d = d.filter(~over)
    teams = {"team": F.col("batting_team"), "opposition": F.when(F.col("batting_team") == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))}
    kind = F.col("result_type") if "result_type" in matches.columns else F.lit(None).cast("string")
    undecided = F.when(kind == "draw", "drawn").when(kind == "tie", "tied").otherwise("no result")
    result = F.when(F.col("winner").isNull(), undecided).when(F.col("winner") == F.col("batting_team"), "won").otherwise("lost")
    d = d.withColumns(teams | {"result": result, "faced": flags.faced(), "legal": flags.legal(), "wide": flags.count("wides") > 0, "noball": flags.count("noballs") > 0, "bowler_runs": flags.bowler_runs(), "four": flags.boundary(4), "six": flags.boundary(6), "phase": flags.phase(phase_ends)} | flags.wicket_columns())
    d = d.withColumn("dot", F.col("legal") & (F.col("bowler_runs") == 0))
    order = Window.partitionBy("match_id", "innings").orderBy("over", "ball")
    return d.withColumn("seq", F.row_number().over(order))


def identities(players: DataFrame, register: DataFrame) -> DataFrame:
    """(match_id, name) -> person: the register's unique name for the listed id, else the name itself."""
    listed = players.groupBy("match_id", F.col("player").alias("name")).agg(F.min("player_id").alias("identifier"))
    return listed.join(register.select("identifier", "unique_name"), "identifier", "left").select("match_id", "name", F.coalesce("unique_name", "name").alias("person"))


def with_persons(balls: DataFrame, identities: DataFrame) -> DataFrame:
    """Flagged balls with the names of identities() in place of the match's own, in the wickets too. A
    match lists some two dozen names, which travel as a map; unlisted names stay."""
    names = identities.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "person"))).alias("_names"))
    person = lambda c: F.coalesce(F.try_element_at("_names", c), c)
    wicket = lambda w: F.struct(w["kind"].alias("kind"), F.when(w["player_out"].isNotNull(), person(w["player_out"])).alias("player_out"), F.transform(w["fielders"], person).alias("fielders"), w["keeper_catch"].alias("keeper_catch"))
    renamed = balls.join(names, "match_id", "left").withColumns({c: F.when(F.col(c).isNotNull(), person(F.col(c))) for c in ("batter", "non_striker", "bowler")} | {"wickets": F.transform("wickets", wicket)})
    return renamed.drop("_names").withColumns(flags.wicket_columns())


def keepers(players: DataFrame, wickets: DataFrame) -> DataFrame:
    """(match_id, team, keeper): of a side's players the one who stumped in the match, else the one
    with most stumpings overall; ties to the smaller name; sides without any have no row."""
    stumped = wickets.filter(F.col("kind") == "stumped").select("match_id", F.explode("fielders").alias("player"))
    here = stumped.groupBy("match_id", "player").agg(F.count("*").alias("here"))
    career = stumped.groupBy("player").agg(F.count("*").alias("career"))
    ranked = players.join(career, "player").join(here, ["match_id", "player"], "left")
    best = F.min_by("player", F.struct(-F.coalesce("here", F.lit(0)), -F.col("career"), F.col("player")))
    return ranked.groupBy("match_id", "team").agg(best.alias("keeper"))


def with_keeper_catches(balls: DataFrame, keepers: DataFrame) -> DataFrame:
    side = keepers.select("match_id", F.col("team").alias("opposition"), "keeper")
    caught = lambda w: F.coalesce((w["kind"] == "caught") & F.array_contains(w["fielders"], F.col("keeper")), F.lit(False))
    marked = F.transform("wickets", lambda w: F.struct(w["kind"].alias("kind"), w["player_out"].alias("player_out"), w["fielders"].alias("fielders"), caught(w).alias("keeper_catch")))
    return balls.join(side, ["match_id", "opposition"], "left").withColumn("wickets", marked).withColumns(flags.wicket_columns())


def state(balls: DataFrame) -> DataFrame:
    """Adds score and wkts before the ball and ball_no, the striker's balls faced so far, this one included."""
    innings = Window.partitionBy("match_id", "innings").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("match_id", "innings", "batter").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    wicket = F.col("outs")
    return balls.withColumns({
        "score": F.coalesce(F.sum("runs_total").over(innings), F.lit(0)),
        "wkts": F.least(F.coalesce(F.sum(wicket).over(innings), F.lit(0)), F.lit(flags.STATE_WICKETS)),
        "ball_no": F.sum(F.col("faced").cast("int")).over(own),
        "state_over": flags.state_over(),
    })


def _mean(value: Column) -> Column:
    return F.avg(value.cast("double"))


#: Measures that only faced balls count for; the others count every delivery.
FACED = {"e_runs", "e_outs", "x_inplay_runs", *(f"x_bat_{k}" for k in ("dot", "four", "six", "inplay", "bowled", "lbw", "ct_keeper", "ct_field", "ct_bowler", "stumped", "run_out"))}


def _measures() -> dict[str, tuple[Column, Column]]:
    """Expected value -> (condition under which a ball counts, its value)."""
    every = F.lit(True)
    out = {
        "e_runs": (F.col("faced"), F.col("runs_batter")),
        "e_outs": (F.col("faced"), flags.striker_out()),
        "e_bowl_runs": (every, F.col("bowler_runs")),
        "e_bowl_wkts": (every, F.col("credited")),
        "x_inplay_runs": (F.col("faced"), F.when(flags.in_play(), F.col("runs_batter")).otherwise(0)),
    }
    for name, c in flags.components("batting").items():
        out[f"x_bat_{name}"] = (F.col("faced"), c)
    for name, c in flags.components("bowling").items():
        out[f"x_bowl_{name}"] = (every, c)
    return out


def expectation(states: DataFrame, thin: int = THIN) -> DataFrame:
    """Mean outcomes of each state and year; a year's cell of fewer than `thin` balls takes the means
    over all years of its state. Sums are formed once by year and added up for the fallback."""
    measures = _measures()
    yearly = states.groupBy(*CELL, "yr").agg(
        F.count("*").alias("n"), F.sum(F.col("faced").cast("int")).alias("n_faced"),
        *(F.sum(F.when(on, v.cast("double")).otherwise(0.0)).alias(k) for k, (on, v) in measures.items()),
    )
    every = yearly.groupBy(*(F.col(c).alias(f"_{c}") for c in CELL)).agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "n_faced", *measures)))
    joined = yearly.join(every, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL])
    keep = F.col("n") >= thin

    def mean(name: str) -> Column:
        n = "n_faced" if name in FACED else "n"
        return F.when(keep, F.col(name) / F.nullif(F.col(n), F.lit(0))).otherwise(F.col(f"all_{name}") / F.nullif(F.col(f"all_{n}"), F.lit(0))).alias(name)

    return joined.select(*CELL, "yr", "n", *(mean(k) for k in measures))


def _looked_up(rows: DataFrame, table: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows with the values of a small table (a row for each key, nulls equal). The key is one struct that
    the table is grouped by, so Spark drops the join where no value is asked for."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    one = F.struct(*(F.col(c).alias(c) for c in key)).cast("struct<" + ",".join(f"{c}:{types[c]}" for c in key) + ">")  # nullable on both sides
    once = table.groupBy(one.alias("_key")).agg(*(F.first(c).alias(c) for c in values))
    return rows.withColumn("_own", one).join(F.broadcast(once), F.col("_own") == F.col("_key"), "left").drop("_own", "_key")


def expected(states: DataFrame, table: DataFrame) -> DataFrame:
    """Balls with their state's expected values; states match null-safely. The table has a row for each
    state and year, however many balls there are."""
    return _looked_up(states, table, (*CELL, "yr"), list(_measures()))


def by_match(balls: DataFrame, shares: int | None = None) -> DataFrame:
    """Balls dealt by match: the one exchange that the innings and phase tables need. shares: over how many tasks,
    so that what a task sorts stays small; else as many as the session's setting says."""
    return balls.repartition("match_id") if shares is None else balls.repartition(shares, "match_id")


#: What is kept of the ball of a player's arrival, under which name.
_AT_ARRIVAL = {"over": "entry_over", "score": "entry_score", "wkts": "entry_wkts"} | {c: c for c in MATCH}


def _takers(balls: DataFrame) -> DataFrame:
    """A row for each player in each ball: player, at (the order of arrival, null for a dismissal),
    strikes (the striker's own row), gone (seq, n and kind of a dismissal)."""
    gone = lambda w, n: F.struct(F.col("seq").cast("long").alias("seq"), n.alias("n"), w["kind"].alias("kind"))
    one = lambda player, at, strikes, g: F.struct(player.alias("player"), at.cast("long").alias("at"), F.lit(strikes).alias("strikes"), g.alias("gone"))
    none = F.lit(None).cast("struct<seq:bigint,n:int,kind:string>")
    here = [one(F.col("batter"), F.col("seq") * 2, True, none), one(F.col("non_striker"), F.col("seq") * 2 + 1, False, none)]
    outs = F.filter(F.transform("wickets", lambda w, n: one(w["player_out"], F.lit(None), False, gone(w, n))), lambda x: x["gone"]["kind"].isNotNull() & ~x["gone"]["kind"].isin(*flags.NOT_OUT))
    rows = balls.withColumn("_w", F.explode(F.when(F.col("outs") > 0, F.concat(F.array(*here), outs)).otherwise(F.array(*here))))
    return rows.withColumns({c: F.col(f"_w.{c}") for c in ("player", "at", "strikes", "gone")}).drop("_w").filter("player is not null")


def _arrival() -> dict[str, Column]:
    return {"arrived": F.min("at")} | {f"_at_{c}": F.min_by(c, "at") for c in _AT_ARRIVAL}


def _placed(place: Column) -> list[Column]:
    """The columns of appearances() from those of _arrival()."""
    return [F.col("match_id"), F.col("innings"), F.col("player"), F.col("arrived"), place.alias("position"), *(F.col(f"_at_{c}").alias(name) for c, name in _AT_ARRIVAL.items())]


def _place() -> Column:
    return F.row_number().over(Window.partitionBy("match_id", "innings").orderBy("arrived", "player"))


def appearances(balls: DataFrame) -> DataFrame:
    """Who batted when: striker or partner, with position by first appearance (the striker before the
    partner on the same ball), and the state at arrival."""
    rows = _takers(by_match(balls)).filter("at is not null")
    first = rows.groupBy("match_id", "innings", "player").agg(*(c.alias(k) for k, c in _arrival().items()))
    return first.select(*_placed(_place()))


def _sum(c: Column, kind: str = "long") -> Column:
    return F.coalesce(F.sum(c.cast(kind)), F.lit(0).cast(kind))


def _faced() -> dict[str, Column]:
    """Sums over the balls that a player strikes."""
    mine, f = F.col("strikes"), F.col("strikes") & F.col("faced")
    early = f & (F.col("ball_no") <= FIRST)
    of = lambda on, v: F.when(on, v)
    sums = {"balls": _sum(f), "runs": _sum(of(mine, F.col("runs_batter"))), "fours": _sum(mine & F.col("four")), "sixes": _sum(mine & F.col("six")), "dots": _sum(f & (F.col("runs_batter") == 0)), "balls_first5": _sum(early), "runs_first5": _sum(of(early, F.col("runs_batter")))}
    sums |= {"e_runs": _sum(of(f, F.col("e_runs")), "double"), "e_outs": _sum(of(f, F.col("e_outs")), "double"), "e_first5": _sum(of(early, F.col("e_runs")), "double")}
    sums |= {"inplay_runs": _sum(of(mine & flags.in_play(), F.col("runs_batter"))), "x_inplay_runs": _sum(of(f, F.col("x_inplay_runs")), "double")}
    for name, c in flags.components("batting").items():
        sums |= {f"n_{name}": _sum(mine & c), f"x_{name}": _sum(of(f, F.col(f"x_bat_{name}")), "double")}
    return sums


def dismissals(balls: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """match_id, innings, *keep, n, kind, player: a row for each dismissal, the second on a ball too."""
    rows = balls.filter("outs > 0").select("match_id", "innings", *keep, F.posexplode("wickets").alias("n", "w"))
    return rows.select("match_id", "innings", *keep, "n", "w.kind", F.col("w.player_out").alias("player")).filter(flags.dismissal() & F.col("player").isNotNull())


def _outs() -> dict[str, Column]:
    """Whether a player went, and how first."""
    return {"out": F.coalesce(F.max(F.col("gone").isNotNull().cast("long")), F.lit(0).cast("long")), "_gone": F.min("gone")}


def batting_innings(balls: DataFrame) -> DataFrame:
    """One row for each batter and innings, those who never faced a ball included. balls: expected(),
    dealt by_match()."""
    sums = _faced()
    rows = _takers(balls).groupBy("match_id", "innings", "player").agg(*(c.alias(k) for k, c in (_arrival() | sums | _outs()).items()))
    rows = rows.filter("arrived is not null")
    return rows.select(*_placed(_place()), *sums, "out", F.col("_gone.kind").alias("kind"))


def batting_phases(balls: DataFrame) -> DataFrame:
    """One row for each batter, innings and phase with a ball faced or a dismissal."""
    sums = _faced()
    rows = _takers(balls).groupBy("match_id", "innings", "player", "phase").agg(*(c.alias(k) for k, c in (_arrival() | sums | _outs()).items()))
    own = Window.partitionBy("match_id", "innings", "player")
    rows = rows.withColumns({f"_at_{c}": F.min_by(f"_at_{c}", "arrived").over(own) for c in MATCH} | {"arrived": F.min("arrived").over(own)}).filter("arrived is not null")
    place = F.dense_rank().over(Window.partitionBy("match_id", "innings").orderBy("arrived", "player"))
    kept = [k for k in sums if k != "balls"]
    # what no ball was faced for counts as nothing, even if it was a wide's
    plain = lambda k: F.when(F.col("balls") > 0, F.col(k)).otherwise(F.lit(0).cast("double" if k.startswith(("e_", "x_")) else "long")).alias(k)
    rows = rows.select(*_placed(place), "phase", "balls", *(plain(k) for k in kept), "out", F.col("_gone.kind").alias("kind"))
    rows = rows.filter("phase is not null and (balls > 0 or out > 0)")
    return rows.select("match_id", "innings", "player", "phase", *sums, "out", "kind", "position", *MATCH)


def maidens(balls: DataFrame) -> DataFrame:
    """Overs of six legal balls or more without a run to the bowler."""
    overs = balls.groupBy("match_id", "innings", "bowler", "over").agg(_sum(F.col("legal")).alias("legal"), _sum(F.col("bowler_runs")).alias("runs"))
    return overs.groupBy("match_id", "innings", "bowler").agg(_sum((F.col("legal") >= 6) & (F.col("runs") == 0)).alias("maidens"))


def _bowled(balls: DataFrame, keys: Sequence[str], more: dict[str, Column] | None = None) -> DataFrame:
    sums = {"deliveries": F.count("*"), "balls": _sum(F.col("legal")), "runs": _sum(F.col("bowler_runs")), "wickets": _sum(F.col("credited")), "fours": _sum(F.col("four")), "sixes": _sum(F.col("six")), "dots": _sum(F.col("dot")), "e_runs": _sum(F.col("e_bowl_runs"), "double"), "e_wkts": _sum(F.col("e_bowl_wkts"), "double")}
    sums |= {"inplay_runs": _sum(F.when(flags.in_play(), F.col("runs_batter"))), "x_inplay_runs": _sum(F.when(F.col("faced"), F.col("x_inplay_runs")), "double")}
    for name, c in flags.components("bowling").items():
        sums |= {f"n_{name}": _sum(c), f"x_{name}": _sum(F.col(f"x_bowl_{name}"), "double")}
    swap = {"team": F.min("opposition"), "opposition": F.min("team"), "result": F.min(F.when(F.col("result") == "won", "lost").when(F.col("result") == "lost", "won").otherwise(F.col("result")))}
    rest = {c: F.min(c) for c in MATCH if c not in swap}
    return balls.groupBy("match_id", "innings", F.col("bowler").alias("player"), *keys).agg(*(c.alias(k) for k, c in (sums | swap | rest | (more or {})).items()))


def bowling_innings(balls: DataFrame) -> DataFrame:
    """One row for each bowler and innings. balls: expected(), by_match(). An over's totals stand on its balls, and
    its last one tells whether it was a maiden, so that no second table is joined."""
    balled = Window.partitionBy("match_id", "innings", "bowler", "over").orderBy("seq")
    over = balled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = balls.withColumns({"_legal": F.sum(F.col("legal").cast("int")).over(over), "_runs": F.sum("bowler_runs").over(over), "_ball": F.row_number().over(balled)})
    maiden = (F.col("_ball") == 1) & (F.col("_legal") >= 6) & (F.col("_runs") == 0)
    return _bowled(rows, (), {"maidens": _sum(maiden)}).withColumn("maidens", F.when(F.col("player").isNotNull(), F.col("maidens")))


def bowling_phases(balls: DataFrame) -> DataFrame:
    return _bowled(balls.filter("phase is not null"), ("phase",))


def match_context(innings: DataFrame, role: str) -> DataFrame:
    """Adds mc_runs and mc_outs (mc_wkts): what the match's others did, the match's totals less one's
    own, shared out over one's innings in the match. Batting counts positions to CONTEXT_POSITIONS."""
    outs, name = ("out", "mc_outs") if role == "batting" else ("wickets", "mc_wkts")
    counted = F.col("position") <= CONTEXT_POSITIONS if role == "batting" else F.lit(True)
    match, own = Window.partitionBy("match_id"), Window.partitionBy("match_id", "player")
    of = lambda c, w: F.sum(F.when(counted, F.col(c)).otherwise(0)).over(w)
    n = F.count("*").over(own)
    return innings.withColumns({"mc_runs": (of("runs", match) - of("runs", own)) / n, name: (of(outs, match) - of(outs, own)) / n})


def era_baseline(batting: DataFrame, years: int = ERA_YEARS) -> DataFrame:
    """(gender, fgroup, position, yr) -> era_runs, era_outs per innings within +-years, positions to
    ERA_POSITIONS. Each year's sums are sent to the years they count for; of those only the years that have
    sums of their own are kept, so the innings are passed once."""
    yearly = batting.filter(F.col("position") <= ERA_POSITIONS).groupBy("gender", "fgroup", "position", "yr").agg(F.sum("runs").alias("r"), F.sum("out").alias("o"), F.count("*").alias("n"))
    sent = yearly.withColumn("for", F.explode(F.sequence(F.col("yr") - years, F.col("yr") + years))).withColumn("own", F.col("for") == F.col("yr"))
    wide = sent.groupBy("gender", "fgroup", "position", F.col("for").alias("yr"))
    means = wide.agg((F.sum("r") / F.sum("n")).alias("era_runs"), (F.sum("o") / F.sum("n")).alias("era_outs"), F.max("own").alias("held"))
    return means.filter("held").drop("held")


def with_era(batting: DataFrame) -> DataFrame:
    return _looked_up(batting, era_baseline(batting), ("gender", "fgroup", "position", "yr"), ("era_runs", "era_outs"))


def attach_k(innings: DataFrame, stability: DataFrame, role: str, default_gender: str = "male") -> DataFrame:
    """Adds k_<metric> from a study's rows (role, fgroup, gender, metric, k): one's own gender's, else
    the default one's."""
    wide = stability.filter(F.col("role") == role).groupBy("fgroup", "gender").pivot("metric", list(SHRUNK[role])).agg(F.min("k"))
    own = wide.select(F.col("fgroup").alias("_f"), F.col("gender").alias("_g"), *(F.col(m).alias(f"_own_{m}") for m in SHRUNK[role]))
    other = wide.filter(F.col("gender") == default_gender).select(F.col("fgroup").alias("_f2"), *(F.col(m).alias(f"_other_{m}") for m in SHRUNK[role]))
    out = innings.join(F.broadcast(own), (F.col("fgroup") == F.col("_f")) & (F.col("gender") == F.col("_g")), "left").join(F.broadcast(other), F.col("fgroup") == F.col("_f2"), "left")
    return out.withColumns({f"k_{m}": F.coalesce(f"_own_{m}", f"_other_{m}") for m in SHRUNK[role]}).select(*innings.columns, *(f"k_{m}" for m in SHRUNK[role]))


def constant_k(innings: DataFrame, role: str, k: float) -> DataFrame:
    return innings.withColumns({f"k_{m}": F.lit(float(k)) for m in SHRUNK[role]})


def build(balls: DataFrame) -> dict[str, DataFrame]:
    """All derived tables but for the study's constants, from flagged balls."""
    states = state(balls)
    full = expected(by_match(states), expectation(states))
    batting = with_era(match_context(batting_innings(full), "batting"))
    return {"states": full, "batting_innings": batting, "batting_phase": batting_phases(full), "bowling_innings": match_context(bowling_innings(full), "bowling"), "bowling_phase": bowling_phases(full)}
