"""Row-level rules of the ledger: what a ball counts as, phases, format groups, labels.

A ledger is a table of balls: ordered events inside an innings of a match, each with a striker, a
partner, a bowler, runs, extras and any number of wickets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds that are credited to the bowler, and those that are no dismissal.
CREDITED = ("bowled", "caught", "caught and bowled", "lbw", "stumped", "hit wicket")
NOT_OUT = ("retired hurt", "retired not out")
# Match types of the two limited-overs groups, and where their phases end (overs from 0).
GROUPS = {"T20": ("T20", "IT20"), "ODI": ("ODI", "ODM")}
PHASE_ENDS = {"T20": (6, 15), "ODI": (10, 40)}
PHASES = ("powerplay", "middle", "death")
STATE_OVERS, STATE_BLOCK, STATE_BLOCKS, STATE_WICKETS = 49, 10, 15, 9


def count(name: str) -> Column:
    """A number that may be null, as 0."""
    return F.coalesce(F.col(name), F.lit(0))


def faced() -> Column:
    """Not a wide; a no-ball is faced."""
    return count("wides") == 0


def legal() -> Column:
    return (count("wides") == 0) & (count("noballs") == 0)


def bowler_runs() -> Column:
    """All but byes, leg-byes and penalties."""
    return (count("runs_total") - count("byes") - count("legbyes") - count("penalty")).cast("int")


def boundary(runs: int) -> Column:
    return (count("runs_batter") == runs) & ~F.coalesce(F.col("non_boundary"), F.lit(False))


def dismissal(kind: str = "kind") -> Column:
    return F.col(kind).isNotNull() & ~F.col(kind).isin(*NOT_OUT)


def credited(kind: str = "kind") -> Column:
    return F.coalesce(F.col(kind).isin(*CREDITED), F.lit(False))


#: The wickets of one ball, in order.
WICKETS = "array<struct<kind:string,player_out:string,keeper_catch:boolean>>"
#: What a ball's wickets are counted as: component -> condition over one of them.
WICKET_COMPONENTS = {
    "bowled": lambda w: w["kind"] == "bowled",
    "lbw": lambda w: w["kind"] == "lbw",
    "ct_keeper": lambda w: (w["kind"] == "caught") & w["keeper_catch"],
    "ct_field": lambda w: (w["kind"] == "caught") & ~F.coalesce(w["keeper_catch"], F.lit(False)),
    "ct_bowler": lambda w: w["kind"] == "caught and bowled",
    "stumped": lambda w: w["kind"] == "stumped",
    "hit_wicket": lambda w: w["kind"] == "hit wicket",
    "run_out": lambda w: w["kind"] == "run out",
}


def wicket_columns() -> dict[str, Column]:
    """What the wickets of a ball (column wickets, null as none) amount to: outs (dismissals), credited
    (those that are the bowler's), one w_<component> count each, and the striker's own dismissal as
    striker_kind and striker_keeper. Balls without wickets, nearly all, skip the work."""
    some = F.size("wickets") > 0
    n = lambda of: F.when(some, F.size(F.filter("wickets", of))).otherwise(0)
    gone = lambda w: w["kind"].isNotNull() & ~w["kind"].isin(*NOT_OUT)
    own = F.when(some, F.get(F.filter("wickets", lambda w: gone(w) & (w["player_out"] == F.col("batter"))), F.lit(0)))
    out = {"outs": n(gone), "credited": n(lambda w: w["kind"].isin(*CREDITED)), "striker_kind": own["kind"], "striker_keeper": F.coalesce(own["keeper_catch"], F.lit(False))}
    return out | {f"w_{k}": n(of) for k, of in WICKET_COMPONENTS.items()}


def striker_out() -> Column:
    return F.col("striker_kind").isNotNull()


def in_play() -> Column:
    """A faced ball that was scored off without a boundary."""
    return F.col("faced") & (F.col("runs_batter") > 0) & ~F.col("four") & ~F.col("six")


def format_group(match_type: str = "match_type") -> Column:
    out = F.lit("MULTI")
    for group, types in GROUPS.items():
        out = F.when(F.col(match_type).isin(*types), group).otherwise(out)
    return out


def format_label(match_type: str = "match_type", team_type: str = "team_type") -> Column:
    kind, national = F.col(match_type), F.col(team_type) == "international"
    return F.when((kind == "IT20") | ((kind == "T20") & national), "T20I").when(kind == "ODM", "List A").when(kind == "MDM", "first-class").otherwise(kind)


def phase(ends: dict | None = None) -> Column:
    """Phase by the over (from 0) within the format group; null where a format has none."""
    out = F.lit(None).cast("string")
    for group, (first, second) in (ends or PHASE_ENDS).items():
        bands = F.when(F.col("over") < first, PHASES[0]).when(F.col("over") < second, PHASES[1]).otherwise(PHASES[2])
        out = F.when(F.col("fgroup") == group, bands).otherwise(out)
    return out


def state_over() -> Column:
    """The over as a state of the game: blocks of ten in long games, else the over itself, capped."""
    return F.when(F.col("fgroup") == "MULTI", F.least(F.floor(F.col("over") / STATE_BLOCK), F.lit(STATE_BLOCKS))).otherwise(F.least("over", F.lit(STATE_OVERS))).cast("int")


#: Overs at which an arrival counts as early, middle or late, in each format group.
ENTRY_ENDS = {"T20": (6, 15), "ODI": (10, 40), "MULTI": (20, 60)}
ENTRY = ("early", "middle", "late")


def entry_phase(ends: dict | None = None) -> Column:
    out = F.lit(None).cast("string")
    for group, (first, second) in (ends or ENTRY_ENDS).items():
        bands = F.when(F.col("entry_over") < first, ENTRY[0]).when(F.col("entry_over") < second, ENTRY[1]).otherwise(ENTRY[2])
        out = F.when(F.col("fgroup") == group, bands).otherwise(out)
    return out


def overs_text(balls: Column) -> Column:
    """57 balls are 9.3 overs."""
    return F.concat((balls / 6).cast("long").cast("string"), F.lit("."), (balls % 6).cast("long").cast("string"))


def components(role: str) -> dict[str, Column]:
    """Outcome components of a flagged ball: 14 of a delivery (bowling; wickets are counts, as one ball
    may have several), 11 of a faced ball and its striker (batting)."""
    out = {"dot": F.col("dot"), "four": F.col("four"), "six": F.col("six"), "inplay": in_play()}
    if role == "bowling":
        return out | {"wide": F.col("wide"), "noball": F.col("noball")} | {k: F.col(f"w_{k}") for k in WICKET_COMPONENTS}
    kind, keeper = F.col("striker_kind"), F.col("striker_keeper")
    own = {"bowled": kind == "bowled", "lbw": kind == "lbw", "ct_keeper": (kind == "caught") & keeper, "ct_field": (kind == "caught") & ~keeper, "ct_bowler": kind == "caught and bowled", "stumped": kind == "stumped", "run_out": kind == "run out"}
    return {k: F.col("faced") & F.coalesce(c, F.lit(False)) for k, c in (out | own).items()}
