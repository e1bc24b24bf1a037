"""The metric registry: each metric is one aggregate expression over rows of an innings table.

Ratios are null where the denominator is 0. e_* are expected counterparts, x_* expected component
counts, n_* observed ones, k_* the sample sizes at which a rate is half skill.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """rate: leaderboards on it need a qualification; phase: has a meaning within a phase."""

    id: str
    label: str
    family: str
    build: Callable[[], Column]
    higher_is_better: bool = True
    rate: bool = False
    phase: bool = False
    kind: str = "number"
    definition: str = ""

    def column(self) -> Column:
        return self.build().alias(self.id)

    def framed(self, window) -> Column:
        """The metric over a window's frame: each aggregate in it is taken over the frame."""
        token = _FRAME.set(window)
        try:
            return self.build()
        finally:
            _FRAME.reset(token)


#: The window that a metric is being built for; none for a group's metric.
_FRAME: ContextVar = ContextVar("frame", default=None)


def over(aggregate: Column) -> Column:
    frame = _FRAME.get()
    return aggregate if frame is None else aggregate.over(frame)


def distinct(name: str) -> Column:
    """How many values a column has; frames know no DISTINCT, so there the set is counted."""
    return F.countDistinct(name).cast("double") if _FRAME.get() is None else F.size(over(F.collect_set(name))).cast("double")


def median(column: Column) -> Column:
    """The median; in frames, which allow none, the mean of the two middle values of the frame's list."""
    if _FRAME.get() is None:
        return F.percentile(column, F.lit(0.5))
    values = F.sort_array(over(F.collect_list(column)))
    at = lambda k: F.get(values, F.floor((F.size(values) + k) / 2).cast("int"))
    return F.when(F.size(values) > 0, (at(-1) + at(0)) / 2)


def s(name: str) -> Column:
    return over(F.sum(F.col(name).cast("double")))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return scale * a / F.nullif(b, F.lit(0.0))


def n_if(condition: Column) -> Column:
    return over(F.sum(F.when(condition, 1.0).otherwise(0.0)))


def rows() -> Column:
    return over(F.count("*")).cast("double")


def shrunk(x: str | tuple, e: str | tuple, n: str, k: str) -> Column:
    """(sum x + K * sum e / sum n) / (sum n + K) with K the sample-weighted mean of k: an observed rate
    drawn towards the expected one."""
    names = lambda v: (v,) if isinstance(v, str) else v
    total = lambda v: sum((s(c) for c in names(v)[1:]), s(names(v)[0]))
    big = ratio(over(F.sum(F.col(n).cast("double") * F.col(k))), s(n))
    return (total(x) + big * ratio(total(e), s(n))) / F.nullif(s(n) + big, F.lit(0.0))


def skill(x: str, e: str, n: str, k: str) -> Column:
    return s(n) * shrunk(x, e, n, k)


def latest_text(key: Column, text: Column) -> Column:
    """The text at the largest key, larger texts first among equals."""
    return over(F.max(F.struct(key.alias("key"), text.alias("text")))).getField("text")


def _batting() -> list[Metric]:
    out: list[Metric] = []
    family = ""

    def m(id, label, build, up=True, **more):
        out.append(Metric(id, label, family, build, up, **more))

    R, P = {"rate": True}, {"phase": True}
    RP = R | P
    family = "traditional"
    m("matches", "Matches", lambda: distinct("match_id"), **P)
    m("innings", "Innings", rows, **P)
    m("not_outs", "Not outs", lambda: rows() - s("out"), **P)
    m("dismissals", "Dismissals", lambda: s("out"), **P)
    m("runs", "Runs", lambda: s("runs"), **P)
    m("balls", "Balls", lambda: s("balls"), **P)
    m("average", "Average", lambda: ratio(s("runs"), s("out")), **RP)
    m("strike_rate", "Strike rate", lambda: ratio(s("runs"), s("balls"), 100), **RP)
    m("highest", "Highest", lambda: latest_text(2 * F.col("runs") + F.when(F.col("out") == 0, 1).otherwise(0), F.concat(F.col("runs").cast("string"), F.when(F.col("out") == 0, "*").otherwise(""))), kind="text")
    m("hundreds", "Hundreds", lambda: n_if(F.col("runs") >= 100))
    m("fifties", "Fifties", lambda: n_if(F.col("runs").between(50, 99)))
    m("ducks", "Ducks", lambda: n_if((F.col("runs") == 0) & (F.col("out") == 1)), up=False)
    m("fours", "Fours", lambda: s("fours"), **P)
    m("sixes", "Sixes", lambda: s("sixes"), **P)
    family = "scoring profile"
    edge = lambda: s("fours") + s("sixes")
    m("dot_pct", "Dot %", lambda: ratio(s("dots"), s("balls"), 100), up=False, **RP)
    m("boundary_pct", "Boundary %", lambda: ratio(edge(), s("balls"), 100), **RP)
    m("boundary_runs_pct", "Runs in boundaries %", lambda: ratio(4 * s("fours") + 6 * s("sixes"), s("runs"), 100), **RP)
    m("balls_per_boundary", "Balls per boundary", lambda: ratio(s("balls"), edge()), up=False, **RP)
    m("balls_per_six", "Balls per six", lambda: ratio(s("balls"), s("sixes")), up=False, **RP)
    m("balls_per_dismissal", "Balls per dismissal", lambda: ratio(s("balls"), s("out")), **RP)
    m("runs_per_innings", "Runs per innings", lambda: ratio(s("runs"), rows()), **RP)
    family = "reliability"
    m("conversion_pct", "Fifties turned into hundreds %", lambda: ratio(n_if(F.col("runs") >= 100), n_if(F.col("runs") >= 50), 100))
    m("thirty_plus_pct", "Innings of 30 or more %", lambda: ratio(n_if(F.col("runs") >= 30), rows(), 100), **R)
    m("median_score", "Median score", lambda: median(F.col("runs").cast("double")))
    m("consistency_cv", "Variation of scores", lambda: over(F.stddev_samp(F.col("runs").cast("double"))) / F.nullif(over(F.avg("runs")), F.lit(0.0)), up=False, **R)
    family = "context"
    e_sr = lambda: ratio(s("e_runs"), s("balls"), 100)
    e_avg = lambda: ratio(s("e_runs"), s("e_outs"))
    avg = lambda: ratio(s("runs"), s("out"))
    m("expected_sr", "Expected strike rate", e_sr, **RP)
    m("true_sr", "Strike rate over expected", lambda: ratio(s("runs"), s("balls"), 100) - e_sr(), **RP)
    m("expected_average", "Expected average", e_avg, **RP)
    m("true_average", "Average over expected", lambda: avg() - e_avg(), **RP)
    m("runs_above_expected", "Runs over expected", lambda: s("runs") - s("e_runs"), **P)
    m("rae_per_innings", "Runs over expected per innings", lambda: ratio(s("runs") - s("e_runs"), rows()), **RP)
    m("match_factor", "Average over the matches' others", lambda: avg() / F.nullif(ratio(s("mc_runs"), s("mc_outs")), F.lit(0.0)), **R)
    m("era_factor", "Average over the era's", lambda: avg() / F.nullif(ratio(s("era_runs"), s("era_outs")), F.lit(0.0)), **R)
    m("first5_sr", "Strike rate, first five balls", lambda: ratio(s("runs_first5"), s("balls_first5"), 100), **R)
    m("true_first5_sr", "First five balls over expected", lambda: ratio(s("runs_first5") - s("e_first5"), s("balls_first5"), 100), **R)
    family = "fielding-independent"
    fr = lambda: s("runs") - s("inplay_runs") + skill("inplay_runs", "x_inplay_runs", "n_inplay", "k_inplay")
    fo = lambda: s("out") - s("n_ct_field") + skill("n_ct_field", "x_ct_field", "balls", "k_ct_field")
    m("fib_average", "Fielding-independent average", lambda: fr() / F.nullif(fo(), F.lit(0.0)), **R)
    m("fib_sr", "Fielding-independent strike rate", lambda: ratio(fr(), s("balls"), 100), **R)
    m("runs_luck", "Runs by luck", lambda: s("runs") - fr())
    m("dismissal_luck", "Dismissals spared by luck", lambda: fo() - s("out"))
    family = "reliability-adjusted"
    m("regressed_sr", "Regressed strike rate", lambda: 100 * shrunk("runs", "e_runs", "balls", "k_runs"), **R)
    m("regressed_average", "Regressed average", lambda: shrunk("runs", "e_runs", "balls", "k_runs") / F.nullif(shrunk("out", "e_outs", "balls", "k_out"), F.lit(0.0)), **R)
    m("regressed_dot_pct", "Regressed dot %", lambda: 100 * shrunk("n_dot", "x_dot", "balls", "k_dot"), up=False, **R)
    m("regressed_boundary_pct", "Regressed boundary %", lambda: 100 * shrunk(("n_four", "n_six"), ("x_four", "x_six"), "balls", "k_boundary"), **R)
    family = "role"
    m("avg_position", "Mean position", lambda: over(F.avg("position")), up=False)
    m("avg_entry_over", "Mean over of arrival", lambda: over(F.avg("entry_over")) + 1, up=False)
    m("avg_entry_wickets", "Mean wickets at arrival", lambda: over(F.avg("entry_wkts")), up=False)
    m("team_win_pct", "Team wins %", lambda: ratio(n_if(F.col("result") == "won"), n_if(F.col("result").isin("won", "lost")), 100))
    return out


def _bowling() -> list[Metric]:
    out: list[Metric] = []
    family = ""

    def m(id, label, build, up=True, **more):
        out.append(Metric(id, label, family, build, up, **more))

    R, P = {"rate": True}, {"phase": True}
    RP = R | P
    family = "traditional"
    m("matches", "Matches", lambda: distinct("match_id"), **P)
    m("innings", "Innings", rows, **P)
    m("balls", "Balls", lambda: s("balls"), **P)
    m("runs", "Runs", lambda: s("runs"), up=False, **P)
    m("wickets", "Wickets", lambda: s("wickets"), **P)
    m("average", "Average", lambda: ratio(s("runs"), s("wickets")), up=False, **RP)
    m("economy", "Economy", lambda: ratio(s("runs"), s("balls"), 6), up=False, **RP)
    m("strike_rate", "Strike rate", lambda: ratio(s("balls"), s("wickets")), up=False, **RP)
    m("best", "Best", lambda: latest_text(100_000 * F.col("wickets") - F.col("runs"), F.concat_ws("/", F.col("wickets").cast("string"), F.col("runs").cast("string"))), kind="text")
    m("four_wkt_hauls", "Four wickets or more", lambda: n_if(F.col("wickets") >= 4))
    m("five_wkt_hauls", "Five wickets or more", lambda: n_if(F.col("wickets") >= 5))
    m("maidens", "Maidens", lambda: s("maidens"))
    family = "scoring profile"
    edge = lambda: s("fours") + s("sixes")
    m("dot_pct", "Dot %", lambda: ratio(s("dots"), s("balls"), 100), **RP)
    m("boundary_pct", "Boundary %", lambda: ratio(edge(), s("balls"), 100), up=False, **RP)
    m("balls_per_boundary", "Balls per boundary", lambda: ratio(s("balls"), edge()), **RP)
    m("wickets_per_innings", "Wickets per innings", lambda: ratio(s("wickets"), rows()), **RP)
    family = "context"
    e_eco = lambda: ratio(s("e_runs"), s("balls"), 6)
    m("expected_economy", "Expected economy", e_eco, up=False, **RP)
    m("true_economy", "Economy under expected", lambda: e_eco() - ratio(s("runs"), s("balls"), 6), **RP)
    m("expected_wickets", "Expected wickets", lambda: s("e_wkts"), **P)
    m("true_wickets", "Wickets over expected", lambda: s("wickets") - s("e_wkts"), **P)
    m("runs_saved", "Runs saved", lambda: s("e_runs") - s("runs"), **P)
    m("match_factor", "The matches' others over the average", lambda: ratio(s("mc_runs"), s("mc_wkts")) / F.nullif(ratio(s("runs"), s("wickets")), F.lit(0.0)), **R)
    family = "fielding-independent"
    fr = lambda: s("runs") - s("inplay_runs") + skill("inplay_runs", "x_inplay_runs", "n_inplay", "k_inplay")
    lucky = lambda: skill("n_ct_field", "x_ct_field", "deliveries", "k_ct_field")
    fw = lambda: s("wickets") - s("n_ct_field") + lucky()
    m("fib_economy", "Fielding-independent economy", lambda: ratio(fr(), s("balls"), 6), up=False, **R)
    m("fib_wickets", "Fielding-independent wickets", fw)
    m("fib_average", "Fielding-independent average", lambda: fr() / F.nullif(fw(), F.lit(0.0)), up=False, **R)
    m("fib_strike_rate", "Fielding-independent strike rate", lambda: s("balls") / F.nullif(fw(), F.lit(0.0)), up=False, **R)
    m("wicket_luck", "Wickets by luck", lambda: s("n_ct_field") - lucky())
    m("runs_luck", "Runs spared by luck", lambda: fr() - s("runs"))
    m("inplay_runs_per_shot", "Runs for each shot in play", lambda: ratio(s("inplay_runs"), s("n_inplay")), up=False, **RP)
    family = "dismissal profile"
    m("bowled_lbw_pct", "Bowled or lbw %", lambda: ratio(s("n_bowled") + s("n_lbw"), s("deliveries"), 100), **RP)
    m("caught_behind_pct", "Caught behind %", lambda: ratio(s("n_ct_keeper"), s("deliveries"), 100), **RP)
    m("caught_field_pct", "Caught in the field %", lambda: ratio(s("n_ct_field"), s("deliveries"), 100), **RP)
    family = "reliability-adjusted"
    m("regressed_economy", "Regressed economy", lambda: 6 * shrunk("runs", "e_runs", "balls", "k_runs"), up=False, **R)
    m("regressed_strike_rate", "Regressed strike rate", lambda: 1 / F.nullif(shrunk("wickets", "e_wkts", "balls", "k_wickets"), F.lit(0.0)), up=False, **R)
    m("regressed_average", "Regressed average", lambda: shrunk("runs", "e_runs", "balls", "k_runs") / F.nullif(shrunk("wickets", "e_wkts", "balls", "k_wickets"), F.lit(0.0)), up=False, **R)
    m("regressed_dot_pct", "Regressed dot %", lambda: 100 * shrunk("n_dot", "x_dot", "deliveries", "k_dot"), **R)
    m("regressed_boundary_pct", "Regressed boundary %", lambda: 100 * shrunk(("n_four", "n_six"), ("x_four", "x_six"), "deliveries", "k_boundary"), up=False, **R)
    family = "role"
    m("team_win_pct", "Team wins %", lambda: ratio(n_if(F.col("result") == "won"), n_if(F.col("result").isin("won", "lost")), 100))
    return out


REGISTRY: dict[str, dict[str, Metric]] = {"batting": {m.id: m for m in _batting()}, "bowling": {m.id: m for m in _bowling()}}
#: Metrics of which each innings row carries its sample size constant.
SHRUNK = {"batting": ("runs", "out", "dot", "boundary", "inplay", "ct_field"), "bowling": ("runs", "wickets", "dot", "boundary", "inplay", "ct_field")}


def get(role: str, name: str) -> Metric:
    try:
        return REGISTRY[role][name]
    except KeyError:
        raise ValueError(f"no {role} metric {name!r}; there are: {', '.join(REGISTRY.get(role, {}))}") from None


def search(words: str, role: str | None = None) -> list[Metric]:
    """Metrics in whose id, label, family or definition every word occurs."""
    wanted = words.lower().split()
    return [m for r, ms in REGISTRY.items() if role in (None, r) for m in ms.values() if all(w in f"{m.id} {m.label} {m.family} {m.definition}".lower() for w in wanted)]
