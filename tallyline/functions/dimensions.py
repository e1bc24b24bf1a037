"""Split dimensions: named grouping expressions over an innings table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import entry_phase

BATTING_ONLY = ("position", "entry_wickets", "entry_phase", "dismissal")
#: Those that need arrivals or dismissals, which a phase does not have.
NOT_IN_PHASE = ("entry_wickets", "entry_phase", "dismissal")


def _venue() -> Column:
    return F.trim(F.regexp_replace(F.split_part("venue", F.lit(","), F.lit(1)), r"\.", ""))


def build(merged: dict[str, str] | None = None) -> dict[str, Column]:
    """merged: raw team name -> the name it goes by."""
    one = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in merged.items() for x in kv))[F.col(c)], F.col(c)) if merged else F.col(c)
    return {
        "season": F.col("season"),
        "year": F.col("yr").cast("string"),
        "format": F.col("format"),
        "competition": F.coalesce(F.col("event"), F.lit("Bilateral / other")),
        "team": one("team"),
        "opposition": one("opposition"),
        "venue": _venue(),
        "innings": F.col("innings").cast("string"),
        "chase": F.when(F.col("fgroup") == "MULTI", F.concat(F.lit("innings "), F.col("innings").cast("string"))).when(F.col("innings") == 1, "setting").otherwise("chasing"),
        "result": F.col("result"),
        "phase": F.col("phase"),
        "position": F.col("position").cast("string"),
        "entry_wickets": F.when(F.col("entry_wkts") >= 5, "5+").otherwise(F.col("entry_wkts").cast("string")),
        "entry_phase": entry_phase(),
        "dismissal": F.coalesce(F.col("kind"), F.lit("not out")),
    }


def key(name: str, merged: dict[str, str] | None = None) -> Column:
    found = build(merged)
    if name not in found:
        raise ValueError(f"split_by must be one of: {', '.join(found)}")
    return F.coalesce(found[name], F.lit("n/a"))


def order_key(name: str, column: Column) -> Column:
    """What a split's values are ordered by: phases in play order, numbers as numbers, the rest as text."""
    if name in ("phase", "entry_phase"):
        order = {"powerplay": 0, "middle": 1, "death": 2, "early": 0, "late": 2}
        return F.coalesce(F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[column], F.lit(9)).cast("double")
    if name in ("position", "entry_wickets", "innings", "year"):
        return F.coalesce(F.regexp_replace(column, r"\+", "").try_cast("double"), F.lit(1e9))
    return F.lit(0.0)
