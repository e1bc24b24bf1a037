"""What is done with a finished result: records for a reader, chart series, repaired arguments."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows that a reader is shown.
SHOWN = 25
#: Columns along which a chart is a line.
IN_TIME = ("season", "year", "innings_no")


def records(df: DataFrame, most: int = SHOWN, last: bool = False) -> dict:
    """The first, or last, rows as dictionaries, and how many are left out. Only those rows are fetched."""
    rows = df.tail(most) if last else df.limit(most).collect()
    out: dict = {"rows": [r.asDict(recursive=True) for r in rows]}
    if not rows:
        return out | {"empty": True}
    left = df.count() - len(rows) if len(rows) == most else 0
    return out | ({"rows_not_shown": f"{left} {'earlier' if last else 'more'} rows not shown"} if left > 0 else {})


def series(df: DataFrame, x: str, ys: Sequence[str], kind: str | None = None) -> tuple[str, DataFrame]:
    """A chart's type and its points (x as text, one column of doubles for each y, in the result's order)."""
    fields = {f.name: f.dataType for f in df.schema}
    if lacking := [c for c in (x, *ys) if c not in fields]:
        raise ValueError(f"no column {', '.join(lacking)}; there are: {', '.join(fields)}")
    if words := [y for y in ys if not isinstance(fields[y], NumericType)] or (not ys and ["nothing"]):
        raise ValueError(f"{', '.join(words)}: only numbers can be drawn")
    return kind or ("line" if x in IN_TIME else "bar"), df.select(F.col(x).cast("string").alias("x"), *(F.col(y).cast("double").alias(y) for y in ys))


def repaired(given: Mapping, own: Collection[str], filters: Collection[str], spellings: Mapping[str, str] | None = None) -> dict:
    """Arguments as a function takes them: empty ones drop out, other spellings are read, filters that
    were given beside the others go into `filters`, and its own arguments come out of there."""
    named = lambda k: k if k in own else (spellings or {}).get(k, k)
    inside = dict(given.get("filters") or {})
    both = [*((k, v) for k, v in given.items() if k != "filters"), *inside.items()]
    full = [(k, v) for k, v in both if v is not None and str(v).strip().lower() not in ("", "null", "none")]
    out: dict = {}
    for k, v in full:
        if named(k) in own:
            out.setdefault(named(k), v)
    kept = {k: v for k, v in reversed(full) if named(k) not in own and (k in filters or k in inside)}
    return out | ({"filters": kept} if kept else {})
