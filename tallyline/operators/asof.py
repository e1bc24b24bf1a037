"""As-of joins: to each row of the left table the latest row of the right one before it, by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], *, inclusive: bool = False, ties: Sequence[str] = (), band: Column | None = None) -> DataFrame:
    """left with the `values` of the right row that is latest before its time (inclusive: or at it) among
    those of the same keys; null where there is none. Of right rows at one time the one with the largest
    `ties` counts. Null keys match nothing, a null time has nothing before it.

    Both sides are put in one table and sorted by time within a key, and the last right row is carried
    on: each side crosses one exchange, and no row is ever paired with more than one. A key with very
    many rows can be dealt out: band, a column of the time that never falls as the time rises, such as
    its year, parts it; what bands before carry over is one row a band."""
    if clash := {c.lower() for c in left.columns} & {v.lower() for v in values}:
        raise ValueError(f"{sorted(clash)[0]} is a column of the left table already")
    carried = F.struct(*(F.col(v).alias(v) for v in values))
    here = F.struct(*(F.col(c).alias(c) for c in left.columns))
    side = {"left": 1 if inclusive else 0, "right": 0 if inclusive else 1}
    as_row = lambda df, name, row, value: df.select(
        *keys, F.col(time).alias("_time"), F.lit(side[name]).alias("_side"), (band if band is not None else F.lit(0)).alias("_band"), row.alias("_row"), value.alias("_value"), F.struct(*((F.col(t) if name == "right" else F.lit(None).cast(right.schema[t].dataType)).alias(t) for t in ties), F.lit(0).alias("_")).alias("_tie")
    )
    known = right.filter(F.col(time).isNotNull()).dropna(subset=list(keys))
    lefts = as_row(left, "left", here, F.lit(None).cast(known.select(carried.alias("v")).schema["v"].dataType))
    rights = as_row(known, "right", F.lit(None).cast(lefts.schema["_row"].dataType), carried)
    within = Window.partitionBy(*keys, "_band").orderBy(F.asc_nulls_first("_time"), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = lefts.unionByName(rights).withColumn("_last", F.last("_value", ignorenulls=True).over(within))
    if band is not None:
        latest = rights.groupBy(*keys, "_band").agg(F.max_by("_value", F.struct("_time", "_tie")).alias("_latest"))
        bands = latest.unionByName(lefts.select(*keys, "_band").distinct(), allowMissingColumns=True).groupBy(*keys, "_band").agg(F.max("_latest").alias("_latest"))
        earlier = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
        bands = bands.withColumn("_before", F.last("_latest", ignorenulls=True).over(earlier)).filter("_before is not null").drop("_latest")
        rows = rows.filter("_row is not null").join(bands, [*keys, "_band"], "left").withColumn("_last", F.coalesce("_last", F.when(F.col("_time").isNotNull(), F.col("_before"))))
    return rows.filter("_row is not null").select("_row.*", *(F.col("_last")[v].alias(v) for v in values))
