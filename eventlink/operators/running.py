"""Exact sums over a sliding time window, without forming pairs.

A probe at time t wants the sum over all points between t + start and t + end, both ends included. That
is a running total at the upper end less the one just before the lower end. The running total is taken
in two steps so that no task depends on how the rows are spread over the zones:

* within a minute of a zone, over points already summed per distinct instant, and
* over the minutes of a zone, one row per minute in use.

The first group is bounded by the distinct instants of a minute and the second by the minutes of the
period, however many rows a zone or an instant holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlink.functions import times

# Order of rows at the same instant: a lower end precedes the points there, an upper end follows them.
_LOWER, _POINT, _UPPER = 0, 1, 2


def points(df: DataFrame, zone: str, ts: Column, measures: dict[str, Column]) -> DataFrame:
    """Sum the measures per zone and instant; unplaced rows can never match."""
    placed = df.select(F.col(zone).alias("zone"), ts.alias("at"), *[m.alias(n) for n, m in measures.items()])
    sums = [F.sum(n).cast("bigint").alias(n) for n in measures]
    return placed.dropna(subset=["zone", "at"]).groupBy("zone", "at").agg(*sums)


def probes(df: DataFrame, zone: str, ts: Column) -> DataFrame:
    """The distinct places and instants asked for."""
    return df.select(F.col(zone).alias("zone"), ts.alias("at")).dropna().distinct()


def sums_between(
    point_rows: DataFrame, probe_rows: DataFrame, start: Column, end: Column, measures: list[str]
) -> DataFrame:
    """``(zone, at, *measures)`` per probe: the sums over points in ``[at + start, at + end]``."""
    nothing = F.lit(None).cast("timestamp_ntz")
    zeros = [F.lit(0).cast("bigint").alias(m) for m in measures]
    as_points = point_rows.select("zone", "at", F.lit(_POINT).alias("step"), nothing.alias("probe"), *measures)
    ends = F.array(
        F.struct((F.col("at") + start).alias("at"), F.lit(_LOWER).alias("step")),
        F.struct((F.col("at") + end).alias("at"), F.lit(_UPPER).alias("step")),
    )
    as_probes = probe_rows.select("zone", F.col("at").alias("probe"), F.explode(ends).alias("end"))
    as_probes = as_probes.select("zone", "end.at", "end.step", "probe", *zeros)
    rows = as_points.unionByName(as_probes).withColumn("minute", times.epoch_minutes(F.col("at")))

    earlier = Window.partitionBy("zone").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = rows.groupBy("minute", "zone").agg(*[F.sum(m).alias(m) for m in measures])
    carried = minutes.select(
        "zone",
        "minute",
        nothing.alias("at"),
        F.lit(_LOWER).alias("step"),
        nothing.alias("probe"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(m) for m in measures],
    )

    # The carried row has no instant and so sorts first. The minute leads the sort, as a number tells
    # rows apart sooner than the text of a zone.
    so_far = (
        Window.partitionBy("minute", "zone")
        .orderBy(F.asc_nulls_first("at"), "step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = rows.unionByName(carried).withColumns({m: F.sum(m).over(so_far) for m in measures})
    signed = [F.sum(F.when(F.col("step") == _UPPER, F.col(m)).otherwise(-F.col(m))).alias(m) for m in measures]
    asked = totals.filter(F.col("probe").isNotNull())
    return asked.groupBy("zone", F.col("probe").alias("at")).agg(*signed)
