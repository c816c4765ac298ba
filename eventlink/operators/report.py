"""Report tables: rates, percentages, attributions, profiles, histograms, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlink.session import durable


def sizes(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group; groups with an unknown key are left out."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("n"))


def followed(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """Per group, how many rows are flagged, how many are not, and the percentage.

    A count is null where no row falls on that side, and with it the percentage.
    """
    yes, no = F.nullif(F.count_if(flag), F.lit(0)), F.nullif(F.count_if(~F.col(flag)), F.lit(0))
    grouped = df.dropna(subset=list(by)).groupBy(*by)
    counted = grouped.agg(yes.alias("n_true"), no.alias("n_false"))
    return counted.withColumn("pct", 100 * F.col("n_true") / (F.col("n_true") + F.col("n_false")))


def values_of(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct known values of a column in their order; more than ``most`` are an error, as they are to be columns."""
    found = df.select(column).dropna().distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column}: more than {most} values")
    return sorted(r[0] for r in found)


def widen(df: DataFrame, index: list[str], column: str, values: dict, value: str) -> DataFrame:
    """One column per listed value. ``values``: value to column name."""
    cells = [F.max(F.when(F.col(column) == v, F.col(value))).alias(name) for v, name in values.items()]
    return df.groupBy(*index).agg(*cells)


def lengthen(df: DataFrame, index: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(index, columns, name, value)


def count_pivot(df: DataFrame, index: list[str], column: str, values: dict, fill: int | None = 0) -> DataFrame:
    """Rows per index and listed value, one column each; ``fill`` stands for none."""
    counted = df.dropna(subset=index).groupBy(*index)
    wide = counted.agg(*[F.count_if(F.col(column) == v).alias(name) for v, name in values.items()])
    if fill == 0:
        return wide
    return wide.withColumns({n: F.nullif(F.col(n), F.lit(0)) for n in values.values()})


def in_order(df: DataFrame, column: str, order: tuple) -> DataFrame:
    """The listed rows only, numbered by their place in the list, which is also the sort order."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.filter(F.col(column).isin(*order)).withColumn("place", place).orderBy("place")


def multi_hot(df: DataFrame, columns: list[str], any_name: str = "any_cause") -> DataFrame:
    """Counts per type as 0 or 1, and whether any is 1."""
    flags = {c: (F.coalesce(c, F.lit(0)) > 0).cast("int") for c in columns}
    flagged = df.withColumns(flags)
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return flagged.withColumn(any_name, top > 0)


def percent_of_group(df: DataFrame, flags: list[str], *by: str) -> DataFrame:
    shares = [(100 * F.avg(F.col(c).cast("int"))).alias(c) for c in flags]
    return df.dropna(subset=list(by)).groupBy(*by).agg(*shares)


def totals(df: DataFrame, flags: list[str], sets: list[list[str]]) -> DataFrame:
    """Sums for several groupings in one pass; ``grouping`` names the columns grouped by."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = df.dropna(subset=columns)
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    used = [F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in flags]
    return grouped.agg(F.concat_ws("+", *used).alias("grouping"), *sums)


def shares(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Count and share of rows meeting each condition, in one pass."""
    counts = [F.count_if(c).alias(f"n_{name}") for name, c in conditions.items()]
    counted = df.agg(F.count("*").alias("n"), *counts)
    return counted.withColumns({f"share_{m}": F.try_divide(f"n_{m}", "n") for m in conditions})


def rate_per(households: DataFrame, occurrences: DataFrame, key: str, per: int, keep: str = "left") -> DataFrame:
    """Occurrences per so many households. ``households``: key and households, summed here.

    ``keep='left'`` keeps every household group, ``'right'`` every group with occurrences.
    """
    homes = households.dropna(subset=[key]).groupBy(key).agg(F.sum("households").alias("households"))
    counted = occurrences.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("n"))
    joined = homes.join(counted, key, keep)
    return joined.withColumn(f"per_{per}", F.try_divide(per * F.col("n"), F.col("households")))


def rates_by_level(
    households: DataFrame, complaints: DataFrame, levels: list[str], category: str, chosen: str, per: int = 100
) -> DataFrame:
    """Rates for every demographic level, for all complaints and for one category of them."""

    def stacked(df: DataFrame, *more: str) -> DataFrame:
        level = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("code")) for c in levels])
        return df.select(F.explode(level).alias("l"), *more).select("l.*", *more).dropna(subset=["code"])

    homes = stacked(households, "households").groupBy("level", "code").agg(F.sum("households").alias("households"))
    seen = stacked(complaints, category).groupBy("level", "code")
    seen = seen.agg(
        F.count("*").alias("n"), F.nullif(F.count_if(F.col(category) == chosen), F.lit(0)).alias("n_chosen")
    )
    joined = homes.join(seen, ["level", "code"], "left")
    rates = {
        f"per_{per}": F.try_divide(per * F.col("n"), F.col("households")),
        f"chosen_per_{per}": F.try_divide(per * F.col("n_chosen"), F.col("households")),
    }
    return joined.withColumns(rates)


def hourly_profile(df: DataFrame, group: str, ts: str, households: DataFrame, per: int = 1000) -> DataFrame:
    """Occurrences per so many households by hour of day, one column per hour, null where none."""
    hours = {h: f"h{h:02d}" for h in range(24)}
    wide = count_pivot(df.withColumn("_hour", F.hour(ts)), [group], "_hour", hours, fill=None)
    homes = households.dropna(subset=[group]).groupBy(group).agg(F.sum("households").alias("households"))
    joined = wide.join(homes, group, "left")
    rates = [F.try_divide(per * F.col(h), F.col("households")).alias(h) for h in hours.values()]
    return joined.select(group, "households", *rates)


def histogram(
    df: DataFrame, value: str, bins: int, by: str | None = None, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Equal-width histogram, empty bins included; the last bin is closed at its upper edge.

    A limit that is not given is each group's own lowest or highest value; a group with one value gets a range of one
    around it. Values outside the limits are not counted, but a group keeps its empty bins.
    """
    group = F.col(by) if by else F.lit("all")
    known = df.select(group.alias("group"), F.col(value).cast("double").alias("v")).dropna().filter(~F.isnan("v"))
    span = known.groupBy("group").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if lo is not None:
        span = span.withColumn("lo", F.lit(float(lo)))
    if hi is not None:
        span = span.withColumn("hi", F.lit(float(hi)))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        "group",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    if lo is not None and hi is not None:
        ranged = known.withColumns({"lo": F.lit(float(lo)), "hi": F.lit(float(hi))})
    elif by:
        # The limits are written first: Spark then knows their size, and below its threshold hands them to every
        # task, so that rows find their bins where they are read and only counts are exchanged.
        span = durable(span)
        ranged = known.join(span, "group")
    else:
        # One group: its limits are two scalars, not a join.
        ranged = known.withColumns({c: span.select(c).scalar() for c in ("lo", "hi")})
    ranged = ranged.filter(F.col("v").between(F.col("lo"), F.col("hi")))
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counted = ranged.groupBy("group", F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    filled = grid.join(counted, ["group", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    return filled.select(
        "group",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density(df: DataFrame, value: str, by: str, bandwidths: dict, grid: int, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid reaching ``cut`` bandwidths past the data.

    Values are first shared out linearly between the two grid points around them, so the smoothing sees
    at most ``grid`` weights per group whatever the number of rows. A weight reaches the grid points within
    39 bandwidths; beyond that the kernel is zero in double precision. ``bandwidths``: group to bandwidth.
    """
    width = F.coalesce(*[F.when(F.col("group") == g, F.lit(float(b))) for g, b in bandwidths.items()])
    known = df.select(F.col(by).alias("group"), F.col(value).cast("double").alias("v")).dropna()
    known = known.filter(F.col("group").isin(*bandwidths))
    span = known.groupBy("group").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    span = span.select(
        "group",
        "n",
        width.alias("h"),
        (F.col("lo") - cut * width).alias("lo"),
        ((F.col("hi") - F.col("lo") + 2 * cut * width) / (grid - 1)).alias("step"),
    )
    # One row per listed bandwidth, so the broadcast has that bound.
    span = F.broadcast(span)
    ranged = known.join(F.broadcast(span.select("group", "lo", "step")), "group")
    place = (F.col("v") - F.col("lo")) / F.col("step")
    cell = F.floor(place)
    split = F.array(
        F.struct(cell.alias("cell"), (1 - (place - cell)).alias("w")),
        F.struct((cell + 1).alias("cell"), (place - cell).alias("w")),
    )
    weights = ranged.select("group", F.explode(split).alias("s")).groupBy("group", "s.cell")
    weights = weights.agg(F.sum("s.w").alias("w")).join(span, "group")
    far = F.ceil(39 * F.col("h") / F.col("step"))
    first, last = F.greatest(F.col("cell") - far, F.lit(0)), F.least(F.col("cell") + far, F.lit(grid - 1))
    reached = weights.withColumn("point", F.explode(F.sequence(first, last)))
    apart = (F.col("point") - F.col("cell")) * F.col("step") / F.col("h")
    kernel = F.col("w") * F.exp(-0.5 * apart * apart) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    summed = reached.groupBy("group", "point", "lo", "step").agg(F.sum(kernel).alias("density"))
    return summed.select("group", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"), "density")


def limits(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def latest_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows by the given columns."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
