"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlink.operators.joins import attach
from eventlink.session import durable

#: Bits of a value that one pass tells apart, so a group has at most 2^16 cells in a pass.
DIGIT = 16
#: Distinct values of a group, or of what is left of it, that are ranked together.
FEW = 1 << DIGIT


def _image(value: Column) -> Column:
    """A whole number that sorts as the double does: its bits, all but the sign turned round where it is negative."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("bigint")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def exact_medians(df: DataFrame, keys: list[str], columns: list[str], few: int = FEW) -> DataFrame:
    """Median of each column per group, nulls and NaN left out; the mean of the middle two where the count is even.

    Rows are read once and become counts of equal values, dealt out by group and value. While a group, or the part of it
    that can still hold the middle, has more than ``few`` distinct values, a pass counts its cells by the next 16
    bits and keeps the cells around the middle: four passes at most, and no task takes more than 2^16 cells or ``few`` values of a
    group. Rows are never joined to anything.
    """
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), (F.col(c).cast("double") + 0.0).alias("v")) for i, c in enumerate(columns)])
    long = df.dropna(subset=keys).select(*keys, F.explode(axes).alias("a")).select(*keys, "a.axis", "a.v")
    group = [*keys, "axis"]
    counted = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*group, "v").agg(F.count("*").alias("n"))
    left = durable(counted.withColumns({"part": F.lit(0).cast("bigint"), "skipped": F.lit(0).cast("bigint")}))
    total = F.sum("n").over(Window.partitionBy(*group))
    shift = 64
    while shift and not left.groupBy(*group, "part").agg(F.count("*").alias("n")).filter(F.col("n") > few).isEmpty():
        shift -= DIGIT
        left = durable(_narrowed(left, group, shift, total))
        total = F.col("total")
    upto = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = left.withColumns({"last": F.col("skipped") + F.sum("n").over(upto), "total": total})
    picked = ranked.filter(_holds_middle(F.col("last") - F.col("n"), F.col("last"), F.col("total")))
    medians = []
    for i, c in enumerate(columns):
        mine = F.when(F.col("axis") == i, F.col("v"))
        medians.append(((F.min(mine) + F.max(mine)) / 2).alias(c))
    return picked.groupBy(*keys).agg(*medians)


def _holds_middle(before: Column, last: Column, total: Column) -> Column:
    """Whether ranks after ``before`` up to ``last`` hold one of the middle two of so many."""
    return (before < F.floor((total + 2) / 2)) & (last >= F.floor((total + 1) / 2))


def _narrowed(left: DataFrame, group: list[str], shift: int, total: Column) -> DataFrame:
    """The values in the cells that hold the middle; ``part`` is the cell, ``skipped`` the number of smaller values."""
    cell = F.shiftright(_image(F.col("v")), shift) if shift else _image(F.col("v"))
    known = ["total"] if "total" in left.columns else []
    values = left.withColumn("cell", cell)
    cells = values.groupBy(*group, "part", "skipped", *known, "cell").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*group, "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"last": F.col("skipped") + F.sum("n").over(upto), "total": total})
    before = F.col("last") - F.col("n")
    middle = cells.filter(_holds_middle(before, F.col("last"), F.col("total")))
    middle = middle.select(*[F.col(c).alias(f"_{c}") for c in [*group, "cell"]], before.alias("skipped"), "total")
    found = attach(values.drop("part", "skipped", "total"), middle, [(F.col(c), f"_{c}") for c in [*group, "cell"]], "inner")
    return found.withColumnRenamed("cell", "part")
