"""Labels and small fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Intervention types and the two sets the analysis speaks of.
WORKS = ("Valve Op", "Mains Repair", "SAP Planned work", "SAP Unplanned work")
BURSTS = ("Communication Pipe Burst", "Fitting Burst", "Main Burst", "Supply Pipe Burst")
REPORTED_TYPES = (
    "Communication Pipe Burst",
    "Fitting Burst",
    "Supply Pipe Burst",
    "Main Burst",
    "Valve Op",
    "SAP Planned work",
    "SAP Unplanned work",
    "Mains Repair",
)
UNREPORTED_TYPES = ("Interruption", "NC Incident", "NC Planned work")

# Maintenance plants that count as water distribution, and those that are waste water.
DISTRIBUTION_PLANTS = ("Water Distribution - East", "Water Distribution - South", "Water Distribution - West")
WASTE_PLANTS = ("Sewage Treatment - West", "Waste Water - East", "Waste Water - South", "Waste Water - West")

# Demographic groups as (group, category, first type, last type); 60 to 62 are businesses.
DEMOGRAPHIC_GROUPS = (
    ("A", "C1", 1, 3),
    ("B", "C1", 4, 9),
    ("C", "C1", 10, 13),
    ("D", "C2", 14, 17),
    ("E", "C2", 18, 20),
    ("F", "C3", 21, 23),
    ("G", "C3", 24, 26),
    ("H", "C3", 27, 29),
    ("I", "C3", 30, 31),
    ("J", "C3", 32, 33),
    ("K", "C4", 34, 36),
    ("L", "C4", 37, 40),
    ("M", "C4", 41, 44),
    ("N", "C4", 45, 48),
    ("O", "C5", 49, 51),
    ("P", "C5", 52, 56),
    ("Q", "C5", 57, 59),
    ("Business", "Business", 60, 62),
)

# Names of the demographic categories and groups.
CATEGORY_NAMES = {
    "C1": "Affluent Achievers",
    "C2": "Rising Prosperity",
    "C3": "Comfortable Communities",
    "C4": "Financially Stretched",
    "C5": "Urban Adversity",
}
GROUP_NAMES = {
    "A": "Lavish Lifestyles",
    "B": "Executive Wealth",
    "C": "Mature Money",
    "D": "City Sophisticates",
    "E": "Career Climbers",
    "F": "Countryside Communities",
    "G": "Successful Suburbs",
    "H": "Steady Neighbourhoods",
    "I": "Comfortable Seniors",
    "J": "Starting Out",
    "K": "Student Life",
    "L": "Modest Means",
    "M": "Striving Families",
    "N": "Poorer Pensioners",
    "O": "Young Hardship",
    "P": "Struggling Estates",
    "Q": "Difficult Circumstances",
}


def small_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A handful of constant rows as a table that needs no scan."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def demographic_types(spark: SparkSession) -> DataFrame:
    """The 62 demographic types with their group and category."""
    names = ["acorn17", "acorn5", "first", "last"]
    groups = small_table(spark, list(DEMOGRAPHIC_GROUPS), names, ["string", "string", "int", "int"])
    return groups.select(F.explode(F.sequence("first", "last")).alias("acorn59"), "acorn17", "acorn5")


def named(code: Column, names: dict[str, str], template: str = "{code}: ") -> Column:
    """``A`` as ``A: Lavish Lifestyles``; codes without a name give null."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    before, after = template.split("{code}")
    name = F.try_element_at(F.create_map(*pairs), code)
    return F.concat(F.lit(before), code, F.lit(after), name)


def group_label(code: Column) -> Column:
    return named(code, GROUP_NAMES)


def category_label(code: Column) -> Column:
    """``C1`` as ``Category 1: Affluent Achievers``."""
    name = F.try_element_at(F.create_map(*[F.lit(p) for item in CATEGORY_NAMES.items() for p in item]), code)
    return F.concat(F.lit("Category "), F.right(code, F.lit(1)), F.lit(": "), name)


def weekday_cluster(clustered: Column, weekday: Column) -> Column:
    """``Weekday, clustered`` and its three siblings; an unknown weekday counts as weekend."""
    day = F.when(weekday < 5, "Weekday, ").otherwise("Weekend, ")
    return F.concat(day, F.when(clustered, "clustered").otherwise("non-clustered"))


def mentions_training(name: Column) -> Column:
    """Exercises that are no real incidents, in any case."""
    lower = F.lower(name)
    return lower.contains("training") | lower.contains("network control test incident")


def is_listed(value: Column, values) -> Column:
    """Membership where an unknown value counts as not listed, so that ``~`` keeps it."""
    return F.coalesce(value.isin(*values), F.lit(False))
