"""Zone hierarchy, adjacency and code lookups.

Dimension tables are joined without a broadcast hint: Spark broadcasts them when their measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlink.functions import codes
from eventlink.operators.joins import attach

HIERARCHY = ("zone", "zone_name", "wqz", "control_group", "region")


def edges_from_lists(neighbours: DataFrame, zone: str, listed: str) -> DataFrame:
    """Directed edges ``(zone, neighbour)`` from rows holding a comma list of neighbours, as listed."""
    return neighbours.select(
        codes.zone_code(F.col(zone)).alias("zone"),
        F.explode(codes.list_codes(F.col(listed))).alias("neighbour"),
    )


def tidy_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops or unknown ends."""
    known = edges.select("zone", "neighbour").dropna()
    return known.filter(F.col("zone") != F.col("neighbour")).distinct()


def reach(edges: DataFrame, inward: bool = False) -> DataFrame:
    """Per zone, itself and the zones it lists (or, inward, that list it). One cell holds one zone's degree."""
    here, there = ("neighbour", "zone") if inward else ("zone", "neighbour")
    known = edges.dropna(subset=["zone", "neighbour"]).filter(F.col("zone") != F.col("neighbour"))
    listed = known.groupBy(F.col(here).alias("reach_zone")).agg(F.collect_set(there).alias("others"))
    return listed.select("reach_zone", F.array_append("others", F.col("reach_zone")).alias("near"))


def spread(df: DataFrame, edges: DataFrame | None, zone: str, out: str, inward: bool = False) -> DataFrame:
    """Every row once for its own zone and once for each zone within reach of it."""
    if edges is None:
        return df.withColumn(out, F.col(zone))
    joined = df.join(reach(edges, inward), F.col(zone) == F.col("reach_zone"), "left")
    near = F.coalesce(F.col("near"), F.array(zone))
    return joined.withColumn(out, F.explode(near)).drop("reach_zone", "near")


def enrich(df: DataFrame, dim: DataFrame, zone: str = "zone") -> DataFrame:
    """Add the levels above the zone; a level the row already has is kept and only filled where null."""
    levels = [c for c in HIERARCHY[1:] if c in dim.columns]
    renamed = dim.select(F.col("zone").alias("_zone"), *[F.col(c).alias(f"_{c}") for c in levels])
    joined = df.join(renamed, F.col(zone) == F.col("_zone"), "left")
    filled = {c: F.coalesce(c, f"_{c}") if c in df.columns else F.col(f"_{c}") for c in levels}
    return joined.withColumns(filled).drop("_zone", *[f"_{c}" for c in levels])


def zones_in_region(dim: DataFrame, region: str) -> DataFrame:
    return dim.filter(F.col("region") == region).select("zone")


def sensors_in_zone(sensor_map: DataFrame, zone: str) -> DataFrame:
    """Sensors mapped to a zone, codes compared after padding."""
    return sensor_map.filter(codes.zone_code(F.col("zone")) == zone).select("sensor_id")


def one_value_per_key(mapping: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One value per key: the last by ``order`` as a dictionary would keep it, else the greatest."""
    keep = F.max_by(value, order) if order else F.max(value)
    return mapping.dropna(subset=[key]).groupBy(key).agg(keep.alias(value))


def lookup(
    df: DataFrame, on: Column, mapping: DataFrame, key: str, value: str, out: str, order: str | None = None
) -> DataFrame:
    """Left lookup in a two-column mapping; keys outside it give null."""
    table = one_value_per_key(mapping, key, value, order)
    table = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = attach(df, table, [(on, "_key")])
    return joined.withColumn(out, F.col("_value")).drop("_value")


def canonicalise(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Replace the listed values of a column and leave the others."""
    table = mapping.dropna(subset=[key]).groupBy(key).agg(F.max(value).alias(value))
    table = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_listed"))
    joined = df.join(table, F.col(column) == F.col("_key"), "left")
    replaced = F.when(F.col("_listed"), F.col("_value")).otherwise(F.col(column))
    return joined.withColumn(column, replaced).drop("_key", "_value", "_listed")


def zone_from_text(df: DataFrame, column: str, exceptions: DataFrame, out: str = "zone") -> DataFrame:
    """Zone typed by hand: the listed exceptions first, which may say "no zone", then the cleaned text.

    ``exceptions`` has ``raw`` and ``zone``; a null zone there differs from a text that is not listed.
    """
    table = exceptions.groupBy("raw").agg(F.max("zone").alias("_mapped")).withColumn("_listed", F.lit(True))
    joined = df.join(table.withColumnRenamed("raw", "_raw"), F.col(column) == F.col("_raw"), "left")
    fixed = F.when(F.col("_listed"), F.col("_mapped")).otherwise(codes.zone_free_text(F.col(column)))
    return joined.withColumn(out, fixed).drop("_raw", "_mapped", "_listed")


def zone_from_location(df: DataFrame, column: str, names: DataFrame, out: str = "zone") -> DataFrame:
    """Location whose first five characters are the zone, else a zone name to look up.

    ``names`` has ``zone_name`` and ``zone``.
    """
    found = lookup(df, F.col(column), names, "zone_name", "zone", "_named")
    return found.withColumn(out, F.coalesce(codes.digit_prefix(F.col(column)), "_named")).drop("_named")
