"""Complaint clusters: how many on the day, and how many in the run of consecutive days, per zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlink.operators.joins import attach

CLUSTER_SIZE = 3


def daily_counts(df: DataFrame, zone: str = "zone", date: str = "date") -> DataFrame:
    placed = df.select(F.col(zone).alias("zone"), F.col(date).alias("date")).dropna()
    return placed.groupBy("zone", "date").agg(F.count("*").alias("n"))


def _numbered(days: DataFrame) -> DataFrame:
    """Days present anywhere in the data, counted from 1. One row per calendar day, so one task is enough."""
    return days.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))


def runs(days: DataFrame, calendar: bool = False) -> DataFrame:
    """Daily counts with the run of consecutive days they belong to.

    By default a day on which no zone has a row does not break a run; with ``calendar`` it does. Every
    window group holds at most one row per day of one zone.
    """
    if calendar:
        numbered = days.withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    else:
        numbered = days.join(_numbered(days), "date")
    position = F.row_number().over(Window.partitionBy("zone").orderBy("day"))
    islands = numbered.withColumn("island", F.col("day") - position)
    whole = Window.partitionBy("zone", "island")
    return islands.select(
        "zone",
        "date",
        "n",
        F.sum("n").over(whole).alias("run_n"),
        F.min("date").over(whole).alias("run_start"),
        F.max("date").over(whole).alias("run_end"),
    )


def cluster_id(zone: Column, start: Column) -> Column:
    return F.concat(zone, F.lit("/"), F.date_format(start, "yyyy-MM-dd"))


def with_clusters(df: DataFrame, zone: str = "zone", date: str = "date", calendar: bool = False) -> DataFrame:
    """Rows with their daily and consecutive-day cluster sizes and cluster id.

    A row without zone or date is a cluster of one, without id.
    """
    found = runs(daily_counts(df, zone, date), calendar)
    found = found.select(
        F.col("zone").alias("_zone"),
        F.col("date").alias("_date"),
        F.col("n").alias("_n"),
        F.col("run_n").alias("_run_n"),
        cluster_id(F.col("zone"), F.col("run_start")).alias("cluster_id"),
    )
    joined = attach(df, found, [(F.col(zone), "_zone"), (F.col(date), "_date")])
    sizes = {
        "daily_cluster_size": F.coalesce("_n", F.lit(1)),
        "consecutive_cluster_size": F.coalesce("_run_n", F.lit(1)),
    }
    return joined.withColumns(sizes).drop("_n", "_run_n")


def catalogue(df: DataFrame, zone: str = "zone", date: str = "date", calendar: bool = False) -> DataFrame:
    """One row per cluster."""
    grouped = runs(daily_counts(df, zone, date), calendar).groupBy("zone", "run_start", "run_end")
    sized = grouped.agg(F.count("*").alias("n_days"), F.sum("n").alias("n_complaints"))
    return sized.withColumn("cluster_id", cluster_id(F.col("zone"), F.col("run_start")))


def is_clustered(size: Column, least: int = CLUSTER_SIZE) -> Column:
    return size >= least
