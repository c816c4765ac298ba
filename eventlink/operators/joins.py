"""Joins between record sets on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, summary: DataFrame, on: list[tuple[Column, str]], how: str = "left") -> DataFrame:
    """Join a summary to the rows it was made for. ``on``: an expression on the rows and a column of the summary.

    Spark splits a crowded join key only where both sides come straight from a shuffle, and a summary
    comes from an aggregate or a window that already has the key's partitioning. Joining on a digest of
    the key as well calls for a shuffle of its own, which is small, and makes the sort compare numbers.
    """
    typed = [c.cast(summary.schema[k].dataType) for c, k in on]
    left = df.withColumn("\ndigest", F.xxhash64(*typed))
    right = summary.withColumn("\nsummary digest", F.xxhash64(*[F.col(k) for _, k in on]))
    same = F.col("\ndigest") == F.col("\nsummary digest")
    for c, k in on:
        same = same & (c == F.col(k))
    return left.join(right, same, how).drop("\ndigest", "\nsummary digest", *[k for _, k in on])


def in_set(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(_keys(other, other_key), F.col(key) == F.col("_key"), "left_semi")


def not_in_set(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key does not occur there; a null key stays."""
    return df.join(_keys(other, other_key), F.col(key) == F.col("_key"), "left_anti")


def flag_in_set(df: DataFrame, key: str, other: DataFrame, other_key: str, out: str) -> DataFrame:
    """All rows with a flag for membership."""
    known = _keys(other, other_key).distinct().withColumn("_known", F.lit(True))
    joined = attach(df, known, [(F.col(key), "_key")])
    return joined.withColumn(out, F.coalesce("_known", F.lit(False))).drop("_known")


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull())


def match_left(left: DataFrame, right: DataFrame, key: str, indicator: str, suffix: str = "_right") -> DataFrame:
    """Left join telling which rows found a partner; shared column names of the right side get a suffix."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    other = right.withColumnsRenamed({c: c + suffix for c in shared}).withColumnRenamed(key, "_key")
    joined = left.join(other, F.col(key) == F.col("_key"), "left")
    found = F.when(F.col("_key").isNotNull(), "both").otherwise("left_only")
    return joined.withColumn(indicator, found).drop("_key")


def reconcile(
    left: DataFrame, right: DataFrame, key: str, indicator: str, suffix: str = "_right"
) -> DataFrame:
    """Full outer join with ``both``, ``left_only`` or ``right_only`` on every row.

    Written as a left join plus the unmatched right rows: Spark can split a skewed key in those two, but
    not in a full outer join.
    """
    matched = match_left(left, right, key, indicator, suffix)
    alone = not_in_set(right, key, left, key)
    shared = [c for c in right.columns if c in left.columns and c != key]
    alone = alone.withColumnsRenamed({c: c + suffix for c in shared}).withColumn(indicator, F.lit("right_only"))
    return matched.unionByName(alone, allowMissingColumns=True)


def fill_from(df: DataFrame, column: str, other: Column | str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.col(other) if isinstance(other, str) else other))


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations with no null part."""
    return df.select(*columns).dropna().distinct()


def unmatched_values(df: DataFrame, column: str, domain: DataFrame, domain_column: str) -> DataFrame:
    """Distinct known values that the domain does not hold."""
    given = df.select(column).dropna().distinct()
    return not_in_set(given, column, domain, domain_column)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` and then by the other columns.

    An aggregate rather than a ranking: a key repeated many times shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)
