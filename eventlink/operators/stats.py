"""Poisson regression of match counts, and a random baseline for them."""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlink.session import durable

# Leading hex digits of the digest that choose a draw's bucket: 65,536 buckets.
BUCKET_DIGITS = 4
DRAW_DIGITS = 15


def grouped_counts(df: DataFrame, label: str, factors: list[str]) -> DataFrame:
    """Mean and number of rows per combination of factor levels: all that a Poisson fit needs to know."""
    known = df.dropna(subset=[label, *factors]).groupBy(*factors)
    return known.agg(F.avg(label).alias("mean"), F.count("*").cast("double").alias("weight"))


def poisson(df: DataFrame, label: str, factors: list[str], max_iter: int = 50) -> DataFrame:
    """Coefficients of ``label ~ factor + ..`` with log link, and whether the fit converged.

    Rows with equal factors share one mean, so the fit runs on one weighted row per combination and the
    data is read once instead of once per iteration. The alphabetically first level is the base. The coefficients of a
    single factor are logarithms of its levels' means, for any number of levels; a level whose mean is zero has none, and
    then nothing converges.

    Several factors are fitted by iterated weighted least squares. Each round is one aggregate over the combinations: its
    normal equations are sums per pair of levels that occur together, so they are as sparse as the data is. The driver holds the
    coefficients and these sums (``PAIRS`` at most) and solves for the step by conjugate gradients.
    """
    if len(factors) == 1:
        return _one_factor(grouped_counts(df, label, factors), factors[0])
    counts = durable(grouped_counts(df, label, factors).withColumnsRenamed({f: f"f{k}" for k, f in enumerate(factors)}))
    names = [[r[0] for r in counts.select(f"f{k}").distinct().collect()] for k in range(len(factors))]
    names = [sorted(levels, key=str) for levels in names]
    terms = [(k, level) for k, levels in enumerate(names) for level in levels[1:]]
    b = np.zeros(1 + len(terms))
    converged = False
    if names[0]:
        coded = durable(_coded(counts, names))
        mean = coded.agg(F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).first()[0]
        b[0] = math.log(mean) if mean > 0 else 0.0
        step, best = np.zeros_like(b), -math.inf
        for _ in range(max_iter):
            likelihood, gradient, pairs = _sums(coded, b + step, names)
            if likelihood < best - 1e-9 * abs(best) and np.abs(step).max() > 1e-12:
                step /= 2
                continue
            best, b = max(best, likelihood), b + step
            step = _solved(pairs, gradient)
            if np.abs(step).max() < 1e-11:
                b, converged = b + step, True
                break
    found = [("Intercept", float(b[0]), converged)]
    found += [(f"{factors[k]}_{level}", float(c), converged) for (k, level), c in zip(terms, b[1:], strict=True)]
    return df.sparkSession.createDataFrame(found, "term string, coefficient double, converged boolean")


#: Pairs of levels that occur together in a fit of several factors at most.
PAIRS = 20_000_000


def _coded(counts: DataFrame, names: list[list]) -> DataFrame:
    """Combinations with the place of each level's coefficient (``c0``, ..); 0 is the intercept, and base levels share it."""
    spark, first = counts.sparkSession, 1
    for k, levels in enumerate(names):
        places = [(level, 0 if i == 0 else first + i - 1) for i, level in enumerate(levels)]
        kind = counts.schema[f"f{k}"].dataType.simpleString()
        table = spark.createDataFrame(places, f"_level {kind}, c{k} int")
        counts = counts.join(table, F.col(f"f{k}") == F.col("_level")).drop("_level")
        first += len(levels) - 1
    return counts.select("mean", "weight", *[f"c{k}" for k in range(len(names))])


def _sums(coded: DataFrame, b: np.ndarray, names: list[list]) -> tuple[float, np.ndarray, tuple]:
    """Log-likelihood (less a constant) at ``b``, its gradient, and the weighted sums per pair of coefficients."""
    spark = coded.sparkSession
    value = spark.createDataFrame(pd.DataFrame({"_c": np.arange(len(b), dtype=np.int32), "_b": np.where(np.arange(len(b)), b, 0.0)}))
    rows, places = coded, [f"c{k}" for k in range(len(names))]
    for c in places:
        rows = rows.join(value.withColumnRenamed("_b", f"b{c}"), F.col(c) == F.col("_c")).drop("_c")
    eta = reduce(operator.add, [F.col(f"b{c}") for c in places], F.lit(float(b[0])))
    rows = rows.withColumn("eta", eta).withColumn("mu", F.exp("eta") * F.col("weight"))
    there = [F.lit(0), *[F.col(c) for c in places]]
    # A base level has no coefficient of its own; its place 0 stands for the intercept once, as the first of the list.
    known = [F.lit(True), *[F.col(c) > 0 for c in places]]
    entries = [F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), (F.col("weight") * F.col("mean") * F.col("eta") - F.col("mu")).alias("v"))]
    for p, i in enumerate(there):
        slope = F.col("weight") * F.col("mean") - F.col("mu")
        entries.append(F.when(known[p], F.struct(i.alias("i"), F.lit(-1).alias("j"), slope.alias("v"))))
        for q, j in enumerate(there[p:], p):
            entries.append(F.when(known[p] & known[q], F.struct(i.alias("i"), j.alias("j"), F.col("mu").alias("v"))))
    sums = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v"))
    found = sums.limit(PAIRS + 1).toPandas()
    if len(found) > PAIRS:
        raise ValueError(f"more than {PAIRS} pairs of levels occur together")
    i, j, v = found["i"].to_numpy(), found["j"].to_numpy(), found["v"].to_numpy()
    gradient = np.zeros(len(b))
    gradient[i[(j < 0) & (i >= 0)]] = v[(j < 0) & (i >= 0)]
    return float(v[i < 0].sum()), gradient, (i[j >= 0], j[j >= 0], v[j >= 0])


def _solved(pairs: tuple, right: np.ndarray) -> np.ndarray:
    """The step that the normal equations give, by conjugate gradients scaled by the diagonal."""
    i, j, v = pairs
    n, off = len(right), i != j
    diagonal = np.bincount(i[~off], v[~off], n)
    scale = 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    v = v * scale[i] * scale[j]

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(i, v * x[j], n) + np.bincount(j[off], v[off] * x[i[off]], n)

    x, rest = np.zeros(n), right * scale
    way, size = rest.copy(), float(rest @ rest)
    target = size * 1e-28
    for _ in range(20 * n + 100):
        if size <= target:
            break
        image = times(way)
        length = size / float(way @ image)
        x, rest = x + length * way, rest - length * image
        size, before = float(rest @ rest), size
        way = rest + (size / before) * way
    return x * scale


def _one_factor(counts: DataFrame, factor: str) -> DataFrame:
    levels = counts.select(F.col(factor).cast("string").alias("level"), "mean")
    base, least = F.min(F.struct("level", "mean")).alias("base"), F.min("mean").alias("least")
    known = levels.withColumn("s", levels.agg(F.struct(base, least)).scalar())
    first = F.col("level") == F.col("s.base.level")
    apart = F.ln("mean") - F.ln("s.base.mean")
    return known.select(
        F.when(first, "Intercept").otherwise(F.concat(F.lit(f"{factor}_"), "level")).alias("term"),
        F.when(first, F.ln("mean")).otherwise(apart).alias("coefficient"),
        (F.col("s.least") > 0).alias("converged"),
    )


def _digest(text: Column) -> Column:
    return F.md5(text.cast("string"))


def _keyed(df: DataFrame, id: str, *columns: str) -> DataFrame:
    keyed = df.select(F.col(id).cast("string").alias("_id"), *columns)
    keyed = keyed.withColumn("_digest", _digest(F.col("_id")))
    return keyed.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))


def _bucket_sizes(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))


def numbered(df: DataFrame, id: str, *columns: str) -> DataFrame:
    """Rows numbered from 0 in the order of a digest of their id.

    The order does not depend on the partitioning. Rows are numbered within 65,536 even buckets, whose
    starting numbers come from one small table of bucket sizes.
    """
    keyed = _keyed(df, id, *columns)
    # At most 65,536 rows: one task numbers them and the broadcast has that bound.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = _bucket_sizes(keyed).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", "_id"))
    joined = keyed.withColumn("_row", inside).join(F.broadcast(starts), "_bucket")
    return joined.select((F.col("_start") + F.col("_row") - 1).alias("number"), *columns)


def draw(seed: str, id: Column, size: Column) -> Column:
    """A number below ``size``, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), id.cast("string"))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") % size


def random_events(events: DataFrame, id: str, ts: str, zone: str, draws: DataFrame, draw_id: str) -> DataFrame:
    """One synthetic event per row of ``draws``: a start time and a zone taken independently, with replacement.

    The real events' times and zones are used, so the zones keep their weights but lose their timing. The events are
    numbered once; a row of ``draws`` asks for two numbers and gets one row back. No events give no rows.
    """
    pool = numbered(events, id, ts, zone)
    size = F.nullif(_bucket_sizes(_keyed(events, id)).agg(F.sum("_n")).scalar(), F.lit(0))
    drawn = draws.select(
        F.col(draw_id).alias("id"),
        draw("time-", F.col(draw_id), size).alias("_t"),
        draw("zone-", F.col(draw_id), size).alias("_z"),
    )
    asked = F.array(
        F.struct(F.lit(True).alias("dates"), F.col("_t").alias("number")),
        F.struct(F.lit(False).alias("dates"), F.col("_z").alias("number")),
    )
    taken = drawn.select("id", F.explode(asked).alias("asked")).select("id", "asked.*").join(pool, "number")
    found_ts = F.max(F.when(F.col("dates"), F.col(ts))).alias("ts")
    return taken.groupBy("id").agg(found_ts, F.max(F.when(~F.col("dates"), F.col(zone))).alias("zone"))
