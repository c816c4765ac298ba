"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventlink.llm.common import written
from eventlink.operators.joins import attach


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``least``, the smallest v of each u.

    The least is found by an aggregate and joined back, so a crowded u can be split.
    """
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("least"))
    return attach(pairs, least, [(F.col("u"), "_u")], "inner")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable, the node itself included.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to its least neighbour.
    It ends when nothing changes; every round is a written table. Links with a null end are left out, a link of a node
    with itself makes it a component of its own.
    """
    whole = written(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    pairs = whole.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        small = _toward_least(large)
        seen = Observation()
        pairs = written(
            small.select("u", F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
            .observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("all"))
        )
        now = seen.get
        if now == state:
            break
        state = now
    alone = whole.where("a = b").select(F.col("a").alias("u"), F.col("a").alias("v"))
    roots = pairs.select(F.col("v").alias("u"), "v").unionByName(alone)
    return pairs.unionByName(roots).groupBy("u").agg(F.min("v").alias("v")).toDF("node", "component")
