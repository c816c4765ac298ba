"""Sort effects by whether certain causes lead to them, without forming pairs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventlink.operators.link import Rule, Side, flagged


def coming_from(effects: Side, causes: Side, rule: Rule) -> Side:
    """The effects to which one of the causes leads."""
    marked = flagged(effects, rule, _from=causes)
    return replace(marked, frame=marked.frame.filter("_from").drop("_from"))


def not_coming_from(effects: Side, causes: Side, rule: Rule) -> Side:
    """The effects to which none of the causes leads."""
    marked = flagged(effects, rule, _from=causes)
    return replace(marked, frame=marked.frame.filter(~F.col("_from")).drop("_from"))
