"""Link causes to the effects that follow them in the same or a neighbouring zone.

Two roads lead to the answers:

* Counts, flags and attributions come from running totals (``running.py``). No pair is ever formed, so
  their cost follows the number of rows, not the number of pairs.
* ``pairs`` and ``outer`` list every linked pair because that listing is what they are asked for. The time
  band becomes an equality on time slots, and zones become an equality on the zones in reach. Effects of a
  slot are met in pieces that follow each other in time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlink.functions import times
from eventlink.operators import running, zones
from eventlink.operators.joins import attach
from eventlink.session import durable

#: Effects that lie together in one array while pairs are made.
PIECE = 256


@dataclass(frozen=True)
class Side:
    """One table of events: unique ``id``, ``ts``, ``zone``, and the word that names it in results.

    A repeated id raises when a link is made, unless the ids are ``known_unique`` (a key of their table, or asked before).
    """

    frame: DataFrame
    word: str
    id: str = "id"
    ts: str = "ts"
    zone: str = "zone"
    known_unique: bool = False

    def where(self, condition: Column) -> Side:
        return replace(self, frame=self.frame.filter(condition))

    def suffixed(self, columns: list[str] | None = None) -> DataFrame:
        names = columns or self.frame.columns
        return self.frame.select(*[F.col(c).alias(f"{c}_{self.word}") for c in names])


def _verified(side: Side) -> Side:
    """The side with a check of its ids on the way: one aggregate of ids alone, whose largest repeated id is the example."""
    if side.known_unique:
        return side
    repeated = side.frame.groupBy(F.col(side.id).alias("id")).agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL")
    example = repeated.agg(F.max(F.col("id").cast("string"))).scalar()
    told = F.raise_error(F.concat(F.lit(f"{side.word}: the id occurs more than once: "), example)).cast("boolean")
    fits = F.when(example.isNotNull(), told).otherwise(F.lit(True))
    return replace(side, frame=side.frame.filter(fits), known_unique=True)


def require_unique_ids(*sides: Side) -> None:
    """Raise at once if a side repeats an id."""
    for side in sides:
        repeated = side.frame.groupBy(side.id).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).dropna().first()
        if repeated:
            raise ValueError(f"{side.word}: the id occurs more than once: {repeated[0]}")


@dataclass(frozen=True)
class Rule:
    """When an effect may follow from a cause.

    ``hours``: closed window after the cause; None means the same or the next calendar day.
    ``edges``: directed ``(zone, neighbour)``; None means the same zone only.
    ``any_zone``: ignore zones (calendar rule without the zone condition).
    """

    edges: DataFrame | None = None
    hours: float | None = 24
    any_zone: bool = False

    def instant(self, ts: Column) -> Column:
        return ts if self.hours is not None else times.day_start(ts)

    def length(self) -> int | float:
        """Seconds between the first and the last instant of an effect."""
        return self.hours * 3600 if self.hours is not None else 86400

    def place(self, side: Side) -> Side:
        if not self.any_zone:
            return side
        return replace(side, frame=side.frame.withColumn("_anywhere", F.lit("")), zone="_anywhere")


def _sums(base: Side, others: list[tuple[Side, dict[str, Column]]], rule: Rule, forward: bool) -> DataFrame:
    """Measures of the other tables summed around every row of ``base``, zero where nothing matches.

    All measures share one pass over ``base``; a measure is zero on the points of the other tables.
    """
    base = rule.place(base)
    names = [n for _, measures in others for n in measures]
    found = None
    for side, measures in others:
        side = rule.place(side)
        every = {n: measures.get(n, F.lit(0)) for n in names}
        part = running.points(side.frame, side.zone, rule.instant(F.col(side.ts)), every)
        found = part if found is None else found.unionByName(part)
    found = zones.spread(found, rule.edges if not rule.any_zone else None, "zone", "zone", inward=forward)
    asked = running.probes(base.frame, base.zone, rule.instant(F.col(base.ts)))
    none, full = times.seconds(0), times.seconds(rule.length())
    start, end = (none, full) if forward else (-full, none)
    sums = running.sums_between(found, asked, start, end, names)
    sums = sums.withColumnsRenamed({"zone": "_zone", "at": "_at"})
    joined = attach(base.frame, sums, [(F.col(base.zone), "_zone"), (rule.instant(F.col(base.ts)), "_at")])
    filled = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names}
    return joined.withColumns(filled).drop("_anywhere")


def _counted(base: Side, others: tuple[Side, ...], rule: Rule, forward: bool) -> Side:
    base, *others = map(_verified, (base, *others))
    counts = [(other, {f"number_of_{other.word}": F.lit(1)}) for other in others]
    counted = _sums(base, counts, rule, forward)
    flags = {f"at_least_one_{other.word}": F.col(f"number_of_{other.word}") > 0 for other in others}
    return replace(base, frame=counted.withColumns(flags))


def with_effects(causes: Side, *effects: Side, rule: Rule) -> Side:
    """Causes with ``number_of_<effect>`` and ``at_least_one_<effect>`` for each table of effects."""
    return _counted(causes, effects, rule, forward=True)


def with_causes(effects: Side, *causes: Side, rule: Rule) -> Side:
    """Effects with ``number_of_<cause>`` and ``at_least_one_<cause>`` for each table of causes."""
    return _counted(effects, causes, rule, forward=False)


def with_cause_types(effects: Side, causes: Side, rule: Rule, kind: str, names: dict[str, str]) -> Side:
    """Effects with one count of causes per type. ``names``: column name to type."""
    effects, causes = _verified(effects), _verified(causes)
    measures = {n: (F.col(kind) == t).cast("int") for n, t in names.items()}
    listed = causes.where(F.col(kind).isin(*names.values()))
    return replace(effects, frame=_sums(effects, [(listed, measures)], rule, forward=False))


def flagged(effects: Side, rule: Rule, **causes: Side) -> Side:
    """Effects with one flag per named table of causes: whether any of them leads to the effect."""
    sources = [replace(side, word=name) for name, side in causes.items()]
    marked = _counted(effects, tuple(sources), rule, forward=False).frame
    flags = {name: F.col(f"at_least_one_{name}") for name in causes}
    marked = marked.withColumns(flags)
    return replace(
        effects, frame=marked.drop(*[f"{p}_{n}" for n in causes for p in ("number_of", "at_least_one")])
    )


def _joined(causes: DataFrame, effects: DataFrame, a: Side, c: Side, rule: Rule, told: bool = False) -> DataFrame:
    """Band join of two suffixed tables. ``told``: with the flags of a pair (see ``pairs``).

    What a pair is judged by is worked out on the rows of the two sides, so that a pair costs no more than comparing numbers.
    """
    a_ts, c_ts = f"{a.ts}_{a.word}", f"{c.ts}_{c.word}"
    a_zone, c_zone = f"{a.zone}_{a.word}", f"{c.zone}_{c.word}"
    width = max(rule.length(), 1)
    length = times.seconds(rule.length())
    a_at, c_at = rule.instant(F.col(a_ts)), rule.instant(F.col(c_ts))

    def slot(at: Column) -> Column:
        return F.floor(times.epoch_seconds(at) / width)

    left = causes.dropna(subset=[a_ts] if rule.any_zone else [a_ts, a_zone])
    right = effects.dropna(subset=[c_ts] if rule.any_zone else [c_ts, c_zone])
    if rule.any_zone:
        left = left.withColumn("_match", F.lit(""))
        right = right.withColumn("_match", F.lit(""))
    else:
        left = zones.spread(left, rule.edges, a_zone, "_match")
        right = right.withColumn("_match", F.col(c_zone))
    if told and not rule.any_zone:
        left = _neighbours(left, a_zone, "_match", rule).withColumn("same_zone", F.col(a_zone) == F.col("_match"))
    if told:
        left, right = left.withColumn("_day", F.unix_date(F.col(a_ts).cast("date"))), right.withColumn("_on", F.unix_date(F.col(c_ts).cast("date")))
    left = left.withColumns({"_start": a_at, "_end": a_at + length})
    left = left.withColumn("_slot", F.explode(F.sequence(slot(F.col("_start")), slot(F.col("_end")))))
    right = right.withColumn("_at", c_at)
    right = right.withColumn("_slot", slot(F.col("_at")))

    # Both sides come straight from a shuffle on the keys, so adaptive execution can split a crowded slot of either.
    keys = ["_match", "_slot"]
    right = _pieces(right, keys, ["_on"] if told else [], f"{c.id}_{c.word}", effects.columns)
    joined = left.join(right, keys).filter((F.col("_first") <= F.col("_end")) & (F.col("_last") >= F.col("_start")))
    if told:
        days = F.col("_on") - F.col("_day")
        label = F.when(days == 0, "SameDay").when(days == 1, "NextDay").otherwise("Later")
        joined = joined.withColumn("day_label", label)
    joined = joined.withColumn("_row", F.explode("_rows")).filter(F.col("_row._at").between(F.col("_start"), F.col("_end")))
    flags = [] if not told else ["day_label"] if rule.any_zone else ["same_zone", "neighbour_zone", "day_label"]
    joined = joined.select(*causes.columns, *[F.col("_row")[n].alias(n) for n in effects.columns], *flags)
    if told and rule.any_zone:
        joined = _neighbours(joined, a_zone, c_zone, rule).withColumn("same_zone", F.col(a_zone) == F.col(c_zone))
    return joined


def _pieces(rows: DataFrame, keys: list[str], also: list[str], id: str, columns: list[str]) -> DataFrame:
    """Rows of a key that follow each other in time, at most ``PIECE`` as one array, with the first and the last instant.

    What meets a piece meets its rows one after another, so the lists of two causes repeat each other and pack well when they are
    written. Rows are dealt by range, so a crowded key or instant is shared by many tasks. No result depends on the order within
    an array, or on where it is cut.
    """
    order = [*keys, "_at", id]
    rows = rows.select(*keys, *also, "_at", id, F.struct("_at", *columns).alias("_row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_piece", F.col("_n") - F.col("_n") % PIECE)
    return rows.groupBy(*keys, *also, "_piece").agg(
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
        F.collect_list("_row").alias("_rows"),
    )


def _neighbours(rows: DataFrame, here: str, there: str, rule: Rule) -> DataFrame:
    """Rows with ``neighbour_zone``: whether the edges list the second zone for the first; null if either is."""
    if rule.edges is None:
        listed = F.lit(False)
    else:
        edges = rule.edges.select(F.col("zone").alias("_from"), F.col("neighbour").alias("_to")).dropna().distinct()
        edges = edges.withColumn("_listed", F.lit(True))
        rows = rows.join(edges, (F.col(here) == F.col("_from")) & (F.col(there) == F.col("_to")), "left").drop("_from", "_to")
        listed = F.col("_listed").isNotNull()
    known = F.when(F.col(here).isNotNull() & F.col(there).isNotNull(), listed)
    return rows.withColumn("neighbour_zone", known).drop("_listed")


def pairs(causes: Side, effects: Side, rule: Rule) -> DataFrame:
    """Every linked pair with its two ids, times and zones, ``same_zone``, ``neighbour_zone`` (null if either zone is) and ``day_label``."""
    causes, effects = _verified(causes), _verified(effects)
    left = causes.suffixed([causes.id, causes.ts, causes.zone])
    right = effects.suffixed([effects.id, effects.ts, effects.zone])
    joined = _joined(left, right, causes, effects, rule, told=True)
    return joined.select(*left.columns, *right.columns, "same_zone", "neighbour_zone", "day_label")


def _written(side: Side) -> Side:
    return replace(side, frame=durable(side.frame))


def outer(causes: Side, effects: Side, rule: Rule) -> DataFrame:
    """All pairs with the columns and counts of both sides, then the causes and effects without a partner.

    Each side is counted once and written, as matched and lone rows are both read from it. Sides that already
    carry their counts, say from a snapshot, are not counted again.
    """
    causes, effects = _verified(causes), _verified(effects)
    a_flag, c_flag = f"at_least_one_{effects.word}", f"at_least_one_{causes.word}"
    a = causes if a_flag in causes.frame.columns else _written(with_effects(causes, effects, rule=rule))
    c = effects if c_flag in effects.frame.columns else _written(with_causes(effects, causes, rule=rule))
    a_hit, c_hit = F.col(a_flag), F.col(c_flag)
    matched = _joined(a.where(a_hit).suffixed(), c.where(c_hit).suffixed(), a, c, rule)
    lone_causes, lone_effects = a.where(~a_hit).suffixed(), c.where(~c_hit).suffixed()
    rows = matched.unionByName(lone_causes, allowMissingColumns=True)
    return rows.unionByName(lone_effects, allowMissingColumns=True)


def chain(works: Side, anomalies: Side, complaints: Side, rule: Rule) -> Side:
    """Causes with the counts of both the middle and the last event, A to B and A to C."""
    return with_effects(works, anomalies, complaints, rule=rule)
