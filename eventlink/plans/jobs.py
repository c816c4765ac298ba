"""The analyses from extracts to report tables.

Three stages, each starting from what the one before wrote: conform the extracts into event spans, link
works to anomalies and complaints, report. ``Extracts`` names where each extract lies.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.functions import codes, labels, times
from eventlink.operators import clusters, conform, joins, link, report, stats, zones
from eventlink.operators.link import Rule, Side
from eventlink.sources import extracts
from eventlink.sources.readers import Field, Spec, kept_snapshot, read, read_alike, snapshot, write_csv

_EXCEPTIONS = Spec("zone exceptions", (Field("raw", "raw"), Field("zone", "zone")), encoding="UTF-8")
_MAPPING = Spec("value mapping", (Field("raw", "raw"), Field("value", "value")), encoding="UTF-8")


@dataclass(frozen=True)
class Extracts:
    """Files or folders of the extracts. Correction lists are CSV files of ``raw`` and the right value."""

    zones: str
    neighbours: str
    postcodes: str
    demographics: str
    complaints: str
    anomalies: str
    sensors: str
    valves: list[str]
    burst_mains: list[str]
    repairs: str
    interruptions: str
    bursts: str
    completed_works: list[str]
    planned: str
    unplanned: list[str]
    incidents: str
    planned_sheets: list[str]
    planned_list: str
    zone_exceptions: str
    region_names: str
    work_type_names: str
    control_group_names: str
    ancillary_repairs: str | None = None
    repair_orders: str | None = None
    work_orders: str | None = None
    work_order_summary: str | None = None

    def paths(self) -> list[str]:
        """Every file and folder."""
        given = [getattr(self, f.name) for f in fields(self)]
        return [path for value in given if value for path in ([value] if isinstance(value, str) else value)]


@dataclass(frozen=True)
class Scope:
    """Which events and complaints are linked."""

    start: str
    end: str
    zone_prefix: str = ""
    category: str | None = "Appearance"
    hours: float = 24

    def of(self, df: DataFrame, ts: str) -> DataFrame:
        inside = df.filter(times.within(F.col(ts), self.start, self.end))
        return inside.filter(codes.has_prefix(F.col("zone"), self.zone_prefix)) if self.zone_prefix else inside


@dataclass(frozen=True)
class Tables:
    """Link results as written: causes, anomalies and complaints with their counts, and all pairs if asked for."""

    causes: DataFrame
    anomalies: DataFrame
    complaints: DataFrame
    outer: DataFrame | None
    scope: Scope
    sides: dict[str, Side] = field(default_factory=dict)


def event_directory(spark: SparkSession, x: Extracts) -> DataFrame:
    """All sources under one schema, enriched and with complete spans."""
    dim = extracts.zone_dimension(spark, x.zones)
    names = extracts.zone_names(dim)
    regions = read(spark, x.region_names, _MAPPING)
    tracker = extracts.incident_tracker(spark, x.incidents, read(spark, x.zone_exceptions, _EXCEPTIONS), regions)
    control = conform.control_planned_work(
        read_alike(spark, x.planned_sheets, extracts.OLD_PLANNED_SHEET),
        read(spark, x.planned_list, extracts.NEW_PLANNED_SHEET),
        dim,
        read(spark, x.work_type_names, _MAPPING),
        regions,
        read(spark, x.control_group_names, _MAPPING),
    )
    works = extracts.completed_works(spark, x.completed_works, names).rows
    parts = [
        conform.mains_repairs(
            extracts.repairs(spark, x.repairs, names),
            extracts.burst_mains(spark, x.burst_mains),
            [c.lower() for c in extracts.BURST_MAIN_DATES],
        ),
        conform.interruptions(extracts.interruptions(spark, x.interruptions)),
        conform.planned_work(extracts.planned_work(spark, x.planned)),
        conform.unplanned_work(extracts.unplanned_work(spark, x.unplanned)),
        conform.incidents(conform.incident_rollup(tracker)),
        conform.control_planned(control),
        conform.valve_operations(
            extracts.valve_operations(spark, x.valves), [c.lower() for c in extracts.VALVE_DATES]
        ),
        conform.bursts(
            conform.grouped_bursts(extracts.bursts(spark, x.bursts)), works, extracts.postcode_zones(spark, x.postcodes)
        ),
    ]
    return conform.finish_directory(conform.union_directory(parts), dim)


def event_spans(spark: SparkSession, x: Extracts, out: str) -> DataFrame:
    """Merged spans of all located events, written once; read again while the extracts are the same."""

    def build() -> DataFrame:
        return conform.merge_spans(conform.located(event_directory(spark, x)))

    return kept_snapshot(spark, f"{out}/event_spans", x.paths(), build)


@dataclass(frozen=True)
class Reconciled:
    """Works and bursts on one key, and what of the repairs they hold.

    ``works``: every completed work and burst with ``merged`` (both, left_only: a work alone, right_only: a burst alone).
    ``by_type``, ``by_merge``: their numbers by repair type and indicator, and by indicator. ``mains``, ``ancillary``: numbers of
    repairs by whether they are among these, and by the works' own indicator. ``coverage``: per work-order extract, the works
    whose order it holds. ``quarantine``: the files and rows of completed works that could not be read.
    """

    works: DataFrame
    by_type: DataFrame
    by_merge: DataFrame
    mains: DataFrame
    ancillary: DataFrame
    coverage: DataFrame
    quarantine: DataFrame


def reconcile_works(spark: SparkSession, x: Extracts, out: str) -> Reconciled:
    """Reconcile completed works with bursts, these with repairs, and the works with the work-order extracts.

    Both stages are outer joins on order and operation; the first is written, as all counts read it.
    """
    names = extracts.zone_names(extracts.zone_dimension(spark, x.zones))
    done = extracts.completed_works(spark, x.completed_works, names)
    bursts = extracts.bursts(spark, x.bursts).select("order_op", "reported_ts", "burst_type", "leakage_type", "postcode")
    rows = done.rows.select("order_op", "order_id", "operation", "zone", "repair_type", "year")
    # Operations are numbers in one extract and padded text in the other.
    works = snapshot(joins.reconcile(rows, _numbered_operations(bursts), "order_op", "merged"), f"{out}/works_and_bursts")

    def among(path: str | None) -> DataFrame:
        known = works.select("order_op", "merged").filter(F.col("order_op").isNotNull())
        if path is None:
            return known.limit(0).select(F.lit("").alias("found"), "merged", F.lit(0).cast("bigint").alias("n"))
        repairs = _numbered_operations(extracts.repairs(spark, path, names)).select("order_op", "zone")
        found = joins.reconcile(repairs, known, "order_op", "found")
        return found.groupBy("found", "merged").agg(F.count("*").alias("n"))

    readers = {"repair_orders": extracts.repair_orders, "work_orders": extracts.work_orders, "work_order_summary": extracts.work_order_summary}
    held = [(name, read_orders(spark, getattr(x, name))) for name, read_orders in readers.items() if getattr(x, name)]
    worked = works.filter("merged <> 'right_only'").select("order_id", "year")
    parts = [
        joins.flag_in_set(worked, "order_id", orders, "order_id", "covered").groupBy("year", "covered").agg(F.count("*").alias("n")).withColumn("extract", F.lit(name))
        for name, orders in held
    ]
    none = spark.createDataFrame([], "year int, covered boolean, n bigint, extract string")
    return Reconciled(
        works,
        report.sizes(works, "repair_type", "merged"),
        report.sizes(works, "merged"),
        among(x.repairs),
        among(x.ancillary_repairs),
        reduce(lambda a, b: a.unionByName(b), parts, none),
        done.quarantine,
    )


def _numbered_operations(df: DataFrame) -> DataFrame:
    """``order_op`` with both parts as plain numbers, as the completed works have it."""
    key = F.col("order_op")
    return df.withColumn("order_op", codes.order_op_integers(codes.order_part(key), codes.operation_part(key)))


def link_all(
    spark: SparkSession, x: Extracts, spans: DataFrame, scope: Scope, out: str, listing: bool = False
) -> Tables:
    """Causes, anomalies and complaints with their mutual counts; with ``listing`` also all pairs A to C, whose number
    grows with the square of the rows in a zone."""
    dim = extracts.zone_dimension(spark, x.zones)
    rule = Rule(edges=extracts.zone_edges(spark, x.neighbours), hours=scope.hours)
    events = scope.of(spans, "start_ts").withColumn("id", codes.content_key(*conform.SPAN_KEYS))
    people = extracts.demographics(spark, x.demographics)
    # Clusters count every complaint, so the scope is applied after them.
    every = snapshot(extracts.complaints(spark, x.complaints, people, dim), f"{out}/complaints_clean")
    chosen = scope.of(every, "ts")
    if scope.category:
        chosen = chosen.filter(F.col("category") == scope.category)
    readings = extracts.anomalies(spark, x.anomalies, read(spark, x.sensors, extracts.SENSORS), dim)
    readings = snapshot(readings, f"{out}/anomalies_clean")

    # Asked once for all links; the anomalies' keys are made of what they were made distinct by.
    c = Side(chosen, "complaint")
    link.require_unique_ids(c)
    a = Side(events, "cause", ts="start_ts", known_unique=True)
    b = Side(readings, "anomaly", known_unique=True)
    c = replace(c, known_unique=True)
    works = a.where(F.col("intervention_type").isin(*labels.WORKS))
    bursts = a.where(F.col("intervention_type").isin(*labels.BURSTS))

    causes = snapshot(link.chain(a, b, c, rule).frame, f"{out}/causes")
    middle = link.flagged(link.with_effects(b, c, rule=rule), rule, from_works=works, from_bursts=bursts)
    anomalies = snapshot(middle.frame, f"{out}/anomalies")
    worked = Side(anomalies.filter("from_works"), "anomaly", known_unique=True)
    last = link.with_causes(c, a, b, rule=rule)
    last = link.flagged(last, rule, from_work_related_anomaly=worked)
    names = {_column(t): t for t in labels.REPORTED_TYPES}
    last = link.with_cause_types(last, a, rule, "intervention_type", names)
    complaints = snapshot(last.frame, f"{out}/complaints")
    pairs = None
    if listing:
        pairs = link.outer(replace(a, frame=causes), replace(c, frame=complaints), rule)
        pairs = snapshot(pairs, f"{out}/outer")
    return Tables(causes, anomalies, complaints, pairs, scope, {"a": a, "b": b, "c": c})


def _column(kind: str) -> str:
    return kind.lower().replace(" ", "_")


def reports(tables: Tables, rule: Rule, first_year: int = 2014) -> dict[str, DataFrame]:
    """The report tables on links."""
    reported = ~labels.is_listed(F.col("intervention_type"), labels.UNREPORTED_TYPES)
    causes = tables.causes.filter(reported & (F.col("year") >= first_year))
    types = [_column(t) for t in labels.REPORTED_TYPES]
    attributed = report.multi_hot(tables.complaints, types)
    recent = attributed.filter(F.col("year") >= first_year)
    flags = [*types, "any_cause"]
    drawn = stats.random_events(tables.causes, "id", "start_ts", "zone", tables.anomalies, "id")
    baseline = link.with_effects(Side(drawn, "cause", known_unique=True), tables.sides["c"], rule=rule).frame
    return {
        "year_followed": report.followed(causes, "at_least_one_complaint", "year", "intervention_type"),
        "region_followed": report.followed(causes, "at_least_one_complaint", "region", "intervention_type"),
        "type_followed_by_anomaly": report.in_order(
            report.followed(tables.causes, "at_least_one_anomaly", "intervention_type"),
            "intervention_type",
            labels.REPORTED_TYPES,
        ),
        "attribution_percent": report.percent_of_group(recent, flags, "year"),
        "attribution_totals": report.totals(recent, flags, [["year", "region"], ["region"], ["year"]]),
        "large_clusters": report.sizes(
            tables.complaints.filter(F.col("consecutive_cluster_size") >= 10), "incident_related", "at_least_one_anomaly"
        ),
        "shares": report.shares(
            tables.anomalies,
            {"works": F.col("from_works"), "bursts": F.col("from_bursts"), "complaint": F.col("at_least_one_complaint")},
        ),
        "poisson": stats.poisson(tables.causes, "number_of_complaint", ["intervention_type"]),
        "random_baseline": report.sizes(baseline, "number_of_complaint"),
    }


def complaint_insight(complaints: DataFrame, people: DataFrame, dim: DataFrame, out: str) -> dict[str, DataFrame]:
    """The report tables on complaints alone; the table by hour of day is also written as CSV."""
    clustered = clusters.is_clustered(F.col("consecutive_cluster_size"))
    rows = complaints.withColumns(
        {
            "clustered": clustered,
            "cluster_weekday": labels.weekday_cluster(clustered, F.col("weekday")),
            "cluster_kind": F.when(clustered, "clustered").otherwise("single"),
        }
    )
    homes = zones.enrich(people, dim.select("zone", "region"))
    hours = {h: f"h{h:02d}" for h in range(24)}
    by_hour = report.count_pivot(rows, ["year", "cluster_weekday"], "hour", hours)
    write_csv(by_hour, f"{out}/complaints_by_hour")
    regional = report.rate_per(homes, rows, "region", 1000, keep="right")
    return {
        "by_hour": by_hour,
        "time_of_day": report.histogram(rows, "decimal_hour", 48),
        "weekday_by_region": report.histogram(rows.filter("weekday < 5"), "decimal_hour", 24, by="region"),
        "by_cluster_weekday": report.histogram(rows, "decimal_hour", 48, by="cluster_weekday"),
        "density": report.density(rows, "ordinal_datetime", "cluster_kind", {"clustered": 3.0, "single": 0.5}, 3650),
        "profile_by_category": report.hourly_profile(rows, "acorn5", "ts", people),
        "profile_by_group": report.hourly_profile(rows, "acorn17", "ts", people),
        "rates": report.rates_by_level(people, rows, ["acorn5", "acorn17", "acorn59"], "category", "Appearance"),
        "region_rates": regional.orderBy(F.desc("per_1000"), "region"),
        "clusters": clusters.catalogue(rows),
    }


__all__ = ["Extracts", "Reconciled", "Scope", "Tables", "complaint_insight", "event_spans", "link_all", "reconcile_works", "reports"]
