"""The registered queries: each operator over the proxy views of the test tables.

Result conventions: times as text, doubles rounded to six places, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.functions import codes, labels, times
from eventlink.operators import classify, clusters, conform, joins, link, report, stats, zones
from eventlink.operators.running import points
from eventlink.plans.proxy import BURSTS, WORK_TYPES, WORKS, Views, day_text, time_text
from eventlink.session import durable
from eventlink.sources import extracts, readers

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}

TYPE_NAMES = {t: t for t in WORK_TYPES}
ORDER_TYPE_NAMES = {"high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def rounded(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


# --- Linking -----------------------------------------------------------------------------------------


@query
def link_pairs(v: Views) -> DataFrame:
    found = link.pairs(v.works(), v.complaints(), v.rule())
    return found.select("id_cause", "id_complaint", "same_zone", "neighbour_zone", "day_label")


@query
def link_causes(v: Views) -> DataFrame:
    found = link.with_effects(v.works(), v.complaints(), rule=v.rule()).frame
    return found.select("id", "type", "number_of_complaint", "at_least_one_complaint")


@query
def link_effects(v: Views) -> DataFrame:
    found = link.with_causes(v.complaints(), v.works(), rule=v.rule()).frame
    return found.select("id", "number_of_cause", "at_least_one_cause")


@query
def link_outer(v: Views) -> DataFrame:
    found = link.outer(v.works(), v.complaints(), v.rule())
    return found.select(
        "id_cause", "type_cause", "number_of_complaint_cause", "id_complaint", "number_of_cause_complaint"
    )


@query
def link_calendar(v: Views) -> DataFrame:
    found = link.with_effects(v.works(), v.complaints(), rule=v.rule(hours=None)).frame
    return found.select("id", "number_of_complaint", "at_least_one_complaint")


@query
def link_calendar_pairs(v: Views) -> DataFrame:
    found = link.pairs(v.works(), v.complaints(), v.rule(hours=None))
    return found.select("id_cause", "id_complaint", "day_label")


@query
def link_calendar_any_zone(v: Views) -> DataFrame:
    found = link.with_effects(v.works(), v.complaints(), rule=v.rule(hours=None, any_zone=True)).frame
    return found.select("id", "number_of_complaint")


@query
def link_same_zone(v: Views) -> DataFrame:
    found = link.with_effects(v.works(), v.complaints(), rule=v.rule(edges=None)).frame
    return found.select("id", "number_of_complaint")


@query
def link_three_days(v: Views) -> DataFrame:
    found = link.with_causes(v.complaints(), v.works(), rule=v.rule(hours=72)).frame
    return found.select("id", "number_of_cause")


@query
def abc_chain(v: Views) -> DataFrame:
    found = link.chain(v.works(), v.anomalies(), v.complaints(), v.rule()).frame
    return found.select("id", "type", "number_of_anomaly", "number_of_complaint")


def _works(v: Views) -> link.Side:
    return v.works().where(F.col("type").isin(*WORKS))


def _bursts(v: Views) -> link.Side:
    return v.works().where(F.col("type").isin(*BURSTS))


@query
def effects_from_works(v: Views) -> DataFrame:
    linked = link.with_effects(v.anomalies(), v.complaints(), rule=v.rule())
    return classify.coming_from(linked, _works(v), v.rule()).frame.select("id", "number_of_complaint")


@query
def effects_not_from_works(v: Views) -> DataFrame:
    linked = link.with_effects(v.anomalies(), v.complaints(), rule=v.rule())
    return classify.not_coming_from(linked, _works(v), v.rule()).frame.select("id", "number_of_complaint")


@query
def from_works_flag(v: Views) -> DataFrame:
    return link.flagged(v.anomalies(), v.rule(), from_works=_works(v)).frame.select("id", "from_works")


@query
def from_work_related_anomaly(v: Views) -> DataFrame:
    middle = classify.coming_from(v.anomalies(), _works(v), v.rule())
    found = link.flagged(v.complaints(), v.rule(), from_work_related_anomaly=middle).frame
    return found.select("id", "from_work_related_anomaly")


@query
def orders_with_lines(v: Views) -> DataFrame:
    returned = v.lines().filter(F.col("l_returnflag") == "R")
    found = joins.in_set(v.orders(), "id", returned, "l_orderkey")
    return found.select("id", "type")


@query
def orders_without_lines(v: Views) -> DataFrame:
    returned = v.lines().filter(F.col("l_returnflag") == "R")
    found = joins.not_in_set(v.orders(), "id", returned, "l_orderkey")
    return found.select("id", "type")


@query
def abc_shares(v: Views) -> DataFrame:
    linked = link.with_effects(v.anomalies(), v.complaints(), rule=v.rule())
    flagged = link.flagged(linked, v.rule(), works=_works(v), bursts=_bursts(v))
    conditions = {
        "works": F.col("works"),
        "bursts": F.col("bursts"),
        "complaint": F.col("at_least_one_complaint"),
    }
    found = report.shares(flagged.frame, conditions)
    return found.select("n", *[f"n_{c}" for c in conditions], *rounded(*[f"share_{c}" for c in conditions]))


# --- Reports on links --------------------------------------------------------------------------------


def _order_causes(v: Views) -> DataFrame:
    causes = link.with_effects(v.order_works(), v.order_complaints(), rule=v.rule()).frame
    return zones.enrich(causes, v.zone_dim().select("zone", "region"))


@query
def type_pct_followed(v: Views) -> DataFrame:
    causes = link.with_effects(v.works(), v.complaints(), rule=v.rule()).frame
    found = report.in_order(report.followed(causes, "at_least_one_complaint", "type"), "type", WORK_TYPES)
    return found.select(F.col("place").cast("bigint").alias("place"), "type", *rounded("pct"))


@query
def year_pct_followed(v: Views) -> DataFrame:
    recent = _order_causes(v).filter(F.col("year") >= 1997)
    found = report.followed(recent, "at_least_one_complaint", "year", "type")
    return found.select("year", "type", *rounded("pct"))


def _years_wide(v: Views) -> DataFrame:
    """Percentage followed per type, one column per year that the works have; the counts are written, as years are asked first."""
    found = durable(report.followed(_order_causes(v), "at_least_one_complaint", "year", "type"))
    years = {y: f"y{y}" for y in report.values_of(found, "year")}
    wide = report.widen(found, ["type"], "year", years, "pct")
    return wide.select("type", *rounded(*years.values()))


@query
def year_pct_followed_wide(v: Views) -> DataFrame:
    return _years_wide(v)


@query
def year_pct_followed_long(v: Views) -> DataFrame:
    wide = _years_wide(v)
    return report.lengthen(wide, ["type"], wide.columns[1:], "year", "pct")


@query
def region_pct_followed(v: Views) -> DataFrame:
    found = report.followed(_order_causes(v), "at_least_one_complaint", "region", "type")
    return found.select("region", "type", *rounded("pct"))


@query
def year_raw_followed(v: Views) -> DataFrame:
    found = report.followed(_order_causes(v), "at_least_one_complaint", "year", "type")
    return found.select("year", "type", "n_true")


@query
def region_raw_followed(v: Views) -> DataFrame:
    found = durable(report.followed(_order_causes(v), "at_least_one_complaint", "region", "type"))
    regions = {r: r.lower().replace(" ", "_") for r in report.values_of(found, "region")}
    return report.widen(found, ["type"], "region", regions, "n_true")


@query
def counts_by_year_region_type(v: Views) -> DataFrame:
    works = zones.enrich(v.order_works().frame, v.zone_dim().select("zone", "region"))
    return report.sizes(works, "year", "region", "type")


@query
def match_count_distribution(v: Views) -> DataFrame:
    causes = link.with_effects(v.works(), v.complaints(), rule=v.rule()).frame
    return report.sizes(causes, "number_of_complaint")


@query
def attribution_multihot(v: Views) -> DataFrame:
    found = link.with_cause_types(v.complaints(), v.works(), v.rule(), "type", TYPE_NAMES).frame
    return report.multi_hot(found, list(TYPE_NAMES)).select("id", *TYPE_NAMES, "any_cause")


def _attributed(v: Views) -> DataFrame:
    complaints = link.with_cause_types(
        v.order_complaints(), v.order_works(), v.rule(), "type", ORDER_TYPE_NAMES
    ).frame
    flagged = report.multi_hot(complaints, list(ORDER_TYPE_NAMES))
    return zones.enrich(flagged, v.zone_dim().select("zone", "region"))


ATTRIBUTED = [*ORDER_TYPE_NAMES, "any_cause"]


@query
def attribution_pct_by_year(v: Views) -> DataFrame:
    found = report.percent_of_group(_attributed(v).filter(F.col("year") >= 1997), ATTRIBUTED, "year")
    return found.select("year", *rounded(*ATTRIBUTED))


@query
def attribution_totals(v: Views) -> DataFrame:
    sets = [["year", "region"], ["region"], ["year"]]
    found = report.totals(_attributed(v).filter(F.col("year") >= 1997), ATTRIBUTED, sets)
    return found.select("grouping", "year", "region", *ATTRIBUTED)


@query
def attribution_in_region(v: Views) -> DataFrame:
    rows = _attributed(v).filter(F.col("region") == "ASIA")
    return report.totals(rows, ATTRIBUTED, [["year"]]).select("year", *ATTRIBUTED)


@query
def poisson_by_type(v: Views) -> DataFrame:
    causes = link.with_effects(v.works(), v.complaints(), rule=v.rule()).frame
    found = stats.poisson(causes, "number_of_complaint", ["type"])
    return found.select("term", F.round("coefficient", 6).alias("coefficient"), "converged")


@query
def random_baseline(v: Views) -> DataFrame:
    works = v.works()
    drawn = stats.random_events(works.frame, works.id, works.ts, works.zone, v.anomalies().frame, "id")
    found = link.with_effects(link.Side(drawn, "cause", known_unique=True), v.complaints(), rule=v.rule()).frame
    return report.sizes(found, "number_of_complaint")


# --- Clusters and complaints -------------------------------------------------------------------------


def _complaint_rows(v: Views) -> DataFrame:
    """Complaints with calendar columns and cluster sizes."""
    rows = extracts.calendar_features(v.complaint_rows())
    return clusters.with_clusters(rows)


@query
def cluster_sizes(v: Views) -> DataFrame:
    found = clusters.with_clusters(v.complaint_rows())
    return found.select("id", "daily_cluster_size", "consecutive_cluster_size", "cluster_id")


@query
def cluster_sizes_calendar(v: Views) -> DataFrame:
    rows = v.orders().withColumn("date", F.to_date("ts")).filter(F.col("type") == "1-URGENT")
    found = clusters.with_clusters(rows, calendar=True)
    return found.select("id", "daily_cluster_size", "consecutive_cluster_size", "cluster_id")


@query
def cluster_catalogue(v: Views) -> DataFrame:
    rows = v.orders().withColumn("date", F.to_date("ts")).filter(F.col("type") == "1-URGENT")
    found = clusters.catalogue(rows)
    return found.select(
        "cluster_id",
        "zone",
        day_text("run_start").alias("first_day"),
        day_text("run_end").alias("last_day"),
        "n_days",
        "n_complaints",
    )


@query
def large_cluster_breakdown(v: Views) -> DataFrame:
    side = link.Side(_complaint_rows(v), "complaint", known_unique=True)
    found = link.with_causes(side, v.anomalies(), rule=v.rule()).frame
    sized = found.withColumn("incident_related", F.col("category") == "Appearance")
    sized = sized.withColumn(
        "least",
        F.explode(F.filter(F.array(F.lit(3), F.lit(10)), lambda n: F.col("consecutive_cluster_size") >= n)),
    )
    return report.sizes(sized, "least", "incident_related", "at_least_one_anomaly")


@query
def weekday_cluster_class(v: Views) -> DataFrame:
    rows = _complaint_rows(v)
    clustered = clusters.is_clustered(F.col("daily_cluster_size"))
    kind = labels.weekday_cluster(clustered, F.col("weekday"))
    return report.sizes(rows.withColumn("kind", kind), "kind")


@query
def year_cluster_hour_pivot(v: Views) -> DataFrame:
    rows = _complaint_rows(v)
    kind = labels.weekday_cluster(clusters.is_clustered(F.col("daily_cluster_size")), F.col("weekday"))
    hours = {h: f"h{h:02d}" for h in range(24)}
    return report.count_pivot(rows.withColumn("kind", kind), ["year", "kind"], "hour", hours)


@query
def zone_date_counts(v: Views) -> DataFrame:
    rows = v.complaint_rows().withColumn("day", day_text("date"))
    return report.sizes(rows, "zone", "day")


@query
def histogram_by_group(v: Views) -> DataFrame:
    rows = zones.enrich(extracts.calendar_features(v.complaint_rows()), v.zone_dim().select("zone", "region"))
    weekdays = rows.filter(F.col("weekday") < 5)
    found = report.histogram(weekdays, "decimal_hour", 24, by="region", lo=0, hi=24)
    return found.select("group", "bin", *rounded("lower", "upper"), "n")


@query
def histogram_own_range(v: Views) -> DataFrame:
    found = report.histogram(v.events(), "value", 48, by="type")
    return found.select("group", "bin", *rounded("lower", "upper"), "n")


@query
def histogram_of_matches(v: Views) -> DataFrame:
    found = link.with_effects(v.anomalies(), v.complaints(), rule=v.rule()).frame
    matched = found.filter("at_least_one_complaint")
    return report.histogram(matched, "number_of_complaint", 200).select("bin", *rounded("lower", "upper"), "n")


@query
def density_curve(v: Views) -> DataFrame:
    rows = _complaint_rows(v).withColumn("clustered", clusters.is_clustered(F.col("daily_cluster_size")))
    rows = rows.withColumn("kind", F.when(F.col("clustered"), "clustered").otherwise("single"))
    found = report.density(rows, "ordinal_datetime", "kind", {"clustered": 3.0, "single": 0.5}, grid=3650)
    return found.select("group", "point", *rounded("x", "density"))


@query
def value_limits(v: Views) -> DataFrame:
    rows = extracts.calendar_features(v.complaint_rows())
    return report.limits(rows, "ordinal_datetime").select(*rounded("lowest", "highest"))


@query
def demographic_rollup(v: Views) -> DataFrame:
    people = v.customers().select("postcode", "acorn59")
    found = extracts.with_demographics(v.complaint_rows(), people)
    return found.select("id", "acorn59", "acorn17", "acorn5")


@query
def demographic_rates(v: Views) -> DataFrame:
    people = v.customers().join(labels.demographic_types(v.spark), "acorn59", "left")
    complaints = extracts.with_demographics(v.complaint_rows(), people.select("postcode", "acorn59"))
    found = report.rates_by_level(people, complaints, ["acorn5", "acorn17", "acorn59"], "category", "Appearance")
    group = F.when(F.col("level") == "acorn17", labels.group_label(F.col("code")))
    label = F.coalesce(group, F.when(F.col("level") == "acorn5", labels.category_label(F.col("code"))))
    return found.select(
        "level", "code", label.alias("label"), "households", "n", "n_chosen", *rounded("per_100", "chosen_per_100")
    )


@query
def rate_per_household(v: Views) -> DataFrame:
    found = report.rate_per(v.customers(), v.complaint_rows(), "zone", 100)
    return found.select("zone", "households", "n", *rounded("per_100"))


@query
def region_rate_per_1000(v: Views) -> DataFrame:
    dim = v.zone_dim().select("zone", "region")
    homes, seen = zones.enrich(v.customers(), dim), zones.enrich(v.complaint_rows(), dim)
    found = report.rate_per(homes, seen, "region", 1000, keep="right").orderBy(F.desc("per_1000"), "region")
    return found.select("region", "households", "n", *rounded("per_1000"))


@query
def hourly_profile_normalised(v: Views) -> DataFrame:
    people = v.customers().join(labels.demographic_types(v.spark), "acorn59", "left")
    complaints = extracts.with_demographics(v.complaint_rows(), people.select("postcode", "acorn59"))
    found = report.hourly_profile(complaints, "acorn5", "ts", people)
    return found.select("acorn5", "households", *rounded(*[f"h{h:02d}" for h in range(24)]))


# --- Conforming --------------------------------------------------------------------------------------


def _parts(v: Views) -> list[DataFrame]:
    """Three unlike sources: shipped lines, orders and events."""
    suppliers = v.table("supplier").select("s_suppkey", "s_nationkey")
    lines = v.lines().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    shipped = lines.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("string").alias("operation"),
        F.col("l_shipdate").alias("end_ts"),
        codes.zone_code_from_number(F.col("s_nationkey")).alias("zone"),
        F.concat(F.col("l_returnflag"), F.lit(": "), F.col("l_linestatus")).alias("description"),
        F.lit("lineitem").alias("source_file"),
    )
    orders = v.orders().select(
        F.concat(F.lit("00"), F.col("id").cast("string")).alias("order_id"),
        F.col("ts").alias("start_ts"),
        F.when(F.col("id") % 5 != 0, F.col("zone")).alias("zone"),
        F.when(F.col("id") % 10 == 0, "CG-own").alias("control_group"),
        F.when(F.col("id") % 10 < 5, "ASIA").alias("region"),
        F.lit("orders").alias("source_file"),
    )
    events = v.events().select(
        F.concat(F.lit("E&"), F.col("id").cast("string")).alias("order_id"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + times.hours(2)).alias("end_ts"),
        "zone",
        F.concat(F.lit("Incident: "), F.col("type")).alias("description"),
        F.lit("events").alias("source_file"),
    )
    return [
        conform.to_directory(shipped, "Valve Op", conform.DATE_TYPES["valve"]),
        conform.to_directory(orders, "SAP Planned work", conform.DATE_TYPES["planned"]),
        conform.to_directory(events, "NC Incident", conform.DATE_TYPES["incident"]),
    ]


def _directory(v: Views) -> DataFrame:
    return conform.finish_directory(conform.union_directory(_parts(v)), v.zone_dim())


@query
def union_directory(v: Views) -> DataFrame:
    return conform.union_directory(_parts(v)).select(
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
        "date_type",
        "zone",
        "control_group",
        "region",
        "order_id",
        "operation",
        "intervention_type",
        "description",
        "source_file",
    )


@query
def zone_enrich(v: Views) -> DataFrame:
    return _directory(v).select(
        "order_given",
        "order_id",
        "operation",
        "zone",
        "wqz",
        "control_group",
        "region",
        day_text("date").alias("date"),
        "time",
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
    )


@query
def merge_event_spans(v: Views) -> DataFrame:
    found = conform.merge_spans(conform.located(_directory(v)))
    return found.select(
        *conform.SPAN_KEYS,
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
        "year",
        "month",
        day_text("start_date").alias("start_date"),
        day_text("end_date").alias("end_date"),
    )


@query
def merge_event_spans_q1(v: Views) -> DataFrame:
    found = conform.merge_spans_in_period(
        conform.located(_directory(v)), "1997-01-01", "1997-04-01", ("WQ1", "WQ2", "WQ3")
    )
    return found.select(
        *conform.PERIOD_KEYS,
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
        "type",
        "zone",
    )


@query
def missing_start(v: Views) -> DataFrame:
    rows = conform.without_start(conform.union_directory(_parts(v)))
    return report.sizes(rows, "intervention_type", "zone")


@query
def incident_rollup(v: Views) -> DataFrame:
    supplier = F.col("l_suppkey")
    name = F.concat(F.when(supplier % 10 == 0, "Training ").otherwise("Site "), supplier.cast("string"))
    start = F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")
    tracker = v.lines().select(
        name.alias("name"),
        start.alias("start_ts"),
        F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("task_ts"),
        F.lpad(F.col("l_linenumber").cast("string"), 5, "0").alias("zone"),
        F.col("l_orderkey").cast("string").alias("sap_order"),
        F.col("l_extendedprice").alias("x"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("y"),
        F.col("l_returnflag").alias("region"),
    )
    return conform.incident_rollup(tracker).select(
        "incident_name",
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
        "zone",
        "order_id",
        "n_records",
        *rounded("x", "y"),
        "region",
    )


@query
def infer_span(v: Views) -> DataFrame:
    key = F.col("l_orderkey") + F.col("l_linenumber")
    shipped = F.col("l_shipdate")
    operations = v.lines().select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 3 != 0, shipped - times.hours(72)).alias("date_created"),
        F.when(key % 4 != 0, shipped - times.hours(48)).alias("date_dispatched"),
        F.when(key % 5 != 0, shipped - times.hours(48)).alias("date_accepted"),
        F.when(key % 7 == 0, shipped - times.hours(1)).alias("date_arrived"),
        F.when(key % 6 != 0, shipped).alias("date_completed"),
        F.when(key % 2 == 0, shipped + times.hours(5)).alias("op_actual_finish_dt"),
    )
    dates = ["date_created", "date_dispatched", "date_accepted", "date_arrived"]
    spans = conform.completed_spans(operations, dates)
    start, end = times.default_span(F.col("start_ts"), F.col("end_ts"))
    filled = spans.withColumns({"start_ts": start, "end_ts": end})
    return filled.select(
        "l_orderkey",
        "l_linenumber",
        "latest_date",
        time_text("start_ts").alias("start_ts"),
        time_text("end_ts").alias("end_ts"),
    )


@query
def operations_per_order(v: Views) -> DataFrame:
    rows = v.lines().select(F.col("l_orderkey").alias("order_id"), "l_returnflag", "l_linenumber")
    found = conform.operations_by(rows, ["order_id", "l_returnflag"], "l_linenumber")
    every = F.transform(conform.every_operation(F.col("operations")), lambda o: o.cast("string"))
    return found.select(
        "order_id",
        "l_returnflag",
        F.array_join(every, ",").alias("operations"),
        conform.distinct_operations(F.col("operations")).alias("distinct_operations"),
    )


@query
def order_match_left(v: Views) -> DataFrame:
    lines = v.lines().select(
        F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_quantity", F.col("l_linestatus").alias("status")
    )
    finished = v.table("orders").filter(F.col("o_orderstatus") == "F")
    orders = finished.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_orderdate"
    )
    found = joins.match_left(lines, orders, "order_id", "matched")
    return found.select(
        "order_id",
        "l_linenumber",
        "l_quantity",
        "status",
        "status_right",
        day_text("o_orderdate").alias("o_orderdate"),
        "matched",
    )


@query
def reconcile_outer(v: Views) -> DataFrame:
    key = codes.order_op(F.col("l_orderkey"), F.col("l_linenumber")).alias("order_op")
    rows = v.lines().select(key, F.col("l_linestatus").alias("status"), "l_returnflag")
    returned = rows.filter(F.col("l_returnflag") == "R").drop("l_returnflag")
    accepted = rows.filter(F.col("l_returnflag") == "A").drop("l_returnflag")
    found = joins.reconcile(returned, accepted, "order_op", "merged")
    known = found.withColumn("status", F.coalesce("status", "status_right"))
    return report.sizes(known, "status", "merged")


@query
def order_zone_fill(v: Views) -> DataFrame:
    """Orders as bursts, lines as works on them; some orders have no line and get the zone of their postcode."""
    suppliers = v.table("supplier").select("s_suppkey", "s_nationkey")
    works = v.lines().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        codes.zone_code_from_number(F.col("s_nationkey")).alias("zone"),
    )
    people = v.customers().select("customer", "postcode", "zone")
    bursts = v.table("orders").join(people, F.col("o_custkey") == F.col("customer")).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderstatus").alias("burst_type"),
        F.col("o_orderdate").alias("reported_ts"),
        "postcode",
        F.lit("Main").alias("leakage_type"),
        F.lit(0).alias("operation"),
    )
    found = conform.bursts(conform.grouped_bursts(bursts), works, people.drop("customer"))
    return found.select("order_id", "intervention_type", "zone", time_text("start_ts").alias("start_ts"))


@query
def dedupe_readings(v: Views) -> DataFrame:
    readings = v.lines().select(
        "l_orderkey", "l_linenumber", day_text("l_shipdate").alias("day"), "l_suppkey", "l_quantity"
    )
    return joins.keep_first(readings, ["l_orderkey", "l_linenumber"], ["day", "l_suppkey"])


@query
def drop_all_null(v: Views) -> DataFrame:
    blank = F.col("id") % 11 == 0
    sheet = v.mess().select(
        F.when(~blank, F.col("id")).alias("id"),
        F.when(~blank, F.col("order_text")).alias("order_text"),
        F.lit(None).cast("string").alias("blank"),
    )
    return conform.drop_blank(sheet)


@query
def canonicalise_values(v: Views) -> DataFrame:
    return zones.canonicalise(v.mess().select("id", "work_type"), "work_type", v.work_types(), "raw", "value")


@query
def unmatched_groups(v: Views) -> DataFrame:
    return joins.unmatched_values(v.mess(), "given_group", v.zone_dim(), "control_group")


# --- Zones, codes and times --------------------------------------------------------------------------


@query
def adjacency_edges(v: Views) -> DataFrame:
    homes = v.customers().groupBy("zone").agg(F.sum("households").alias("neighbour_households"))
    edges = zones.tidy_edges(v.edges())
    return edges.join(homes.withColumnRenamed("zone", "neighbour"), "neighbour", "left")


@query
def zones_in_region(v: Views) -> DataFrame:
    inside = zones.zones_in_region(v.zone_dim(), "ASIA")
    return joins.in_set(v.customers(), "zone", inside, "zone").select("customer", "zone")


@query
def sensors_in_zone(v: Views) -> DataFrame:
    sensors = v.table("customer").select(
        F.col("c_custkey").alias("sensor_id"), F.col("c_nationkey").cast("string").alias("zone")
    )
    return zones.sensors_in_zone(sensors, "00007")


@query
def zone_code_fix(v: Views) -> DataFrame:
    text = F.col("zone_text")
    rows = zones.zone_from_text(v.mess(), "zone_text", v.exceptions(), "free_text")
    rows = zones.zone_from_location(rows, "zone_text", v.zone_dim().select("zone_name", "zone"), "location")
    return rows.select(
        "id",
        codes.zone_code(text).alias("filled"),
        "free_text",
        "location",
        codes.crop(text).alias("cropped"),
        codes.zone_from_district(F.col("district"), F.col("zone_number")).alias("district"),
    )


@query
def split_order_op(v: Views) -> DataFrame:
    text = F.col("order_text")
    return v.mess().select(
        "id",
        codes.order_part(text).alias("order_part"),
        codes.operation_part(text).alias("operation_part"),
        codes.integer_text(codes.operation_part(text)).alias("operation"),
        codes.order_op_integers(codes.order_part(text), codes.operation_part(text)).alias("order_op"),
        codes.order_op(F.col("id")).alias("default_op"),
    )


@query
def lenient_order(v: Views) -> DataFrame:
    return v.mess().select("id", codes.lenient_order(F.col("order_text")).alias("order_id"))


@query
def postcode_normalise(v: Views) -> DataFrame:
    return v.mess().select("id", codes.postcode(F.col("postcode_text")).alias("postcode"))


@query
def grid_split(v: Views) -> DataFrame:
    x, y = codes.grid_x(F.col("xy")), codes.grid_y(F.col("xy"))
    return v.mess().select("id", x.alias("x"), y.alias("y"), codes.as_number(x, "double").alias("easting"))


@query
def sentinel_to_null(v: Views) -> DataFrame:
    return v.mess().select(
        "id", codes.null_if_listed(F.col("xy")).alias("xy"), codes.null_if(F.col("x"), 0.0).alias("x")
    )


@query
def parse_dates(v: Views) -> DataFrame:
    text = F.col("date_text")
    return v.mess().select(
        "id",
        day_text(times.parse_day(text)).alias("day"),
        time_text(times.parse(text)).alias("fixed"),
        time_text(times.parse_day_first(text)).alias("day_first"),
        time_text(times.parse_joined(text, F.lit("08:00:01"))).alias("joined"),
    )


#: Columns as an extract would have them: codes with leading zeros, thousands separators, dates as text.
DECLARED = readers.Spec(
    "declared columns",
    (
        readers.Field("ORDER", "order_id"),
        readers.Field("CODE", "code"),
        readers.Field("PRICE", "price", "double"),
        readers.Field("KEY", "key", "number"),
        readers.Field("STATUS_DATE", "status_ts", "strict"),
        readers.Field("NOTE", "note", optional=True),
    ),
)


@query
def declared_columns(v: Views) -> DataFrame:
    """Text columns converted by their declaration: codes stay text, numbers lose their separators, dates are strict, others go."""
    key, date = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    raw = v.table("orders").select(
        key.cast("string").alias("ORDER"),
        F.lpad((key % 100000).cast("string"), 7, "0").alias("CODE"),
        F.when(key % 7 != 0, F.format_number("o_totalprice", 2)).otherwise("none").alias("PRICE"),
        F.format_number(key * 1000, 0).alias("KEY"),
        F.when(key % 5 == 0, "").otherwise(date).alias("STATUS_DATE"),
        F.col("o_orderpriority").alias("EXTRA"),
        F.lit("orders").alias("source_file"),
    )
    found = readers.convert(raw, DECLARED).drop("source_file")
    return found.select("order_id", "code", *rounded("price"), "key", time_text("status_ts").alias("status_ts"), "note")


@query
def free_text_time(v: Views) -> DataFrame:
    text = F.col("time_text")
    day = F.to_date(times.parse_day_first(F.col("date_text")))
    return v.mess().select(
        "id",
        times.clock(text).alias("start_time"),
        times.clock(text, end=True).alias("end_time"),
        time_text(times.at_clock(day, times.clock(text))).alias("start_ts"),
    )


@query
def calendar_features(v: Views) -> DataFrame:
    rows = extracts.calendar_features(v.events().select("id", "ts"))
    return rows.select(
        "id",
        "year",
        F.month("ts").alias("month"),
        day_text("ts").alias("date"),
        "time",
        "hour",
        "weekday",
        *rounded("decimal_hour", "ordinal_datetime"),
        times.minute_of_day(F.col("ts")).alias("minute_of_day"),
    )


@query
def filter_window_prefix(v: Views) -> DataFrame:
    rows = v.orders().filter(codes.has_prefix(F.col("zone"), "0001"))
    rows = rows.filter(times.within(F.col("ts"), "1996-05-01", "1997-07-01"))
    return rows.select("id", "zone", time_text("ts").alias("ts"))


@query
def filter_membership(v: Views) -> DataFrame:
    rows = v.mess().select("id", "work_type")
    return rows.filter(~labels.is_listed(F.col("work_type"), ("Works", "LD")))


@query
def latest_events(v: Views) -> DataFrame:
    return report.latest_rows(v.events(), ["ts", "id"], 10).select("id", "type", time_text("ts").alias("ts"))


@query
def points_per_zone(v: Views) -> DataFrame:
    """Complaints per zone and day, the long form of the zone by date matrix."""
    found = points(v.complaint_rows(), "zone", times.day_start(F.col("ts")), {"n": F.lit(1)})
    return found.select("zone", day_text("at").alias("date"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over_folder(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Views(spark, folder))

    return {name: over_folder(build) for name, build in _QUERIES.items()}
