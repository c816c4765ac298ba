"""Conform work orders, bursts, repairs, incidents and planned work into one event directory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlink.functions import codes, labels, times
from eventlink.operators import zones
from eventlink.operators.joins import attach, distinct_pairs, match_left
from eventlink.operators.medians import exact_medians

# Columns of the event directory and their types.
DIRECTORY = {
    "start_ts": "timestamp_ntz",
    "end_ts": "timestamp_ntz",
    "date_type": "string",
    "zone": "string",
    "control_group": "string",
    "region": "string",
    "order_id": "string",
    "operation": "string",
    "intervention_type": "string",
    "description": "string",
    "asset_id": "string",
    "x": "string",
    "y": "string",
    "source_file": "string",
    "key": "string",
}
SPAN_KEYS = ["order_id", "operation", "intervention_type", "zone", "wqz", "control_group", "region"]
PERIOD_KEYS = ["order_id", "operation", "intervention_type", "wqz"]

# How each source dates its events.
DATE_TYPES = {
    "burst": "Burst reported date",
    "repair": "SAP Notification Date",
    "interruption": "Start and end datetimes",
    "planned": "SAP Operation Created Date",
    "unplanned": "SAP Operation Created and Completed Dates",
    "incident": "Op created and latest task on NC incident tracker",
    "control_planned": "Planned Start/End from NC Planned work sheet",
    "valve": "Inferred from different SAP date fields",
}
# The dates from which the start of an operation is inferred.
START_DATES = ("date_created", "date_dispatched", "date_accepted", "date_arrived")
ACTUAL_FINISH = ("op_actual_finish_date", "op_actual_finish_dt")
UNKNOWN = "unknown"


def natural_key(df: DataFrame) -> DataFrame:
    """Key made of the row's own content, so it is the same after every read."""
    return df.withColumn("key", codes.content_key(*df.columns))


def to_directory(df: DataFrame, intervention_type: str | Column | None, date_type: str) -> DataFrame:
    """The directory columns a source has, tagged with its type and the origin of its dates."""
    keyed = df if "key" in df.columns else natural_key(df)
    tagged = keyed.withColumn("date_type", F.lit(date_type))
    if intervention_type is not None:
        kind = F.lit(intervention_type) if isinstance(intervention_type, str) else intervention_type
        tagged = tagged.withColumn("intervention_type", kind)
    return tagged.select(*[F.col(c).cast(t).alias(c) for c, t in DIRECTORY.items() if c in tagged.columns])


def union_directory(parts: list[DataFrame]) -> DataFrame:
    """All parts under the directory's columns; what a part lacks is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {c: F.lit(None).cast(t) for c, t in DIRECTORY.items() if c not in rows.columns}
    return rows.withColumns(missing).select(*DIRECTORY)


def same_schema(parts: list[DataFrame]) -> bool:
    """Whether parts that should be alike have the same columns."""
    return all(p.columns == parts[0].columns for p in parts)


def without_blank_rows(df: DataFrame) -> DataFrame:
    """Without the rows that hold nothing but the name of their file."""
    return df.filter(times.any_true([F.col(f"`{c}`").isNotNull() for c in df.columns if c != "source_file"]))


def drop_blank(df: DataFrame) -> DataFrame:
    """Without the rows and the columns that hold nothing. One pass counts the columns' values."""
    rows = without_blank_rows(df)
    held = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if held[c]])


def completed_spans(df: DataFrame, date_columns: list[str]) -> DataFrame:
    """Completed operations with their inferred start and finish and the name of their latest date."""
    start = times.latest(*[c for c in START_DATES if c in df.columns])
    done = df.filter(F.col("date_completed").isNotNull())
    return done.withColumns(
        {
            "latest_date": times.latest_name(*date_columns),
            "start_ts": start,
            "end_ts": times.finish(df.columns, ACTUAL_FINISH, "date_completed"),
        }
    )


def valve_operations(df: DataFrame, date_columns: list[str]) -> DataFrame:
    """Needs work_order, operation_number, zone, the dates, and asset and position columns."""
    spans = completed_spans(df, [c for c in date_columns if c != "valve_status_date"])
    named = spans.withColumnsRenamed(
        {
            "work_order": "order_id",
            "operation_number": "operation",
            "uadms_id": "asset_id",
            "std_text_key_desc": "description",
            "point_x": "x",
            "point_y": "y",
        }
    )
    return to_directory(named, "Valve Op", DATE_TYPES["valve"])


def mains_repairs(repairs: DataFrame, burst_mains: DataFrame, date_columns: list[str]) -> DataFrame:
    """Repairs dated by the burst main operation of the same order and operation."""
    spans = completed_spans(burst_mains, date_columns).select("order_op", "start_ts", "end_ts")
    described = repairs.withColumn("description", F.concat_ws(", ", "fdb_technique", "fdb_size", "fdb_material"))
    matched = match_left(described, spans, "order_op", "matched")
    matched = matched.withColumnRenamed("nearest_neighbour_pipe_id", "asset_id")
    return to_directory(matched.drop("matched"), "Mains Repair", DATE_TYPES["repair"])


def interruptions(df: DataFrame) -> DataFrame:
    described = df.withColumn("description", F.concat(F.lit("Interruption, cause: "), "cause"))
    return to_directory(described, "Interruption", DATE_TYPES["interruption"])


def _with_grid(df: DataFrame) -> DataFrame:
    pair = F.col("xy")
    return df.withColumns({"x": codes.grid_x(pair), "y": codes.grid_y(pair)})


def drop_waste_water(df: DataFrame) -> DataFrame:
    """Without waste water plants; rows of unknown plant stay."""
    return df.filter(~labels.is_listed(F.col("plant"), labels.WASTE_PLANTS))


def planned_work(df: DataFrame) -> DataFrame:
    """Planned work on the distribution network: plant, xy, start_ts, zone, description."""
    network = df.filter(F.col("plant").isin(*labels.DISTRIBUTION_PLANTS))
    return to_directory(_with_grid(network), "SAP Planned work", DATE_TYPES["planned"])


def unplanned_work(df: DataFrame) -> DataFrame:
    network = df.filter(F.col("plant").isin(*labels.DISTRIBUTION_PLANTS))
    return to_directory(_with_grid(network), "SAP Unplanned work", DATE_TYPES["unplanned"])


def incident_rollup(tracker: DataFrame) -> DataFrame:
    """One row per incident from its tracker tasks, exercises left out.

    ``tracker``: name, start_ts, task_ts, zone, sap_order, x, y, region.
    """
    day = F.coalesce(F.to_date("start_ts").cast("string"), F.lit("NaT"))
    # The day cannot make a name one of an exercise, so the given name is asked and the longer one made once.
    real = tracker.filter(~labels.mentions_training(F.col("name")))
    name = F.concat("name", F.lit("_"), day)
    real = real.withColumns({"incident_name": name, "task_ts": F.coalesce("task_ts", "start_ts")})
    grouped = real.groupBy("incident_name").agg(
        F.min("task_ts").alias("start_ts"),
        F.max("task_ts").alias("end_ts"),
        F.min("zone").alias("zone"),
        F.min("sap_order").alias("order_id"),
        F.count("*").alias("n_records"),
        F.min("region").alias("region"),
    )
    middle = exact_medians(real, ["incident_name"], ["x", "y"])
    return grouped.join(middle, "incident_name", "left")


def incidents(rolled: DataFrame) -> DataFrame:
    """Incidents as directory rows; those without an order get one made of their name."""
    order = F.coalesce(codes.null_if(F.col("order_id"), "0"), F.concat(F.lit("NoOrder"), "incident_name"))
    described = rolled.withColumns(
        {"order_id": order, "description": F.concat(F.lit("Incident: "), "incident_name")}
    )
    return to_directory(described, "NC Incident", DATE_TYPES["incident"])


def planned_sheet_times(sheet: DataFrame) -> DataFrame:
    """Timestamps from a sheet with dates and times typed by hand."""
    start = times.at_clock(F.col("start_date"), times.clock(F.col("start_time")))
    end = times.at_clock(F.col("end_date"), times.clock(F.col("end_time"), end=True))
    return sheet.withColumns({"start_ts": start, "end_ts": end}).drop("start_date", "end_date")


def control_planned_work(
    old_sheets: list[DataFrame],
    new_sheet: DataFrame,
    dim: DataFrame,
    work_types: DataFrame,
    regions: DataFrame,
    control_groups: DataFrame,
) -> DataFrame:
    """Planned work sheets of both layouts with zones, work types, regions and control groups put right.

    The three mappings have ``raw`` and ``value``; the zone's own region and control group come first.
    """
    if not same_schema(old_sheets):
        raise ValueError("the planned work sheets differ in their columns")
    old = without_blank_rows(reduce(lambda a, b: a.unionByName(b), old_sheets))
    old = planned_sheet_times(old).withColumnsRenamed({"county": "district", "zones": "zone_number"})
    new = new_sheet.withColumnRenamed("zone", "zone_number")
    rows = old.unionByName(new, allowMissingColumns=True)
    rows = rows.withColumn("zone", codes.zone_from_district(F.col("district"), F.col("zone_number")))
    rows = rows.withColumnsRenamed({"region": "given_region", "control_group": "given_group"})
    rows = zones.canonicalise(rows, "work_type", work_types, "raw", "value")
    rows = zones.canonicalise(rows, "given_region", regions, "raw", "value")
    rows = zones.canonicalise(rows, "given_group", control_groups, "raw", "value")
    rows = zones.enrich(rows, dim.select("zone", "zone_name", "control_group", "region"))
    filled = rows.withColumns(
        {
            "region": F.coalesce("region", "given_region"),
            "control_group": F.coalesce("control_group", "given_group"),
        }
    )
    return filled.drop("given_region", "given_group")


def control_planned(df: DataFrame) -> DataFrame:
    described = df.withColumn("description", F.concat("work_type", F.lit(": "), "description"))
    named = described.withColumnRenamed("sap_number", "order_id")
    return to_directory(named, "NC Planned work", DATE_TYPES["control_planned"])


def grouped_bursts(bursts: DataFrame, keep_null_keys: bool = False) -> DataFrame:
    """One row per order, type, date, postcode and leakage type, with the operations found.

    ``operations`` lists each operation once with the number of times it occurs. Bursts with an unknown
    part of the key are dropped unless ``keep_null_keys``.
    """
    keys = ["order_id", "burst_type", "reported_ts", "postcode", "leakage_type"]
    rows = bursts if keep_null_keys else bursts.dropna(subset=keys)
    return operations_by(rows, keys, "operation")


def operations_by(df: DataFrame, keys: list[str], operation: str) -> DataFrame:
    """Sorted operations per key as (operation, times), counted before they are collected."""
    counted = df.groupBy(*keys, F.col(operation).alias("operation")).agg(F.count("*").alias("times"))
    listed = F.array_sort(F.collect_list(F.struct("operation", "times")))
    return counted.groupBy(*keys).agg(listed.alias("operations"))


def every_operation(operations: Column) -> Column:
    """The plain sorted list, each operation as often as it occurs."""
    return F.flatten(F.transform(operations, lambda o: F.array_repeat(o["operation"], o["times"].cast("int"))))


def distinct_operations(operations: Column) -> Column:
    """Comma list of the distinct operations, sorted as text."""
    texts = F.transform(operations, lambda o: o["operation"].cast("string"))
    return F.array_join(F.array_sort(texts), ",")


def bursts(grouped: DataFrame, completed_works: DataFrame, postcode_zones: DataFrame) -> DataFrame:
    """Bursts with the zones of the works on the same order, else the zone of their postcode.

    A burst whose order was worked on in several zones gets one row for each. ``postcode_zones`` has
    ``postcode`` and ``zone``.
    """
    order_zones = distinct_pairs(completed_works, "order_id", "zone").withColumnRenamed("order_id", "_order")
    placed = attach(grouped, order_zones, [(F.col("order_id"), "_order")])
    found = zones.lookup(placed, F.col("postcode"), postcode_zones, "postcode", "zone", "_by_postcode")
    zone = F.coalesce(F.col("zone"), codes.zone_code(F.col("_by_postcode")))
    filled = found.withColumns({"zone": zone, "start_ts": F.col("reported_ts"), "operation": F.lit("0")})
    filled = filled.withColumn("source_file", F.lit("bursts"))
    return to_directory(filled.drop("_by_postcode"), F.col("burst_type"), DATE_TYPES["burst"])


def completed_works(df: DataFrame) -> DataFrame:
    """Completed works with their order/operation key and zone. ``location`` must already be a zone."""
    key = codes.order_op_integers(F.col("order_id"), F.col("operation"))
    return _with_grid(df).withColumns({"order_op": key, "year": F.year("created_date")})


def finish_directory(directory: DataFrame, dim: DataFrame) -> DataFrame:
    """Zone hierarchy, clean order numbers, complete spans and calendar columns.

    A row without zone keeps the text ``unknown`` in its place, so that it survives grouping.
    """
    rich = zones.enrich(directory, dim)
    start, end = times.default_span(F.col("start_ts"), F.col("end_ts"))
    known = {c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("zone", "control_group", "wqz")}
    return rich.withColumns(
        {
            "order_given": F.col("order_id"),
            "order_id": codes.lenient_order(F.col("order_id")),
            "operation": F.coalesce(codes.lenient_order(F.col("operation")), F.lit("0")),
            "date": F.to_date("start_ts"),
            "time": times.time_of_day(F.col("start_ts")),
            "start_ts": start,
            "end_ts": end,
            **known,
        }
    )


def located(directory: DataFrame) -> DataFrame:
    """Rows with a region and a span."""
    return directory.dropna(subset=["region", "start_ts", "end_ts"])


def without_start(directory: DataFrame) -> DataFrame:
    return directory.filter(F.col("start_ts").isNull())


def _known(directory: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all keys. A cleaned order is null exactly where the given one is; asking that spares cleaning twice."""
    cleaned = "order_given" in directory.columns
    return directory.dropna(subset=["order_given" if cleaned and k == "order_id" else k for k in keys])


def merge_spans(directory: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of one operation merged into the span from its first start to its last end."""
    keys = keys or SPAN_KEYS
    grouped = _known(directory, keys).groupBy(*keys)
    spans = grouped.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return spans.withColumns(
        {
            "year": F.year("start_ts"),
            "month": F.month("start_ts"),
            "start_date": F.to_date("start_ts"),
            "end_date": F.to_date("end_ts"),
        }
    )


def merge_spans_in_period(directory: DataFrame, start: str, end: str, wqz: tuple[str, ...]) -> DataFrame:
    """Spans by the coarser key within a closed period, for some water quality zones."""
    inside = directory.filter(times.within(F.col("start_ts"), start, end, closed=True))
    inside = _known(inside.filter(F.col("wqz").isin(*wqz)), PERIOD_KEYS)
    return inside.groupBy(*PERIOD_KEYS).agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.min("intervention_type").alias("type"),
        F.min("zone").alias("zone"),
    )
