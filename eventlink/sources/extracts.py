"""The extracts: their columns, and the readers that make tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.functions import codes, labels, times
from eventlink.operators import clusters, conform, zones
from eventlink.operators.joins import attach, keep_first
from eventlink.sources.readers import Field, Joined, Scan, Sheet, Spec, read, scan

# Column names of the extracts.
_OPERATION_DATES = (
    "DATE_CREATED",
    "DATE_RELEASED_SCHED",
    "DATE_DISPATCHED",
    "DATE_ACCEPTED",
    "DATE_ARRIVED",
    "DATE_PARKED",
    "DATE_REJECTED",
    "DATE_SUSPEND",
    "DATE_COMPLETED",
    "DATE_CANCELLED",
)
VALVE_DATES = ("VALVE_STATUS_DATE", "DATE_POTENTIAL", *_OPERATION_DATES)
BURST_MAIN_DATES = (
    "JOB_STATUS_DATE",
    "EARLIEST_START_DATE",
    "LATEST_FINISH_DATE",
    "OP_ACTUAL_FINISH_DT",
    *_OPERATION_DATES,
)
REPAIR_SUMMARY_DATES = ("FWR_CREATE_DT", "OP_ACTUAL_FINISH_DT")
WORK_ORDER_DATES = ("EARLY_START_DATE", "LATEST_FINISH_DATE", "ACTUAL_FINISH_DATE", "STATUS_DATE", "CREATED_DATE")
WORK_ORDER_SUMMARY_DATES = (
    "CUR_OP_STATUS_DATE",
    "CUR_OP_EARLY_START_DATE",
    "CUR_OP_LATEST_FINISH_DATE",
    "WO_EARLIEST_START_DATE",
    "WO_LATEST_FINISH_DATE",
    "CREATED_DATE",
    "MODIFIED_DATE",
)


def _dates(names: tuple[str, ...], kind: str = "strict") -> tuple[Field, ...]:
    return tuple(Field(n, n.lower(), kind) for n in names)


ZONES = Spec(
    "zones",
    (
        Field("Reference", "zone"),
        Field("Name", "zone_name"),
        Field("TMA", "tma", optional=True),
        Field("Water Quality Zone - Description", "wqz"),
        Field("Control Group - Description", "control_group"),
        Field("SAP Area - Description", "region"),
    ),
)
NEIGHBOURS = Spec("neighbours", (Field("ID_DMA_COD", "zone"), Field("NEIGHBORS", "neighbours")))
POSTCODES = Spec("postcodes", (Field("Postcode", "postcode"), Field("DMA", "zone")))
DEMOGRAPHICS = Spec(
    "demographics",
    (
        Field("Key", "postcode"),
        Field("ID_DMA_COD", "zone"),
        Field("ACORN", "acorn59", "long"),
        Field("TOTALHOUSEHOLDS", "households", "number"),
    ),
)
COMPLAINTS = Spec(
    "complaints",
    (
        Field("ComplaintRef", "id"),
        Field("Date", "date", "date"),
        Field("DMA", "zone"),
        Field("Postcode", "postcode"),
        Field("X", "x", "double"),
        Field("Y", "y", "double"),
        Field("Incident Related", "incident_related"),
        Field("Translated", "category"),
    ),
    joined=(Joined("Date", "Time", "ts"),),
)
ANOMALIES = Spec(
    "anomalies",
    (
        Field("ReadingHour", "ts", "day_first"),
        Field("SensorFileName", "sensor_file"),
        Field("SensorID", "sensor_id", "long"),
    ),
)
SENSORS = Spec("sensors", (Field("sensor_id", "sensor_id", "long"), Field("zone", "zone")))
VALVES = Spec(
    "valve operations",
    (
        Field("WORK_ORDER", "work_order", "number"),
        Field("OPERATION_NUMBER", "operation_number", optional=True),
        Field("DMA_ID1", "dma_id1"),
        Field("DMA_SAP_CODE1", "dma_sap_code1", optional=True),
        Field("UADMS_ID", "uadms_id"),
        Field("STD_TEXT_KEY_DESC", "std_text_key_desc"),
        Field("POINT_X", "point_x", "double"),
        Field("POINT_Y", "point_y", "double"),
        *_dates(VALVE_DATES),
    ),
)
BURST_MAINS = Spec(
    "burst mains",
    (
        Field("WORK_ORDER", "work_order", "number"),
        Field("OPERATION_NUMBER", "operation_number", optional=True),
        Field("DMA_CODE", "dma_code"),
        Field("DMA_SAP_CODE", "dma_sap_code", optional=True),
        *_dates(BURST_MAIN_DATES),
    ),
)
REPAIR_SUMMARY = Spec(
    "mains repair summary", (Field("WORK_ORDER", "work_order", "number"), *_dates(REPAIR_SUMMARY_DATES))
)
WORK_ORDERS = Spec("work orders", (Field("WORK_ORDER", "work_order", "number"), *_dates(WORK_ORDER_DATES)))
WORK_ORDER_SUMMARY = Spec(
    "work order summary",
    (Field("WORK_ORDER", "work_order", "number"), *_dates(WORK_ORDER_SUMMARY_DATES, "datetime")),
)
REPAIRS = Spec(
    "repairs",
    (
        Field("Notification Date", "notification_date", "date"),
        Field("Floc. DMA_ID", "location"),
        Field("Operation", "order_op"),
        Field("FDB Technique", "fdb_technique", optional=True),
        Field("FDB Size", "fdb_size", optional=True),
        Field("FDB Material", "fdb_material", optional=True),
        Field("Nearest Neighbour Pipe ID", "nearest_neighbour_pipe_id", optional=True),
    ),
)
INTERRUPTIONS = Spec(
    "interruptions",
    (
        Field("DMA(s)", "zone"),
        Field("Order Number", "order_id"),
        Field("Cause of Interruption", "cause"),
        Field("Grid Ref X", "x", "double"),
        Field("Grid Ref Y", "y", "double"),
    ),
    joined=(Joined("Start Date", "Start Time", "start_ts"), Joined("End Date", "End Time", "end_ts")),
)
BURSTS = Spec(
    "bursts",
    (
        Field("External ID1", "external_id"),
        Field("Date Reported", "reported_ts", "day_first"),
        Field("Date Completed", "completed_ts", "day_first"),
        Field("Address - Postcode", "postcode"),
        Field("Burst Type", "burst_type"),
        Field("Leakage Type", "leakage_type"),
    ),
)
COMPLETED_WORKS = Spec(
    "completed works",
    (
        Field("Order", "order_id"),
        Field("Operation", "operation"),
        Field("Floc. DMA_ID", "location"),
        Field("Ord. Address XY", "xy", optional=True),
        Field("FWR Grid Ref X", "grid_x", "double", optional=True),
        Field("FWR Grid Ref Y", "grid_y", "double", optional=True),
        Field("ESPB Type", "repair_type", optional=True),
        Field("Op. Created date", "created_date", "date"),
        Field("Op. Actual Finish date", "finish_date", "date"),
    ),
)
PLANNED = Spec(
    "planned work",
    (
        Field("Order", "order_id", optional=True),
        Field("Operation", "operation", optional=True),
        Field("Op. Created date", "start_ts", "day_first"),
        Field("Floc. DMA_ID", "location"),
        Field("X-Y Co-ordinates", "xy"),
        Field("Ord. Maintenance Plant", "plant"),
        Field("Unnamed: 12", "description", optional=True),
    ),
    sentinels=codes.EXTRACT_SENTINELS,
)
UNPLANNED = Spec(
    "unplanned work",
    (
        Field("Order", "order_id", optional=True),
        Field("Operation", "operation", optional=True),
        Field("Op. Created date", "start_ts", "day_first"),
        Field("Op. Completed date", "end_ts", "day_first"),
        Field("Floc. DMA_ID", "location"),
        Field("X-Y Co-ordinates", "xy"),
        Field("Unnamed: 3", "plant"),
        Field("Unnamed: 15", "description", optional=True),
    ),
    sentinels=codes.EXTRACT_SENTINELS,
)
INCIDENTS = Spec(
    "incident tracker",
    (
        Field("Created Date", "start_ts", "day_first"),
        Field("Timestamp", "task_ts", "day_first"),
        Field("Name", "name"),
        Field("Dma", "zone_text"),
        Field("Region", "region"),
        Field("Sap Order", "sap_order"),
        Field("X", "x", "double"),
        Field("Y", "y", "double"),
    ),
)
OLD_PLANNED_SHEET = Spec(
    "planned work sheet",
    (
        Field("Start Date", "start_date", "day_first"),
        Field("End Date", "end_date", "day_first"),
        Field("Start Time", "start_time"),
        Field("End Time", "end_time"),
        Field("County", "county"),
        Field("DMA(s)", "zones"),
        Field("Type", "work_type"),
        Field("BB Notification", "sap_number"),
        Field("Contact", "contact_name"),
        Field("COSC Auth.", "authorised_by"),
        Field("Region", "region"),
        Field("Control Group", "control_group"),
        Field("Description", "description"),
        Field("Works Name", "works_name", optional=True),
        Field("Contact Number", "contact_number", optional=True),
        Field("Enabling work?", "enabling_work", optional=True),
        Field("Customer warning?", "customer_warning", optional=True),
    ),
)
NEW_PLANNED_SHEET = Spec(
    "planned work list",
    (
        Field("Start Date/Time", "start_ts", "day_first"),
        Field("End Date/Time", "end_ts", "day_first"),
        Field("District", "district"),
        Field("DMA", "zone"),
        Field("Work type", "work_type"),
        Field("SAP Number", "sap_number"),
        Field("Contact Name", "contact_name"),
        Field("Authorised By", "authorised_by"),
        Field("Region", "region"),
        Field("Control Group", "control_group"),
        Field("Description", "description"),
        Field("Works Name", "works_name", optional=True),
        Field("Contact Number", "contact_number", optional=True),
        Field("Enabling work?", "enabling_work", optional=True),
        Field("Customer warning?", "customer_warning", optional=True),
    ),
)
LOGGER = Spec("logger readings", (Field("DateTime", "ts", "logger"), Field("Reading", "reading", "double")))


def zone_dimension(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, ZONES).withColumn("zone", codes.zone_code(F.col("zone")))


def zone_names(dimension: DataFrame) -> DataFrame:
    """Names that may stand in for a zone code."""
    return dimension.filter(F.col("tma") == "Yes").select("zone_name", "zone")


def zone_edges(spark: SparkSession, path: str) -> DataFrame:
    return zones.edges_from_lists(read(spark, path, NEIGHBOURS), "zone", "neighbours")


def postcode_zones(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path, POSTCODES)
    return rows.withColumns(
        {"postcode": codes.strip_spaces(F.col("postcode")), "zone": codes.zone_code(F.col("zone"))}
    )


def demographics(spark: SparkSession, path: str) -> DataFrame:
    """Postcodes with zone, households and the three demographic levels."""
    rows = read(spark, path, DEMOGRAPHICS).withColumns(
        {"postcode": codes.strip_spaces(F.col("postcode")), "zone": codes.zone_code(F.col("zone"))}
    )
    return rows.join(labels.demographic_types(spark), "acorn59", "left")


def with_demographics(df: DataFrame, people: DataFrame) -> DataFrame:
    """Demographic levels by postcode; a postcode listed twice counts once."""
    types = zones.one_value_per_key(people, "postcode", "acorn59")
    types = types.join(labels.demographic_types(df.sparkSession), "acorn59", "left")
    return attach(df, types.withColumnRenamed("postcode", "_postcode"), [(F.col("postcode"), "_postcode")])


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    at = F.col(ts)
    return df.withColumns(
        {
            "year": F.year(at),
            "time": times.time_of_day(at),
            "hour": F.hour(at),
            "decimal_hour": times.decimal_hour(at),
            "ordinal_datetime": times.ordinal_datetime(at),
            "weekday": times.weekday(at),
        }
    )


def complaints(spark: SparkSession, path: str, people: DataFrame, dimension: DataFrame) -> DataFrame:
    """Complaints with clusters, demographics, calendar columns and the zone hierarchy."""
    rows = read(spark, path, COMPLAINTS)
    clean = rows.withColumns(
        {
            "incident_related": F.coalesce(F.col("incident_related") == "Y", F.lit(False)),
            "x": codes.null_if(F.col("x"), 0.0),
            "y": codes.null_if(F.col("y"), 0.0),
        }
    )
    clustered = clusters.with_clusters(clean)
    typed = with_demographics(clustered, people.select("postcode", "acorn59"))
    return zones.enrich(calendar_features(typed), dimension)


def anomalies(spark: SparkSession, folder: str, sensors: DataFrame, dimension: DataFrame) -> DataFrame:
    """Sensor anomalies, each hour and sensor file once, placed by the sensor's zone."""
    rows = keep_first(read(spark, folder, ANOMALIES), ["ts", "sensor_file"], ["source_file", "sensor_id"])
    placed = zones.lookup(rows, F.col("sensor_id"), sensors, "sensor_id", "zone", "zone")
    placed = placed.withColumn("zone", codes.zone_code(F.col("zone")))
    keyed = placed.withColumn("id", codes.content_key("ts", "sensor_file"))
    return zones.enrich(keyed, dimension)


def _operations(spark: SparkSession, paths: list[str], spec: Spec, zone: str) -> DataFrame:
    rows = read(spark, paths, spec)
    number = F.coalesce("operation_number", F.lit(codes.NO_OPERATION))
    return rows.withColumns(
        {
            "operation_number": number,
            "order_op": codes.order_op(F.col("work_order"), number),
            "zone": codes.zone_code(F.col(zone)),
        }
    )


def valve_operations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Current and archived valve operations as one table."""
    return _operations(spark, paths, VALVES, "dma_id1")


def burst_mains(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _operations(spark, paths, BURST_MAINS, "dma_code")


def repairs(spark: SparkSession, paths: str | list[str], names: DataFrame) -> DataFrame:
    """Mains or ancillary repairs with zone, order and operation."""
    placed = zones.zone_from_location(read(spark, paths, REPAIRS), "location", names)
    key = F.col("order_op")
    return placed.withColumns({"order_id": codes.order_part(key), "operation": codes.operation_part(key)})


def _work_orders(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """An extract of work orders with the order as text, as the other extracts have it."""
    return read(spark, path, spec).withColumn("order_id", F.col("work_order").cast("string"))


def repair_orders(spark: SparkSession, path: str) -> DataFrame:
    """Mains repairs of the work-order system; an unreadable date is an error."""
    return _work_orders(spark, path, REPAIR_SUMMARY)


def work_orders(spark: SparkSession, path: str) -> DataFrame:
    """All work orders; an unreadable date is an error."""
    return _work_orders(spark, path, WORK_ORDERS)


def work_order_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of current operations; an unreadable date is null."""
    return _work_orders(spark, path, WORK_ORDER_SUMMARY)


def interruptions(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, INTERRUPTIONS)


def bursts(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("external_id")
    return read(spark, path, BURSTS).withColumns(
        {
            "order_op": F.replace(key, F.lit("-"), F.lit("/")),
            "order_id": codes.integer_text(codes.order_part(key)),
            "operation": codes.operation_part(key).try_cast("bigint"),
            "postcode": codes.postcode(F.col("postcode")),
        }
    )


def completed_works(spark: SparkSession, folders: list[str], names: DataFrame, sheet: Sheet = Sheet()) -> Scan:
    """Completed works of several folders; files that cannot be read are left out and told in the quarantine."""
    found = scan(spark, folders, COMPLETED_WORKS, sheet, skip_unreadable=True)
    rows = conform.without_blank_rows(found.rows)
    placed = conform.completed_works(zones.zone_from_location(rows, "location", names))
    given = {c: F.coalesce(c, F.col(f"grid_{c}").cast("string")) for c in ("x", "y")}
    return Scan(placed.withColumns(given).drop("grid_x", "grid_y", "xy"), found.quarantine)


def planned_work(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path, PLANNED).withColumn("zone", codes.crop(F.col("location")))
    return conform.drop_waste_water(rows)


def unplanned_work(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Yearly parts landed as CSV files or folders."""
    return read(spark, paths, UNPLANNED).withColumn("zone", codes.crop(F.col("location")))


def incident_tracker(spark: SparkSession, path: str, exceptions: DataFrame, regions: DataFrame) -> DataFrame:
    """Tracker tasks with zones and region names put right. ``regions``: raw and value."""
    placed = zones.zone_from_text(read(spark, path, INCIDENTS), "zone_text", exceptions)
    return zones.canonicalise(placed, "region", regions, "raw", "value")


def logger_readings(spark: SparkSession, folder: str) -> DataFrame:
    """All loggers' readings; the logger and its suffix come from the file name."""
    rows = read(spark, folder, LOGGER)
    name = r"^(.*)-([0-9]+)\.csv$"
    return rows.withColumns(
        {
            "logger": F.regexp_extract("source_file", name, 1),
            "suffix": F.regexp_extract("source_file", name, 2).try_cast("int"),
            "weekday": times.weekday(F.col("ts")),
            "minute_of_day": times.minute_of_day(F.col("ts")),
        }
    )


def logger_data(readings: DataFrame, logger: str, suffix: int = 0) -> DataFrame:
    return readings.filter((F.col("logger") == logger) & (F.col("suffix") == suffix))
