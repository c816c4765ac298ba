"""The analyses from CSV extracts to report tables, on a small network of four zones."""

import csv
import dataclasses
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventlink.operators import conform
from eventlink.operators.link import Rule
from eventlink.plans import jobs
from eventlink.sources import extracts, readers


def put(path, header, *rows, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def dated(columns, **given):
    return [given.get(c, "") for c in columns]


@pytest.fixture(scope="module")
def x(tmp_path_factory):
    d = tmp_path_factory.mktemp("extracts")
    valve = ["WORK_ORDER", "OPERATION_NUMBER", "DMA_ID1", "DMA_SAP_CODE1", "UADMS_ID", "STD_TEXT_KEY_DESC"]
    valve += ["POINT_X", "POINT_Y", *extracts.VALVE_DATES, "EXTRA"]
    main = ["WORK_ORDER", "OPERATION_NUMBER", "DMA_CODE", "DMA_SAP_CODE", *extracts.BURST_MAIN_DATES]
    zone_header = ["Reference", "Name", "TMA", "Water Quality Zone - Description"]
    zone_header += ["Control Group - Description", "SAP Area - Description"]
    sheet = ["Start Date", "End Date", "Start Time", "End Time", "County", "DMA(s)", "Type", "BB Notification"]
    sheet += ["Contact", "COSC Auth.", "Region", "Control Group", "Description"]
    listed = ["Start Date/Time", "End Date/Time", "District", "DMA", "Work type", "SAP Number", "Contact Name"]
    listed += ["Authorised By", "Region", "Control Group", "Description", "Item Type", "Path"]
    return jobs.Extracts(
        zones=put(
            d / "zones.csv",
            zone_header,
            ["04001", "One", "Yes", "WQ1", "CG1", "Central"],
            ["04002", "Two", "No", "WQ1", "CG1", "Central"],
            ["04003", "Café", "Yes", "WQ2", "CG2", "Central"],
            ["05001", "Far", "Yes", "WQ3", "CG3", "Derbyshire"],
        ),
        neighbours=put(d / "nb.csv", ["ID_DMA_COD", "NEIGHBORS"], ["4001", "4002"], ["4002", "4001, 4003"]),
        postcodes=put(d / "pc.csv", ["Postcode", "DMA"], ["CV1 2TT", "4001"], ["B1 1AA", "5001"]),
        demographics=put(
            d / "demo.csv",
            ["Key", "ID_DMA_COD", "ACORN", "TOTALHOUSEHOLDS"],
            ["CV1 2TT", "4001", "2", "1,200"],
            ["B1 1AA", "5001", "61", "10"],
        ),
        complaints=put(
            d / "complaints.csv",
            ["", "ComplaintRef", "Date", "Time", "DMA", "Postcode", "X", "Y", "Incident Related", "Translated"],
            ["0", "C1", "02/03/2016", "09:00:00", "04002", "CV12TT", "0", "5", "Y", "Appearance"],
            ["1", "C2", "02/03/2016", "23:00:00", "04002", "CV12TT", "7", "0", "N", "Appearance"],
            ["2", "C3", "03/03/2016", "10:00:00", "04002", "B11AA", "", "", "", "Appearance"],
            ["3", "C4", "03/03/2016", "10:00:00", "04002", "XX", "1", "1", "N", "Taste"],
            ["4", "C5", "09/03/2016", "10:00:00", "05001", "B11AA", "1", "1", "N", "Appearance"],
            ["5", "C6", "09/03/2016", "10:00:00", "", "", "1", "1", "N", "Appearance"],
            ["6", "C7", "nonsense", "10:00:00", "04001", "", "1", "1", "N", "Appearance"],
        ),
        anomalies=str(d / "anomalies"),
        sensors=put(d / "sensors.csv", ["sensor_id", "zone"], ["11", "4001"], ["12", "4003"]),
        valves=[
            put(
                d / "valves.csv",
                valve,
                dated(
                    valve,
                    WORK_ORDER="70,012",
                    OPERATION_NUMBER="0020",
                    DMA_ID1="4001",
                    UADMS_ID="A1",
                    STD_TEXT_KEY_DESC="Close valve",
                    POINT_X="412,345",
                    POINT_Y="298765",
                    DATE_CREATED="01/03/2016 08:00:00",
                    DATE_ARRIVED="02/03/2016 08:00:00",
                    DATE_COMPLETED="02/03/2016 09:30:00",
                ),
                dated(valve, WORK_ORDER="70013", DMA_ID1="4001", DATE_CREATED="01/03/2016 08:00:00"),
            ),
            put(
                d / "old_valves.csv",
                valve,
                dated(
                    valve,
                    WORK_ORDER="70012",
                    OPERATION_NUMBER="0020",
                    DMA_ID1="4001",
                    DATE_CREATED="02/03/2016 07:00:00",
                    DATE_COMPLETED="02/03/2016 11:00:00",
                ),
            ),
        ],
        burst_mains=[
            put(
                d / "mains.csv",
                main,
                dated(
                    main,
                    WORK_ORDER="80001",
                    OPERATION_NUMBER="0010",
                    DMA_CODE="4003",
                    DATE_CREATED="05/03/2016 06:00:00",
                    DATE_COMPLETED="05/03/2016 12:00:00",
                    OP_ACTUAL_FINISH_DT="05/03/2016 10:00:00",
                ),
            )
        ],
        repairs=put(
            d / "repairs.csv",
            ["Notification Date", "Floc. DMA_ID", "Operation", "FDB Technique", "FDB Size", "FDB Material"]
            + ["Nearest Neighbour Pipe ID"],
            ["05/03/2016", "Café", "80001/0010", "Clamp", "", "Iron", "P1"],
            ["06/03/2016", "Nowhere", "80002/0010", "Clamp", "4", "Iron", "P2"],
        ),
        interruptions=put(
            d / "interruptions.csv",
            ["Start Date", "Start Time", "End Date", "End Time", "DMA(s)", "Order Number", "Cause of Interruption"]
            + ["Grid Ref X", "Grid Ref Y"],
            ["07/03/2016", "10:00:00", "07/03/2016", "12:00:00", "04003", "I 5", "Burst", "1", "2"],
        ),
        bursts=put(
            d / "bursts.csv",
            ["External ID1", "Date Reported", "Date Completed", "Address - Postcode", "Burst Type", "Leakage Type"],
            ["90001-10", "02/03/2016 05:00", "", "cv1 2tt", "Main Burst", "Visible"],
            ["90001-20", "02/03/2016 05:00", "", "cv1 2tt", "Main Burst", "Visible"],
            ["90002-10", "02/03/2016 06:00", "", "b1 1aa", "Fitting Burst", "Visible"],
            ["90003-10", "02/03/2016 07:00", "", "", "Fitting Burst", "Visible"],
        ),
        completed_works=[
            put(
                d / "works1" / "w.csv",
                ["Order", "Operation", "Floc. DMA_ID", "Ord. Address XY", "Op. Created date", "Op. Actual Finish date"],
                ["90001", "0010", "04002 X", "412345298765", "02/03/2016", "03/03/2016"],
                ["90001", "0020", "04003 X", "Not assigned", "02/03/2016", "bad"],
            ),
            put(
                d / "works2" / "w.csv",
                ["Order", "Operation", "Floc. DMA_ID", "FWR Grid Ref X", "FWR Grid Ref Y", "Op. Created date"]
                + ["Op. Actual Finish date"],
                ["x", "0020", "04003 X", "1", "2", "02/03/2016", "03/03/2016"],
            ),
        ],
        planned=put(
            d / "planned.csv",
            ["Op. Created date", "Floc. DMA_ID", "X-Y Co-ordinates", "Ord. Maintenance Plant", "Unnamed: 12", "Order", "Operation"],
            ["04/03/2016", "04001-AB", "412345298765", "Water Distribution - East", "flush", "7001", "0010"],
            ["04/03/2016", "04001-AB", "#", "Waste Water - East", "sewer", "7002", "0010"],
            ["04/03/2016", "#", "Not assigned", "Water Distribution - West", "lost", "", ""],
        ),
        unplanned=[
            put(
                d / "u2015" / "u.csv",
                ["Op. Created date", "Op. Completed date", "Floc. DMA_ID", "X-Y Co-ordinates", "Unnamed: 3", "Unnamed: 15"]
                + ["Order", "Operation"],
                ["03/03/2016 08:00", "03/03/2016 09:00", "04003-AB", "412345298765", "Water Distribution - South", "leak"]
                + ["8001", "0020"],
            ),
            put(
                d / "u2016" / "u.csv",
                ["Op. Created date", "Op. Completed date", "Floc. DMA_ID", "X-Y Co-ordinates", "Unnamed: 3"],
                ["03/03/2016 08:00", "03/03/2016 09:00", "04003-AB", "412345298765", "Other"],
            ),
        ],
        incidents=put(
            d / "incidents.csv",
            ["", "Created Date", "Timestamp", "Name", "Dma", "Region", "Sap Order", "X", "Y"],
            ["0", "08/03/2016 08:00", "", "Flood", "4/001", "Cntral", "0", "10", "1"],
            ["1", "08/03/2016 09:00", "08/03/2016 15:00", "Flood", "4/001", "Cntral", "0", "30", "1"],
            ["2", "08/03/2016 09:00", "08/03/2016 15:00", "Training flood", "4/001", "Central", "5", "30", "1"],
            ["3", "09/03/2016 09:00", "", "Several sites", "Several", "Central", "77", "", ""],
        ),
        planned_sheets=[
            put(
                d / "sheet1.csv",
                sheet,
                ["10/03/2016", "10/03/2016", "08:30", "", "4", "1", "Rehab", "N1", "", "", "Brum", "", "mains"],
                [""] * 13,
            ),
            put(
                d / "sheet2.csv",
                sheet,
                ["11/03/2016", "12/03/2016", "night", "tbc", "9", "9", "LD", "N2", "", "", "Brum", "old", "flow"],
            ),
        ],
        planned_list=put(
            d / "list.csv",
            listed,
            ["13/03/2016 08:00", "13/03/2016 10:00", "4", "2", "Infra", "N3", "", "", "Central", "CG1", "new", "i", "p"],
        ),
        zone_exceptions=put(d / "ex.csv", ["raw", "zone"], ["Several", "Multiple"], ["0", ""]),
        region_names=put(d / "regions.csv", ["raw", "value"], ["Cntral", "Central"], ["Brum", "Central"]),
        work_type_names=put(d / "types.csv", ["raw", "value"], ["Rehab", "Infra"]),
        control_group_names=put(d / "groups.csv", ["raw", "value"], ["old", "CG9"]),
    )


@pytest.fixture(scope="module")
def spans(spark, x, tmp_path_factory):
    header = ["ReadingHour", "SensorFileName", "SensorID"]
    folder = tmp_path_factory.mktemp("out")
    import pathlib

    put(
        pathlib.Path(x.anomalies) / "a.csv",
        header,
        ["02/03/2016 08:00", "f1", "11"],
        ["05/03/2016 07:00", "f2", "12"],
        ["20/03/2016 07:00", "f3", "99"],
    )
    put(pathlib.Path(x.anomalies) / "b.csv", header, ["02/03/2016 08:00", "f1", "11"])
    return jobs.event_spans(spark, x, str(folder)), str(folder)


def test_event_spans(spans):
    rows = {(r["intervention_type"], r["order_id"], r["zone"]): r for r in spans[0].collect()}
    valve = rows["Valve Op", "70012", "04001"]
    assert (valve["start_ts"], valve["end_ts"]) == (datetime(2016, 3, 2, 7), datetime(2016, 3, 2, 11))
    assert (valve["operation"], valve["wqz"], valve["region"]) == ("20", "WQ1", "Central")
    repair = rows["Mains Repair", "80001", "04003"]
    assert (repair["start_ts"], repair["end_ts"]) == (datetime(2016, 3, 5, 6), datetime(2016, 3, 5, 10))
    assert ("Main Burst", "90001", "04002") in rows and ("Main Burst", "90001", "04003") in rows
    burst = rows["Fitting Burst", "90002", "05001"]
    assert (burst["region"], burst["end_ts"]) == ("Derbyshire", datetime(2016, 3, 2, 7))
    assert rows["Interruption", "5", "04003"]["end_ts"] == datetime(2016, 3, 7, 12)
    # An incident without order is named NoOrderFlood_2016-03-08, whose second piece reads as a number.
    flood = rows["NC Incident", "3", "04001"]
    assert (flood["start_ts"], flood["end_ts"]) == (datetime(2016, 3, 8, 8), datetime(2016, 3, 8, 15))
    assert rows["NC Incident", "77", "Multiple"]["control_group"] == "unknown"
    assert sum(k[0] == "NC Incident" for k in rows) == 2
    sheet = rows["NC Planned work", "N1", "04001"]
    assert (sheet["start_ts"], sheet["end_ts"]) == (datetime(2016, 3, 10, 8, 30), datetime(2016, 3, 10, 23, 59, 59))
    other = rows["NC Planned work", "N2", "09009"]
    assert (other["start_ts"], other["control_group"], other["region"]) == (datetime(2016, 3, 11, 22), "CG9", "Central")
    assert ("NC Planned work", "N3", "04002") in rows
    # Planned and unplanned work without an order has no span of its own.
    assert {k[:2] for k in rows if k[0].startswith("SAP")} == {("SAP Planned work", "7001"), ("SAP Unplanned work", "8001")}


def test_directory_sources(spark, x):
    directory = jobs.event_directory(spark, x)
    found = {r["intervention_type"]: r["n"] for r in directory.groupBy("intervention_type").agg(F.count("*").alias("n")).collect()}
    assert found["SAP Planned work"] == 2 and found["SAP Unplanned work"] == 1
    planned = directory.filter("description = 'flush'").first()
    assert (planned["x"], planned["y"], planned["zone"]) == ("412345", "298765", "04001")
    assert directory.filter("description = 'lost'").first()["zone"] == "unknown"
    assert directory.filter("intervention_type = 'Valve Op'").select("source_file").distinct().count() == 2
    assert directory.filter("description = 'Clamp, Iron'").count() == 1
    assert directory.filter("description = 'Infra: mains'").count() == 1
    again = {r["key"] for r in jobs.event_directory(spark, x).select("key").collect()}
    assert again == {r["key"] for r in directory.select("key").collect()}
    assert conform.without_start(directory).count() == 1


@pytest.fixture(scope="module")
def tables(spark, x, spans):
    scope = jobs.Scope("2016-01-01", "2016-07-01", zone_prefix="04")
    return jobs.link_all(spark, x, spans[0], scope, spans[1])


def test_links(tables):
    complaints = {r["id"]: r for r in tables.complaints.collect()}
    assert set(complaints) == {"C1", "C2", "C3"}
    first = complaints["C1"]
    assert (first["daily_cluster_size"], first["consecutive_cluster_size"], first["cluster_id"]) == (2, 4, "04002/2016-03-02")
    assert (first["x"], first["incident_related"], first["acorn17"], first["acorn5"]) == (None, True, "A", "C1")
    assert (first["year"], first["hour"], first["weekday"], first["region"]) == (2016, 9, 2, "Central")
    # The valve operation in 04001 and the burst in 04002 precede it within a day, nearby.
    assert (first["valve_op"], first["main_burst"], first["number_of_anomaly"]) == (1, 1, 1)
    assert first["from_work_related_anomaly"] and not complaints["C3"]["from_work_related_anomaly"]
    anomalies = {r["sensor_file"]: r for r in tables.anomalies.collect()}
    assert len(anomalies) == 3
    assert anomalies["f1"]["from_works"] and anomalies["f1"]["number_of_complaint"] == 2
    assert anomalies["f2"]["from_works"] and anomalies["f2"]["number_of_complaint"] == 0
    assert anomalies["f3"]["zone"] is None and not anomalies["f3"]["from_works"]
    causes = {r["order_id"]: r for r in tables.causes.filter("zone = '04001'").collect()}
    assert (causes["70012"]["number_of_anomaly"], causes["70012"]["number_of_complaint"]) == (1, 2)


def test_reports(spark, x, tables):
    rule = Rule(edges=extracts.zone_edges(spark, x.neighbours), hours=24)
    out = jobs.reports(tables, rule)
    followed = {r["intervention_type"]: (r["n_true"], r["n_false"]) for r in out["year_followed"].collect()}
    assert followed["Valve Op"] == (1, None) and followed["Mains Repair"] == (None, 1)
    totals = {(r["grouping"], r["year"], r["region"]): r["any_cause"] for r in out["attribution_totals"].collect()}
    assert totals["year", 2016, None] == 2
    shares = out["shares"].first()
    assert (shares["n"], shares["n_works"], shares["n_complaint"]) == (3, 2, 1)
    assert sum(r["n"] for r in out["random_baseline"].collect()) == 3
    assert out["poisson"].count() > 1
    assert out["type_followed_by_anomaly"].count() >= 2


def test_insight(spark, x, spans, tables):
    dim = extracts.zone_dimension(spark, x.zones)
    people = extracts.demographics(spark, x.demographics)
    complaints = extracts.complaints(spark, x.complaints, people, dim)
    out = jobs.complaint_insight(complaints, people, dim, spans[1])
    rates = {r["code"]: r for r in out["rates"].filter("level = 'acorn17'").collect()}
    assert (rates["A"]["households"], rates["A"]["n"], rates["A"]["per_100"]) == (1200, 2, pytest.approx(1 / 6))
    regions = [(r["region"], r["n"]) for r in out["region_rates"].collect()]
    assert regions == [("Derbyshire", 1), ("Central", 5)]
    assert sum(r["n"] for r in out["time_of_day"].collect()) == 6
    assert out["clusters"].count() == 2
    assert out["density"].count() == 2 * 3650
    written = spark.read.option("header", True).csv(f"{spans[1]}/complaints_by_hour")
    assert "h23" in written.columns and written.count() > 0
    assert out["profile_by_category"].filter("acorn5 = 'C1'").first()["h09"] == pytest.approx(1000 / 1200)


def test_reader_details(spark, tmp_path):
    spec = readers.Spec("t", (readers.Field("A b", "a"), readers.Field("C", "c", "strict")))
    path = put(tmp_path / "t.csv", ["C", "A b"], ["", "é"], ["01/02/2016 03:04:05", "04722"])
    rows = readers.read(spark, path, spec).collect()
    assert [(r["a"], r["c"], r["source_file"]) for r in rows] == [
        ("é", None, "t.csv"),
        ("04722", datetime(2016, 2, 1, 3, 4, 5), "t.csv"),
    ]
    with pytest.raises(ValueError, match="columns not found: Z"):
        readers.read(spark, path, readers.Spec("t", (readers.Field("Z", "z"),)))
    bad = put(tmp_path / "bad.csv", ["C", "A b"], ["2016", "x"])
    with pytest.raises(PySparkException, match="not a date and time"):
        readers.read(spark, bad, spec).collect()


def test_unreadable_file_is_skipped(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("A\n1\n")
    (tmp_path / "b.csv.gz").write_bytes(b"this is not gzip")
    spec = readers.Spec("t", (readers.Field("A", "a", "long"),))
    rows = readers.read(spark, str(tmp_path), spec, skip_unreadable=True)
    assert [r["a"] for r in rows.collect()] == [1]


def test_logger(spark, tmp_path):
    put(tmp_path / "L-1-0.csv", ["DateTime", "Reading"], ["01-03-2016 06:30", "1.5"], ["bad", "2"])
    put(tmp_path / "L2-1.csv", ["DateTime", "Reading"], ["01-03-2016 06:30", "3"])
    readings = extracts.logger_readings(spark, str(tmp_path))
    rows = extracts.logger_data(readings, "L-1").orderBy("reading").collect()
    assert [(r["reading"], r["weekday"], r["minute_of_day"]) for r in rows] == [(1.5, 1, 390), (2.0, None, None)]
    assert extracts.logger_data(readings, "L2", 1).count() == 1


def test_summary_extracts(spark, tmp_path):
    header = ["WORK_ORDER", *extracts.WORK_ORDER_DATES]
    path = put(tmp_path / "w.csv", header, ["1,234", "01/02/2016 03:04:05", "", "", "", ""])
    row = readers.read(spark, path, extracts.WORK_ORDERS).first()
    assert (row["work_order"], row["early_start_date"]) == (1234, datetime(2016, 2, 1, 3, 4, 5))
    header = ["WORK_ORDER", *extracts.WORK_ORDER_SUMMARY_DATES]
    path = put(tmp_path / "s.csv", header, ["1,234", "bad", *[""] * 6])
    assert readers.read(spark, path, extracts.WORK_ORDER_SUMMARY).first()["cur_op_status_date"] is None
    path = put(tmp_path / "r.csv", ["WORK_ORDER", *extracts.REPAIR_SUMMARY_DATES], ["5", "", ""])
    assert readers.read(spark, path, extracts.REPAIR_SUMMARY).first()["work_order"] == 5


def test_conform_helpers(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, None, None)], "a int, b string, `c.d` string")
    kept = conform.drop_blank(rows)
    assert kept.columns == ["a", "c.d"] and kept.count() == 1
    ops = spark.createDataFrame([("k", 20), ("k", 10), ("k", 20), ("k", 100)], "k string, op int")
    found = conform.operations_by(ops, ["k"], "op")
    lists = found.select(conform.every_operation(F.col("operations")), conform.distinct_operations(F.col("operations")))
    assert tuple(lists.first()) == ([10, 20, 20, 100], "10,100,20")
    with pytest.raises(ValueError, match="differ"):
        conform.control_planned_work([rows, rows.drop("a")], rows, rows, rows, rows, rows)


def test_period_spans(spark):
    rows = spark.createDataFrame(
        [
            ("1", "0", "T", "W", "b", "2016-01-01 00:00:00", "2016-01-01 01:00:00"),
            ("1", "0", "T", "W", "a", "2016-04-01 00:00:00", "2016-04-02 00:00:00"),
            ("1", "0", "T", "W", "a", "2016-04-01 00:00:01", "2016-05-02 00:00:00"),
            ("1", "0", "T", "V", "a", "2016-02-01 00:00:00", "2016-02-02 00:00:00"),
        ],
        "order_id string, operation string, intervention_type string, wqz string, zone string, s string, e string",
    )
    rows = rows.selectExpr("*", "cast(s as timestamp_ntz) start_ts", "cast(e as timestamp_ntz) end_ts")
    found = conform.merge_spans_in_period(rows, "2016-01-01", "2016-04-01", ("W",)).collect()
    assert [(r["start_ts"], r["end_ts"], r["zone"]) for r in found] == [
        (datetime(2016, 1, 1), datetime(2016, 4, 2), "a")
    ]


def test_quoted_text_keeps_its_columns(spark, tmp_path):
    spec = readers.Spec("q", (readers.Field("A", "a"), readers.Field("N", "n", "double")))
    path = put(tmp_path / "q.csv", ["A", "N"], ['say "hi, there" x', "NaN"], ["b", "1,000.5"])
    rows = {r["a"]: r["n"] for r in readers.read(spark, path, spec).collect()}
    assert rows == {'say "hi, there" x': None, "b": 1000.5}


def test_folder_of_differing_headers(spark, tmp_path):
    """Three orders of columns, rows too long and too short, and files that hold no such table."""
    spec = readers.Spec("m", (readers.Field("A", "a"), readers.Field("B", "b", "long"), readers.Field("C", "c", optional=True)))
    put(tmp_path / "m" / "1.csv", ["A", "B"], ["a1", "1"], ["a2"], ["a3", "3", "more"], ["a4", "4", "x", "y"])
    put(tmp_path / "m" / "2.csv", ["B", "A", "C"], ["5", "a, 5", "c5"])
    put(tmp_path / "m" / "3.csv", ["", "C", "A", "B", "A"], ["0", "c6", "a6", "6", "again"])
    put(tmp_path / "m" / "4.csv", ["C", "A"], ["c", "lost"])
    (tmp_path / "m" / "5.csv").write_text("")
    (tmp_path / "m" / "6.csv.gz").write_bytes(b"this is not gzip")
    found = readers.scan(spark, str(tmp_path / "m"), spec, skip_unreadable=True)
    rows = {(r["a"], r["b"], r["c"], r["source_file"]) for r in found.rows.collect()}
    assert rows == {("a1", 1, None, "1.csv"), ("a2", None, None, "1.csv"), ("a, 5", 5, "c5", "2.csv"), ("a6", 6, "c6", "3.csv")}
    told = sorted((r["path"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in found.quarantine.collect())
    assert told == [
        ("1.csv", "a3,3,more", "more cells than the header"),
        ("1.csv", "a4,4,x", "more cells than the header"),
        ("4.csv", None, "columns not found: B"),
        ("5.csv", None, "no header could be read"),
        ("6.csv.gz", None, "no header could be read"),
    ]
    with pytest.raises(ValueError, match="columns not found: B"):
        readers.read(spark, [str(tmp_path / "m" / f"{k}.csv") for k in (1, 4)], spec)
    with pytest.raises(PySparkException, match="more cells than the header"):
        readers.read(spark, str(tmp_path / "m" / "1.csv"), spec).collect()
    two = readers.read(spark, [str(tmp_path / "m" / f"{k}.csv") for k in (2, 3)], spec)
    assert {r["b"] for r in two.collect()} == {5, 6}
    none = readers.scan(spark, str(tmp_path / "m" / "4.csv"), spec)
    assert none.rows.count() == 0 and none.rows.columns == found.rows.columns


def test_reconciled_works(spark, x, tmp_path):
    d = tmp_path
    sheet = ["Order", "Operation", "Floc. DMA_ID", "ESPB Type", "Op. Created date", "Op. Actual Finish date"]
    rows = [["90001", "0010", "04002 X", "Mains", "02/03/2016", "03/03/2016"], ["90001", "0020", "04003 X", "Mains", "02/03/2016", ""]]
    rows += [["95000", "0010", "04003 X", "Ancillary", "02/03/2015", ""], ["x", "1", "04003 X", "Ancillary", "02/03/2015", ""], [""] * 6]
    put(d / "works" / "w.csv", sheet, *rows)
    (d / "works" / "broken.csv").write_text("Report\nnot a table")
    repair = ["Notification Date", "Floc. DMA_ID", "Operation"]
    given = dataclasses.replace(
        x,
        completed_works=[str(d / "works")],
        repairs=put(d / "mains.csv", repair, ["05/03/2016", "04003", "90001/0010"], ["05/03/2016", "04003", "90003/10"], ["05/03/2016", "04003", "1/1"]),
        ancillary_repairs=put(d / "ancillary.csv", repair, ["05/03/2016", "04003", "95000/0010"]),
        repair_orders=put(d / "ro.csv", ["WORK_ORDER", *extracts.REPAIR_SUMMARY_DATES], ["90,001", "", "01/02/2016 03:04:05"]),
        work_orders=put(d / "wo.csv", ["WORK_ORDER", *extracts.WORK_ORDER_DATES], ["95000", *[""] * 5], ["90001", *[""] * 5]),
        work_order_summary=put(d / "ws.csv", ["WORK_ORDER", *extracts.WORK_ORDER_SUMMARY_DATES], ["7", "bad", *[""] * 6]),
    )
    found = jobs.reconcile_works(spark, given, str(d / "out"))
    # Works: two with their bursts, one of another order, one without a key. Bursts 90002 and 90003 have no work.
    assert {r["merged"]: r["n"] for r in found.by_merge.collect()} == {"both": 2, "left_only": 2, "right_only": 2}
    assert {(r["repair_type"], r["merged"]): r["n"] for r in found.by_type.collect()} == {("Mains", "both"): 2, ("Ancillary", "left_only"): 2}
    mains = {(r["found"], r["merged"]): r["n"] for r in found.mains.collect()}
    assert mains == {("both", "both"): 1, ("both", "right_only"): 1, ("left_only", None): 1, ("right_only", "both"): 1, ("right_only", "left_only"): 1, ("right_only", "right_only"): 1}
    ancillary = {(r["found"], r["merged"]): r["n"] for r in found.ancillary.collect()}
    assert ancillary[("both", "left_only")] == 1 and ("left_only", None) not in ancillary
    covered = {(r["extract"], r["year"]): r["n"] for r in found.coverage.filter("covered").collect()}
    assert covered == {("repair_orders", 2016): 2, ("work_orders", 2016): 2, ("work_orders", 2015): 1}
    assert [r["path"].rsplit("/", 1)[1] for r in found.quarantine.collect()] == ["broken.csv"]


def test_snapshot_knows_its_inputs(spark, tmp_path):
    put(tmp_path / "in" / "a.csv", ["A"], ["1"])
    path, inputs, built = str(tmp_path / "out"), [str(tmp_path / "in")], []

    def build():
        built.append(1)
        return readers.read(spark, inputs, readers.Spec("t", (readers.Field("A", "a", "long"),)))

    def rows(**parameters):
        return sorted(r["a"] for r in readers.kept_snapshot(spark, path, inputs, build, **parameters).collect())

    assert rows() == [1] and rows() == [1] and len(built) == 1
    put(tmp_path / "in" / "a.csv", ["A"], ["1"], ["22"])
    assert rows() == [1, 22] and len(built) == 2
    put(tmp_path / "in" / "b.csv", ["A"], ["3"])
    assert rows() == [1, 3, 22] and rows() == [1, 3, 22] and len(built) == 3
    # A write that breaks off leaves files that are not those told beside them.
    next((tmp_path / "out").glob("part-*.parquet")).write_bytes(b"")
    assert rows() == [1, 3, 22] and len(built) == 4
    assert rows(parameters="other") == [1, 3, 22] and len(built) == 5

    def interrupted():
        raise RuntimeError("stopped")

    put(tmp_path / "in" / "c.csv", ["A"], ["4"])
    with pytest.raises(RuntimeError):
        readers.kept_snapshot(spark, path, inputs, interrupted)
    assert rows() == [1, 3, 4, 22] and len(built) == 6


def test_sheet_with_preamble_and_column_range(spark, tmp_path):
    """Three rows above the header, columns outside the range, in a file of several blocks."""
    spec = readers.Spec("s", (readers.Field("A", "a"), readers.Field("N", "n", "long")))
    body = [["x", "", "", f"a{k}", str(k), f"A{k}"] for k in range(2000)]
    put(tmp_path / "s" / "1.csv", ["Report"], ["A", "N"], [""], ["z", "", "", "A", "N", "A"], *body)
    put(tmp_path / "s" / "2.csv", ["Report, again", "two"], [], ["of"], ["", "", "", "N", "A", "N"], ["q", "", "", "7", "b7", "9"])
    put(tmp_path / "s" / "3.csv", ["too", "short"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = readers.scan(spark, str(tmp_path / "s"), spec, readers.Sheet(3, "D", "E"))
        rows = {(r["a"], r["n"], r["source_file"]) for r in found.rows.collect()}
        lines = readers.numbered_lines(spark, str(tmp_path / "s" / "1.csv"), spec).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {(f"a{k}", k, "1.csv") for k in range(2000)} | {("b7", 7, "2.csv")}
    assert [(r["path"][-5:], r["reason"]) for r in found.quarantine.collect()] == [("3.csv", "no header could be read")]
    assert sorted(r["number"] for r in lines) == list(range(1, 2005))
    assert {r["number"]: r["line"] for r in lines}[104] == "x,,,a99,99,A99"
    assert readers.Sheet(0, "G", "AE").columns() == slice(6, 31)
