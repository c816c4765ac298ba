"""Views on the test tables that stand in for the network's own extracts.

Events and orders take the place of works, anomalies and complaints, nations the place of zones, and
customers the place of postcodes with households. The same views are spelt out in SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.functions import codes
from eventlink.functions.labels import small_table
from eventlink.operators import zones
from eventlink.operators.link import Rule, Side

WORK_TYPES = ("click", "purchase", "signup")
WORKS = ("click", "purchase")
BURSTS = ("signup",)
ORDER_TYPES = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


class Views:
    """Proxy views of one test data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def zone_dim(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
        key = F.col("n_nationkey")
        return joined.select(
            codes.zone_code_from_number(key).alias("zone"),
            F.col("n_name").alias("zone_name"),
            F.concat(F.lit("WQ"), (key % 10).cast("string")).alias("wqz"),
            F.concat(F.lit("CG"), (key % 6).cast("string")).alias("control_group"),
            F.col("r_name").alias("region"),
        )

    def neighbour_lists(self) -> DataFrame:
        """Neighbours as the extract gives them: an unpadded code and a comma list."""
        key = F.col("n_nationkey")
        before = F.when(key > 0, (key - 1).cast("string"))
        after = F.when(key < 24, (key + 1).cast("string"))
        listed = F.concat_ws(", ", before, after)
        return self.table("nation").select(key.cast("string").alias("zone_id"), listed.alias("neighbours"))

    def edges(self) -> DataFrame:
        return zones.edges_from_lists(self.neighbour_lists(), "zone_id", "neighbours")

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("customer"),
            codes.zone_code_from_number(F.col("c_nationkey")).alias("zone"),
            F.col("c_mktsegment").alias("segment"),
            F.concat(F.lit("B"), key.cast("string")).alias("postcode"),
            (key % 62 + 1).cast("int").alias("acorn59"),
            (key % 50 + 100).alias("households"),
        )

    def events(self) -> DataFrame:
        events = self.table("events").select(
            F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), "user_id", "value"
        )
        people = self.customers().select("customer", "zone", "postcode")
        return events.join(people, events["user_id"] == people["customer"]).drop("customer")

    def of_type(self, *types: str) -> DataFrame:
        return self.events().filter(F.col("type").isin(*types)).select("id", "ts", "type", "zone")

    # Event and order numbers are the keys of their tables, so their sides are not asked for repeated ids.

    def works(self) -> Side:
        return Side(self.of_type(*WORK_TYPES), "cause", known_unique=True)

    def anomalies(self) -> Side:
        return Side(self.of_type("view"), "anomaly", known_unique=True)

    def complaints(self) -> Side:
        return Side(self.of_type("error"), "complaint", known_unique=True)

    def rule(self, **changes) -> Rule:
        return Rule(**{"edges": self.edges(), "hours": 24, **changes})

    def complaint_rows(self) -> DataFrame:
        """Complaints with the columns the reports need."""
        rows = self.events().filter(F.col("type") == "error")
        category = F.when(F.col("id") % 3 == 0, "Appearance").otherwise("Taste")
        return rows.select(
            "id", "ts", F.to_date("ts").alias("date"), "zone", "postcode", category.alias("category"), "value"
        )

    def orders(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        people = self.customers().select("customer", "zone")
        joined = orders.join(people, orders["o_custkey"] == people["customer"])
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("type"),
            "zone",
        )

    def order_works(self) -> Side:
        rows = self.orders().filter(F.col("type").isin(*ORDER_TYPES))
        return Side(rows.withColumn("year", F.year("ts")), "cause", known_unique=True)

    def order_complaints(self) -> Side:
        rows = self.orders().filter(F.col("type") == "1-URGENT")
        return Side(rows.select("id", "ts", F.year("ts").alias("year"), "zone"), "complaint", known_unique=True)

    def lines(self) -> DataFrame:
        return self.table("lineitem")

    def mess(self) -> DataFrame:
        """Customers with codes, orders, times and dates as people type them."""
        key, zone = F.col("c_custkey"), F.col("c_nationkey").cast("string")
        number = key.cast("string")

        def cycle(*values) -> Column:
            cases = [F.when(key % len(values) == i, v if isinstance(v, Column) else F.lit(v)) for i, v in enumerate(values)]
            return F.coalesce(*cases)

        hour, minute = (key % 24).cast("string"), F.lpad((key % 60).cast("string"), 2, "0")
        day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
        month = F.lpad((key % 12 + 1).cast("string"), 2, "0")
        year = (key % 7 + 2010).cast("string")
        return self.table("customer").select(
            key.alias("id"),
            cycle(
                zone,
                F.concat(F.lpad(zone, 5, "0"), F.lit(" Main St")),
                "0",
                F.concat(zone, F.lit("/"), F.lpad((key % 1000).cast("string"), 3, "0")),
                "101050",
                F.concat(F.lit("NATION_"), zone),
                "Several",
                None,
                F.concat(zone, F.lit("*5 19")),
            ).alias("zone_text"),
            cycle(zone, F.concat(F.lit("0"), zone), "x", None).alias("district"),
            cycle((key % 1000).cast("string"), "12 ", "7.5").alias("zone_number"),
            cycle(
                number,
                F.concat(F.lit("00"), number),
                F.concat(number, F.lit(" 34")),
                F.concat(F.lit("A&"), number),
                "x-y",
                None,
                F.concat(number, F.lit("/07")),
                F.concat(number, F.lit("-12")),
                "7.9",
            ).alias("order_text"),
            cycle(
                F.concat(hour, F.lit(":"), minute),
                F.concat(hour, F.lit(":"), minute, F.lit(":09")),
                "Night shift",
                "tbc",
                None,
                "TONIGHT",
                "10:30 am",
            ).alias("time_text"),
            cycle(
                F.concat(day, F.lit("/"), month, F.lit("/"), year),
                F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(" 13:05:59")),
                F.concat(year, F.lit("-"), month, F.lit("-"), day),
                "31/02/2016",
                "03/25/2016",
                "soon",
                None,
            ).alias("date_text"),
            cycle(F.concat(F.lit("b"), number, F.lit(" 2 tt")), F.concat(F.lit(" CV"), number, F.lit("xx")), None).alias(
                "postcode_text"
            ),
            cycle("Not assigned", F.concat(F.lpad(number, 6, "4"), F.lpad(number, 6, "2")), None, "#", "#/#").alias("xy"),
            (key % 3).cast("double").alias("x"),
            F.concat(F.lit("CG"), (key % 9).cast("string")).alias("given_group"),
            cycle("Rehab", "Infra", "LD", "Works", None, "other").alias("work_type"),
        )

    def exceptions(self) -> DataFrame:
        rows = [("0", None), ("Several", "Multiple"), ("n/a", None)]
        return small_table(self.spark, rows, ["raw", "zone"], ["string", "string"])

    def work_types(self) -> DataFrame:
        rows = [("Rehab", "Infra"), ("Works", "Non-Infra"), ("LD", "Leak Detection")]
        return small_table(self.spark, rows, ["raw", "value"], ["string", "string"])


def day_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
