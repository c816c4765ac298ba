import pytest
from conftest import one
from pyspark.sql import functions as F

from eventlink.functions import codes, labels

ZONES = [("4722", "04722"), ("04722", "04722"), ("101050", "101050"), ("434002071", "434002071"), ("Hill", "0Hill")]


@pytest.mark.parametrize(("given", "wanted"), [*ZONES, (None, None)])
def test_zero_fill_never_cuts(spark, given, wanted):
    assert one(spark, codes.zero_fill(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [(4722, "04722"), (4722.0, "04722"), (101050, "101050")])
def test_zone_code_from_number(spark, given, wanted):
    assert one(spark, codes.zone_code_from_number(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"), [("07/320", "07320"), ("6*519", "06519"), ("8/ 605", "08605"), ("6/519", "06519")]
)
def test_zone_free_text(spark, given, wanted):
    assert one(spark, codes.zone_free_text(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("district", "number", "wanted"),
    [("8", "65", "08065"), ("08", "605", "08605"), ("x", "605", None), ("8", None, None), ("12", "7", "12007")],
)
def test_zone_from_district(spark, district, number, wanted):
    given = codes.zone_from_district(F.lit(district), F.lit(number).cast("string"))
    assert one(spark, given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("123", "123"),
        ("00123", "123"),
        ("12 34", "12"),
        ("A&77", "77"),
        ("A-77", "77"),
        ("55/01", "55"),
        ("x-y", "x-y"),
        ("7.9", "7.9"),
        ("-5", "-5"),
        (" 12 ", "12"),
        ("A--77", "A--77"),
        ("", ""),
        (None, None),
    ],
)
def test_lenient_order(spark, given, wanted):
    assert one(spark, codes.lenient_order(F.lit(given).cast("string"))) == wanted


def test_lenient_order_of_a_number(spark):
    assert one(spark, codes.lenient_order_from_number(F.lit(7.9))) == "7"


@pytest.mark.parametrize(
    ("given", "order", "operation"), [("70012/0020", "70012", "0020"), ("70012-10", "70012", "10"), ("x", "x", None)]
)
def test_split_order_op(spark, given, order, operation):
    assert one(spark, codes.order_part(F.lit(given))) == order
    assert one(spark, codes.operation_part(F.lit(given))) == operation


def test_order_op_keys(spark):
    assert one(spark, codes.order_op(F.lit(70012))) == "70012/00"
    assert one(spark, codes.order_op(F.lit(70012), F.lit("0020"))) == "70012/0020"
    assert one(spark, codes.order_op_integers(F.lit("0070"), F.lit("0020"))) == "70/20"
    assert one(spark, codes.order_op_integers(F.lit("0070"), F.lit("b"))) is None


@pytest.mark.parametrize(
    ("given", "x", "y"), [("412345298765", "412345", "298765"), ("Not assigned", None, None), (None, None, None)]
)
def test_grid(spark, given, x, y):
    assert one(spark, codes.grid_x(F.lit(given).cast("string"))) == x
    assert one(spark, codes.grid_y(F.lit(given).cast("string"))) == y


def test_small_helpers(spark):
    assert one(spark, codes.postcode(F.lit("cv1 2 tt"))) == "CV12TT"
    assert one(spark, codes.as_number(F.lit("1,234,567"))) == 1234567
    assert one(spark, codes.as_number(F.lit("none"))) is None
    assert one(spark, codes.null_if_listed(F.lit("#/#"))) is None
    assert one(spark, codes.null_if_listed(F.lit("x"))) == "x"
    assert one(spark, codes.null_if(F.lit("0"), "0")) is None
    assert one(spark, codes.list_codes(F.lit("4722, 4723,,101050"))) == ["04722", "04723", "101050"]
    assert one(spark, codes.crop(F.lit("04722 High St"))) == "04722"
    assert one(spark, codes.digit_prefix(F.lit("0472x"))) is None
    assert one(spark, codes.digit_prefix(F.lit("047"))) == "047"


def test_demographic_types(spark):
    rows = {r["acorn59"]: (r["acorn17"], r["acorn5"]) for r in labels.demographic_types(spark).collect()}
    assert len(rows) == 62
    assert rows[1] == ("A", "C1")
    assert rows[34] == ("K", "C4")
    assert rows[59] == ("Q", "C5")
    assert rows[62] == ("Business", "Business")


def test_labels(spark):
    assert one(spark, labels.group_label(F.lit("A"))) == "A: Lavish Lifestyles"
    assert one(spark, labels.group_label(F.lit("Business"))) is None
    assert one(spark, labels.category_label(F.lit("C3"))) == "Category 3: Comfortable Communities"
    assert one(spark, labels.weekday_cluster(F.lit(True), F.lit(4))) == "Weekday, clustered"
    assert one(spark, labels.weekday_cluster(F.lit(False), F.lit(None).cast("int"))) == "Weekend, non-clustered"
    assert one(spark, labels.mentions_training(F.lit("Duty TRAINING day")))
    assert one(spark, labels.mentions_training(F.lit("network CONTROL test incident 4")))
    assert not one(spark, labels.mentions_training(F.lit("Burst")))
    assert one(spark, ~labels.is_listed(F.lit(None).cast("string"), ("a",)))
