import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlink.operators import joins, report, stats, zones
from eventlink.operators.medians import exact_medians


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.one_of(st.none(), st.floats(-1e6, 1e6), st.integers(-3, 3).map(float)),
            st.floats(0, 1e-3),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_medians(spark, rows):
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    found = {r["k"]: (r["x"], r["y"]) for r in exact_medians(frame, ["k"], ["x", "y"]).collect()}
    for key in {r[0] for r in rows}:
        xs = [r[1] for r in rows if r[0] == key and r[1] is not None]
        assert found[key][0] == (pytest.approx(np.median(xs)) if xs else None)
        assert found[key][1] == pytest.approx(np.median([r[2] for r in rows if r[0] == key]))


def test_median_of_one_large_group(spark):
    frame = spark.range(100_000).select(F.lit("k").alias("k"), (F.col("id") % 70_001).cast("double").alias("x"))
    wanted = float(np.median(np.arange(100_000) % 70_001))
    assert exact_medians(frame, ["k"], ["x"]).first()["x"] == wanted


@pytest.mark.parametrize("few", [1, 3, 40])
def test_medians_by_passes(spark, few):
    """Values of all sizes and signs; so few are ranked together that all four passes are made."""
    draw = np.random.default_rng(few)
    rows = [(g, float(draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.integers(-300, 300))) for g in "abc" for _ in range(draw.integers(1, 90))]
    rows += [("z", 0.0), ("z", -0.0), ("z", float("nan")), ("z", 7.0), ("y", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: r["x"] for r in exact_medians(frame, ["k"], ["x"], few).collect()}
    for key in "abc":
        assert found[key] == pytest.approx(np.median([x for k, x in rows if k == key]), rel=1e-12)
    assert found["z"] == 0.0 and set(found) - {"y"} == set("abcz")


def test_median_of_close_values_takes_bounded_tasks(spark):
    """A group between 400,000 and 450,000: what is ranked together after the passes is few, whatever the group's size."""
    frame = spark.range(200_000).select(F.lit("k").alias("k"), (400_000 + F.pmod(F.xxhash64("id"), F.lit(10**9)) / 20_000).alias("x"))
    values = np.array([r["x"] for r in frame.select("x").collect()])
    assert exact_medians(frame, ["k"], ["x"], 1000).first()["x"] == pytest.approx(float(np.median(values)), rel=1e-14)


def test_columns_are_the_values_there_are(spark):
    rows = [("a", 1994, 1.0), ("b", 2003, 2.0), ("a", 2003, 3.0), ("c", None, 4.0)]
    frame = spark.createDataFrame(rows, "type string, year int, pct double")
    years = report.values_of(frame, "year")
    assert years == [1994, 2003]
    wide = {tuple(r) for r in report.widen(frame, ["type"], "year", {y: f"y{y}" for y in years}, "pct").collect()}
    assert wide == {("a", 1.0, 3.0), ("b", None, 2.0), ("c", None, None)}
    with pytest.raises(ValueError, match="more than 1 values"):
        report.values_of(frame, "year", 1)


def test_histogram_exchanges_counts_only(spark):
    frame = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    found = report.histogram(frame, "v", 5, by="g")
    assert found.count() == 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    # The bin of the counts is an expression there; no exchange is by group alone, as one of rows would be.
    assert dealt and all("bin#" in line or "_groupingexpression" in line for line in dealt)


def test_followed_needs_both_sides(spark):
    rows = [("both", True), ("both", False), ("both", False), ("yes", True), ("no", False), (None, True)]
    frame = spark.createDataFrame(rows, "type string, hit boolean")
    found = {r["type"]: (r["n_true"], r["n_false"], r["pct"]) for r in report.followed(frame, "hit", "type").collect()}
    assert found == {"both": (1, 2, pytest.approx(100 / 3)), "yes": (1, None, None), "no": (None, 1, None)}


def test_in_order(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("c",)], "type string")
    assert [r["type"] for r in report.in_order(frame, "type", ("c", "a", "x")).collect()] == ["c", "a"]


@pytest.mark.parametrize("bins", [1, 7, 24])
def test_histogram_as_numpy(spark, bins):
    draw = np.random.default_rng(3)
    data = {"a": draw.normal(5, 2, 300).round(2), "b": np.array([4.0, 4.0]), "c": np.array([0.0, 24.0, 24.0, 12.0])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("a", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    found = report.histogram(frame, "v", bins, by="k").collect()
    for key, values in data.items():
        counts, edges = np.histogram(values, bins=bins)
        mine = sorted((r for r in found if r["group"] == key), key=lambda r: r["bin"])
        assert [r["n"] for r in mine] == list(counts)
        assert [r["lower"] for r in mine] == pytest.approx(list(edges[:-1]))
    fixed = report.histogram(frame, "v", bins, lo=0, hi=24).orderBy("bin").collect()
    known = [v for _, v in rows if v is not None and 0 <= v <= 24 and _ is not None] + [1.0]
    assert [r["n"] for r in fixed] == list(np.histogram(known, bins=bins, range=(0, 24))[0])


def test_density_is_the_kernel_sum(spark):
    draw = np.random.default_rng(5)
    values = draw.normal(100, 4, 400)
    frame = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double")
    found = sorted((r["x"], r["density"]) for r in report.density(frame, "v", "k", {"g": 2.0}, 500).collect())
    x = np.array([p[0] for p in found])
    exact = np.exp(-0.5 * ((x[:, None] - values) / 2) ** 2).sum(1) / (400 * 2 * math.sqrt(2 * math.pi))
    assert len(x) == 500
    assert np.allclose([p[1] for p in found], exact, atol=2e-6)
    assert np.trapezoid([p[1] for p in found], x) == pytest.approx(1, abs=0.01)


def test_totals_for_several_groupings(spark):
    frame = spark.createDataFrame([(2014, "C", 1), (2014, "D", 0), (2015, "C", 1), (2015, None, 1)], "y int, r string, f int")
    found = {(r["grouping"], r["y"], r["r"]): r["f"] for r in report.totals(frame, ["f"], [["y", "r"], ["r"], ["y"]]).collect()}
    assert found[("r", None, "C")] == 2
    assert found[("y", 2015, None)] == 1
    assert found[("y+r", 2014, "D")] == 0


def test_rates_keep_groups(spark):
    homes = spark.createDataFrame([("a", 100), ("a", 100), ("b", 50), (None, 9)], "k string, households long")
    seen = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    left = {r["k"]: tuple(r)[1:] for r in report.rate_per(homes, seen, "k", 100).collect()}
    assert left == {"a": (200, 1, 0.5), "b": (50, None, None)}
    right = {r["k"]: tuple(r)[1:] for r in report.rate_per(homes, seen, "k", 100, keep="right").collect()}
    assert right == {"a": (200, 1, 0.5), "c": (None, 1, None)}


def test_poisson_matches_group_means(spark):
    rows = [("b", 2), ("b", 4), ("a", 1), ("a", 0), ("a", 2), ("c", 9), (None, 5)]
    frame = spark.createDataFrame(rows, "type string, n long")
    found = {r["term"]: r["coefficient"] for r in stats.poisson(frame, "n", ["type"]).collect()}
    assert found == {
        "Intercept": pytest.approx(0.0, abs=1e-9),
        "type_b": pytest.approx(math.log(3), abs=1e-9),
        "type_c": pytest.approx(math.log(9), abs=1e-9),
    }


def test_poisson_of_two_factors(spark):
    """Additive on the log scale, so an exact product table is fitted exactly."""
    rows = [(a, b, i * j) for a, i in (("x", 1), ("y", 3)) for b, j in (("p", 2), ("q", 8)) for _ in range(3)]
    frame = spark.createDataFrame(rows, "t string, r string, n long")
    found = {r["term"]: r["coefficient"] for r in stats.poisson(frame, "n", ["t", "r"]).collect()}
    assert found["t_y"] == pytest.approx(math.log(3), abs=1e-8)
    assert found["r_q"] == pytest.approx(math.log(4), abs=1e-8)


def test_poisson_of_two_factors_as_the_library_fit(spark):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    draw = np.random.default_rng(7)
    rows = [(f"t{draw.integers(4)}", f"r{draw.integers(6) ** 2 % 6}") for _ in range(3000)]
    rows = [(t, r, int(draw.poisson(0.4 + 0.3 * int(t[1]) * (1 + int(r[1]))))) for t, r in rows]
    frame = spark.createDataFrame([*rows, (None, "r1", 3)], "t string, r string, n long")
    found = {r["term"]: r["coefficient"] for r in stats.poisson(frame, "n", ["t", "r"]).collect()}
    known = frame.dropna()
    coded = RFormula(formula="n ~ t + r", stringIndexerOrderType="alphabetDesc").fit(known).transform(known)
    fit = GeneralizedLinearRegression(family="poisson", link="log", maxIter=100, tol=1e-12).fit(coded)
    attributes = coded.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])]
    wanted = {"Intercept": fit.intercept, **dict(zip(names, fit.coefficients, strict=True))}
    assert set(found) == set(wanted)
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-8) for k in wanted)
    assert stats.poisson(frame.limit(0), "n", ["t", "r"]).collect()[0]["converged"] is False


def test_poisson_of_ten_thousand_levels(spark):
    """Means that are a product of both factors' are fitted exactly."""
    rows = spark.range(30_000).select((F.col("id") % 10_000).alias("a"), (F.col("id") / 10_000).cast("int").alias("b"))
    rows = rows.withColumn("n", (F.col("a") % 5 + 1) * (F.col("b") + 2))
    found = {r["term"]: r["coefficient"] for r in stats.poisson(rows, "n", ["b", "a"]).collect()}
    assert len(found) == 10_002
    assert found["b_2"] == pytest.approx(math.log(2), abs=1e-8) and found["a_4"] == pytest.approx(math.log(5), abs=1e-8)
    assert found["a_9999"] == pytest.approx(math.log(5), abs=1e-8)


def test_numbering_and_random_events(spark):
    frame = spark.range(500).select("id", F.col("id").cast("string").alias("ts"), (F.col("id") % 7).alias("zone"))
    numbers = stats.numbered(frame, "id", "ts").collect()
    assert sorted(r["number"] for r in numbers) == list(range(500))
    again = stats.numbered(frame.repartition(13), "id", "ts").collect()
    assert {(r["number"], r["ts"]) for r in again} == {(r["number"], r["ts"]) for r in numbers}
    draws = spark.range(1000).select("id")
    drawn = stats.random_events(frame, "id", "ts", "zone", draws, "id").collect()
    assert sorted(r["id"] for r in drawn) == list(range(1000))
    assert len({r["ts"] for r in drawn}) > 300
    share = sum(int(r["ts"]) % 7 == r["zone"] for r in drawn) / 1000
    assert 0.08 < share < 0.21


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "l1"), (2, "b", "l2"), (3, None, "l3")], "id int, k string, v string")
    right = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("z", "r3"), (None, "r4")], "k string, v string")
    found = sorted((tuple(r) for r in joins.match_left(left, right, "k", "m").collect()), key=str)
    assert found == [
        (1, "a", "l1", "r1", "both"),
        (1, "a", "l1", "r2", "both"),
        (2, "b", "l2", None, "left_only"),
        (3, None, "l3", None, "left_only"),
    ]
    merged = joins.reconcile(left, right, "k", "m").groupBy("m").count().collect()
    assert {r["m"]: r["count"] for r in merged} == {"both": 2, "left_only": 2, "right_only": 2}
    assert {r["id"] for r in joins.in_set(left, "k", right, "k").collect()} == {1}
    assert {r["id"] for r in joins.not_in_set(left, "k", right, "k").collect()} == {2, 3}
    flags = {r["id"]: r["f"] for r in joins.flag_in_set(left, "k", right, "k", "f").collect()}
    assert flags == {1: True, 2: False, 3: False}
    assert {r["k"] for r in joins.unmatched_values(left, "k", right, "k").collect()} == {"b"}
    assert joins.distinct_pairs(left, "k", "v").count() == 2


def test_keep_first(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 9, None), (None, 1, "q"), (None, 0, "p")]
    frame = spark.createDataFrame(rows, "k string, o int, v string")
    found = {(r["k"], r["o"], r["v"]) for r in joins.keep_first(frame, ["k"], ["o"]).collect()}
    assert found == {("a", 1, "y"), ("b", 9, None), (None, 0, "p")}


def test_zone_lookups(spark):
    dim = spark.createDataFrame(
        [("00001", "One", "W", "G", "R"), ("00002", "Two", "W", "H", "S")],
        "zone string, zone_name string, wqz string, control_group string, region string",
    )
    rows = spark.createDataFrame([("00001", None), ("00002", "own"), ("x", None)], "zone string, control_group string")
    rich = {r["zone"]: (r["control_group"], r["region"]) for r in zones.enrich(rows, dim).collect()}
    assert rich == {"00001": ("G", "R"), "00002": ("own", "S"), "x": (None, None)}
    mapping = spark.createDataFrame([("k", "first", 1), ("k", "last", 2), (None, "n", 3)], "key string, value string, o int")
    assert zones.lookup(mapping.select("key").distinct(), F.col("key"), mapping, "key", "value", "v", "o").filter(
        "key = 'k'"
    ).first()["v"] == "last"
    texts = spark.createDataFrame([("0",), ("Several",), ("07/320",), (None,)], "t string")
    exceptions = spark.createDataFrame([("0", None), ("Several", "Multiple")], "raw string, zone string")
    fixed = {r["t"]: r["zone"] for r in zones.zone_from_text(texts, "t", exceptions).collect()}
    assert fixed == {"0": None, "Several": "Multiple", "07/320": "07320", None: None}
    places = spark.createDataFrame([("00001 Main St",), ("Two",), ("Nowhere",)], "t string")
    found = {r["t"]: r["zone"] for r in zones.zone_from_location(places, "t", dim.select("zone_name", "zone")).collect()}
    assert found == {"00001 Main St": "00001", "Two": "00002", "Nowhere": None}
    changed = zones.canonicalise(texts, "t", exceptions, "raw", "zone").collect()
    assert {r["t"] for r in changed} == {None, "Multiple", "07/320"}


def test_histogram_limits_apply_one_by_one_and_groups_stay(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 50.0), ("a", float("nan"))], "g string, v double")
    low = {(r["group"], r["bin"]): r["n"] for r in report.histogram(frame, "v", 5, by="g", lo=0).collect()}
    assert low["a", 1] == 1 and low["a", 4] == 1 and low["b", 4] == 1
    both = report.histogram(frame, "v", 2, by="g", lo=0, hi=10).collect()
    assert {(r["group"], r["bin"]): r["n"] for r in both} == {("a", 0): 1, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0}
