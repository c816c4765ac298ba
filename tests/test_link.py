"""Linking against a plain double loop, on hand-made boundaries, random data and hot zones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlink.operators import classify, clusters, joins, link, zones
from eventlink.operators.link import Rule, Side
from eventlink.plans import catalogue

BASE = datetime(2016, 3, 27)
EDGES = [("00001", "00002"), ("00002", "00001"), ("00002", "00003"), ("00004", "00004"), ("00001", "00002")]


def side(spark, word, rows):
    frame = spark.createDataFrame(rows, "id long, ts timestamp_ntz, zone string, type string")
    return Side(frame, word)


def edge_table(spark, rows=EDGES):
    return spark.createDataFrame(rows, "zone string, neighbour string")


def linked(a, c, hours=24.0, edges=EDGES, any_zone=False):
    """Whether effect ``c`` may follow cause ``a``."""
    if a[1] is None or c[1] is None:
        return False
    if not any_zone:
        if a[2] is None or c[2] is None or not (a[2] == c[2] or (a[2], c[2]) in set(edges)):
            return False
    if hours is None:
        return (c[1].date() - a[1].date()).days in (0, 1)
    return timedelta(0) <= c[1] - a[1] <= timedelta(hours=hours)


def brute(causes, effects, **rule):
    return sorted((a[0], c[0]) for a in causes for c in effects if linked(a, c, **rule))


def counts(pairs, rows, place):
    return {r[0]: sum(1 for p in pairs if p[place] == r[0]) for r in rows}


def check_all(spark, causes, effects, **rule):
    a, c = side(spark, "cause", causes), side(spark, "effect", effects)
    plain = {"hours": rule.get("hours", 24.0), "any_zone": rule.get("any_zone", False), "edges": rule.get("edges", EDGES)}
    wanted = brute(causes, effects, **plain)
    edges = edge_table(spark, plain["edges"]) if plain["edges"] else None
    used = Rule(edges=edges, hours=plain["hours"], any_zone=plain["any_zone"])

    found = link.pairs(a, c, used).select("id_cause", "id_effect").collect()
    assert sorted(tuple(r) for r in found) == wanted

    forward = link.with_effects(a, c, rule=used).frame.collect()
    assert {r["id"]: r["number_of_effect"] for r in forward} == counts(wanted, causes, 0)
    assert all(r["at_least_one_effect"] == (r["number_of_effect"] > 0) for r in forward)
    backward = link.with_causes(c, a, rule=used).frame.collect()
    assert {r["id"]: r["number_of_cause"] for r in backward} == counts(wanted, effects, 1)

    outer = link.outer(a, c, used).collect()
    lone_causes = sum(1 for n in counts(wanted, causes, 0).values() if n == 0)
    lone_effects = sum(1 for n in counts(wanted, effects, 1).values() if n == 0)
    assert len(outer) == len(wanted) + lone_causes + lone_effects
    both = sorted((r["id_cause"], r["id_effect"]) for r in outer if r["id_cause"] is not None and r["id_effect"] is not None)
    assert both == wanted
    return wanted


def test_boundaries(spark):
    causes = [
        (1, BASE, "00001", "x"),
        (2, BASE, "00002", "x"),
        (3, BASE, None, "x"),
        (4, None, "00001", "x"),
        (5, BASE + timedelta(hours=23), "00004", "y"),
        (6, BASE, "00009", "y"),
    ]
    effects = [
        (10, BASE, "00001", "c"),
        (11, BASE + timedelta(hours=24), "00001", "c"),
        (12, BASE + timedelta(hours=24, microseconds=1), "00001", "c"),
        (13, BASE - timedelta(seconds=1), "00001", "c"),
        (14, BASE + timedelta(hours=25), "00004", "c"),
        (15, BASE + timedelta(hours=2), "00003", "c"),
        (16, BASE + timedelta(hours=2), None, "c"),
        (17, None, "00001", "c"),
        (18, BASE + timedelta(hours=2), "00099", "c"),
    ]
    wanted = check_all(spark, causes, effects)
    assert (1, 10) in wanted and (1, 11) in wanted and (1, 12) not in wanted and (1, 13) not in wanted
    assert (2, 15) in wanted and (1, 15) not in wanted and (5, 14) in wanted


def test_pair_labels(spark):
    causes = [(1, BASE + timedelta(hours=23), "00001", "x")]
    effects = [
        (10, BASE + timedelta(hours=23, minutes=30), "00001", "c"),
        (11, BASE + timedelta(hours=25), "00002", "c"),
        (12, BASE + timedelta(hours=60), "00001", "c"),
    ]
    found = link.pairs(side(spark, "cause", causes), side(spark, "effect", effects), Rule(edge_table(spark), 48)).collect()
    labels = {r["id_effect"]: (r["same_zone"], r["neighbour_zone"], r["day_label"]) for r in found}
    assert labels == {
        10: (True, False, "SameDay"),
        11: (False, True, "NextDay"),
        12: (True, False, "Later"),
    }


def random_rows(seed, n, first, hot=0.0, grain=1_000_000):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        zone = "00002" if draw.random() < hot else draw.choice(["00001", "00002", "00003", "00004", "00009", None])
        at = BASE + timedelta(microseconds=draw.randrange(0, 5 * 86400 * 1_000_000, grain))
        rows.append((first + i, None if draw.random() < 0.03 else at, zone, draw.choice("xyz")))
    return rows


@pytest.mark.parametrize(
    "rule",
    [
        {"hours": 24.0},
        {"hours": 72.0},
        {"hours": 0.5},
        {"hours": 0.0},
        {"hours": None},
        {"hours": 24.0, "edges": None},
        {"hours": None, "any_zone": True},
    ],
)
def test_random_against_loop(spark, rule):
    rule = {**rule, "edges": rule.get("edges", EDGES) or []}
    # A coarse grain makes ties and exact window ends common.
    causes = random_rows(1, 120, 0, grain=1800 * 1_000_000)
    effects = random_rows(2, 120, 1000, grain=1800 * 1_000_000)
    check_all(spark, causes, effects, **rule)


def test_hot_zone(spark):
    causes = random_rows(3, 150, 0, hot=0.6)
    effects = random_rows(4, 150, 1000, hot=0.6)
    check_all(spark, causes, effects)


def test_one_instant_holds_all(spark):
    causes = [(i, BASE, "00001", "x") for i in range(40)]
    effects = [(1000 + i, BASE + timedelta(hours=24), "00002", "c") for i in range(40)]
    assert len(check_all(spark, causes, effects)) == 1600


def test_many_rows_in_one_zone_and_minute(spark):
    """Counts stay exact, and cheap, where listing the pairs would take 2.5e9 rows."""
    n = 50_000
    rows = spark.range(n).select(
        "id", (F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 1000)).alias("ts")
    )
    rows = rows.withColumn("zone", F.lit("00001"))
    found = link.with_effects(Side(rows, "cause"), Side(rows, "effect"), rule=Rule(hours=24)).frame
    total = found.agg(F.sum("number_of_effect"), F.min("number_of_effect"), F.max("number_of_effect")).first()
    assert tuple(total) == (n * (n + 1) // 2, 1, n)


def test_cause_types_and_flags(spark):
    causes, effects = random_rows(5, 100, 0), random_rows(6, 100, 1000)
    a, c = side(spark, "cause", causes), side(spark, "effect", effects)
    rule = Rule(edge_table(spark), 24)
    names = {"n_x": "x", "n_y": "y"}
    found = {r["id"]: r for r in link.with_cause_types(c, a, rule, "type", names).frame.collect()}
    for name, kind in names.items():
        wanted = counts(brute([r for r in causes if r[3] == kind], effects), effects, 1)
        assert {i: r[name] for i, r in found.items()} == wanted

    from_x = {e for _, e in brute([r for r in causes if r[3] == "x"], effects)}
    xs = a.where(F.col("type") == "x")
    flagged = link.flagged(c, rule, from_x=xs, from_any=a).frame.collect()
    assert {r["id"] for r in flagged if r["from_x"]} == from_x
    assert {r["id"] for r in flagged if r["from_any"]} == {e for _, e in brute(causes, effects)}
    assert flagged[0].asDict().keys() == {"id", "ts", "zone", "type", "from_x", "from_any"}
    assert {r["id"] for r in classify.coming_from(c, xs, rule).frame.collect()} == from_x
    rest = {r["id"] for r in classify.not_coming_from(c, xs, rule).frame.collect()}
    assert rest == {r[0] for r in effects} - from_x


def test_chain(spark):
    a_rows, b_rows, c_rows = random_rows(7, 60, 0), random_rows(8, 60, 1000), random_rows(9, 60, 2000)
    a, b, c = side(spark, "cause", a_rows), side(spark, "anomaly", b_rows), side(spark, "complaint", c_rows)
    found = link.chain(a, b, c, Rule(edge_table(spark), 24)).frame.collect()
    assert {r["id"]: r["number_of_anomaly"] for r in found} == counts(brute(a_rows, b_rows), a_rows, 0)
    assert {r["id"]: r["number_of_complaint"] for r in found} == counts(brute(a_rows, c_rows), a_rows, 0)


@pytest.fixture()
def tiny_partitions(spark):
    """Adaptive execution at the scale of a test: any partition over 2 KB is large, nothing is broadcast."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    kept = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in kept.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def crowded(spark, n=60_000):
    """Nearly all rows at one place and instant."""
    rows = spark.range(0, n, 1, 8).select("id", F.when(F.col("id") % 40 == 0, F.col("id") % 7).otherwise(0).alias("h"))
    ts = F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h").cast("int"))
    zone = F.lpad(F.col("h").cast("string"), 5, "0")
    return rows.select("id", ts.alias("ts"), zone.alias("zone"), F.to_date(F.lit(BASE)).alias("date"))


def final_plan(frame):
    """Run the frame and return the plan it ended with."""
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_crowded_instant_is_split_when_counts_come_back(spark, tiny_partitions):
    rows = crowded(spark)
    few = rows.filter("id < 10")
    found = link.with_effects(Side(rows, "cause"), Side(few, "effect"), rule=Rule(hours=24)).frame
    result, plan = final_plan(found.agg(F.count("id"), F.sum(F.hash("id")), F.sum("number_of_effect")))
    assert result[0][0] == 60_000
    assert "skew=true" in plan


def test_crowded_day_is_split_when_clusters_come_back(spark, tiny_partitions):
    found = clusters.with_clusters(crowded(spark))
    result, plan = final_plan(found.agg(F.sum(F.hash("id")), F.max("consecutive_cluster_size")))
    assert result[0][1] > 58_000
    assert "skew=true" in plan


def test_crowded_key_is_split_in_a_lookup(spark, tiny_partitions):
    rows = crowded(spark)
    mapping = rows.select(F.col("zone").alias("k"), F.upper("zone").alias("value"))
    result, plan = final_plan(zones.lookup(rows, F.col("zone"), mapping, "k", "value", "v").agg(F.sum(F.hash("id", "v"))))
    assert "skew=true" in plan
    flags = joins.flag_in_set(rows, "zone", rows, "zone", "known")
    result, plan = final_plan(flags.agg(F.sum(F.hash("id", "known"))))
    assert "skew=true" in plan


@pytest.mark.parametrize("crowd", ["causes", "effects"])
def test_crowded_slot_of_pairs_is_split(spark, tiny_partitions, crowd):
    rows, few = crowded(spark), crowded(spark, 200)
    sides = (rows, few) if crowd == "causes" else (few, rows)
    found = link.pairs(Side(sides[0], "cause"), Side(sides[1], "effect"), Rule(hours=24))
    result, plan = final_plan(found.agg(F.count("*"), F.sum(F.hash("id_cause", "id_effect"))))
    assert result[0][0] > 58_000 * 195
    assert "skew=true" in plan


def test_neighbours_come_from_the_edges(spark):
    causes = [(1, BASE, "00001", "x"), (2, BASE, "00004", "x"), (3, BASE, None, "x")]
    effects = [(10, BASE, "00002", "c"), (11, BASE, "00004", "c"), (12, BASE, None, "c")]
    rule = Rule(edge_table(spark), None, any_zone=True)
    found = link.pairs(side(spark, "cause", causes), side(spark, "effect", effects), rule).collect()
    flags = {(r["id_cause"], r["id_effect"]): (r["same_zone"], r["neighbour_zone"]) for r in found}
    assert len(found) == 9
    assert flags[1, 10] == (False, True) and flags[1, 11] == (False, False) and flags[2, 11] == (True, True)
    assert all(flags[k] == (None, None) for k in flags if k[0] == 3 or k[1] == 12)


def test_pairs_are_labelled_on_the_sides(spark):
    """No join follows the one that makes the pairs, and no pair is compared by its zones' names."""
    causes = [(1, BASE, "00001", "x"), (2, BASE, "00004", "x"), (3, None, "00001", "x"), (4, BASE, None, "x")]
    effects = [(7, BASE, "00002", "y"), (8, BASE + timedelta(days=1), "00001", "y"), (9, BASE, "00004", "y")]
    found = link.pairs(side(spark, "cause", causes), side(spark, "effect", effects), Rule(edges=edge_table(spark)))
    joins_ = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "_slot" in joins_[0]
    told = found.select("id_cause", "id_effect", "same_zone", "neighbour_zone", "day_label").collect()
    assert sorted(map(tuple, told)) == [
        (1, 7, False, True, "SameDay"),
        (1, 8, True, False, "NextDay"),
        (2, 9, True, True, "SameDay"),
    ]


def scattered(spark, n, first):
    """Rows of one zone at scattered instants of two days, in no order of time."""
    at = F.pmod(F.xxhash64("id"), F.lit(172_800)).cast("int")
    rows = spark.range(first, first + n).select("id", (F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(secs=at)).alias("ts"))
    return rows.withColumn("zone", F.lit("00001"))


def test_pairs_are_read_off_arrays(spark):
    """What is joined are causes and pieces of the effects; pairs appear where a piece is taken apart."""
    causes, effects = Side(scattered(spark, 300, 0), "cause"), Side(scattered(spark, 3 * link.PIECE + 5, 10_000), "effect")
    found = link.pairs(causes, effects, Rule(hours=24))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    taken, joined = (next(i for i, line in enumerate(lines) if word in line) for word in ("explode(_rows", "Join"))
    assert taken < joined
    told = found.agg(F.count("*"), F.countDistinct("id_cause", "id_effect")).first()
    wanted = link.with_effects(causes, effects, rule=Rule(hours=24)).frame.agg(F.sum("number_of_effect")).first()[0]
    assert tuple(told) == (wanted, wanted) and wanted > 100 * link.PIECE


@pytest.mark.parametrize("hours", [24.0, None])
def test_pieces_meet_like_rows(spark, hours):
    """Many rows at one instant, repeated and unknown ids, rows without time or zone."""
    n = 2 * link.PIECE + 3
    effects = [(i // 2 if i % 5 else None, BASE + timedelta(hours=24 * (i % 3)), "00002", "c") for i in range(n)]
    effects += [(1, None, "00002", "c"), (2, BASE, None, "c"), (None, BASE, "00003", None)]
    causes = [(1, BASE, "00002", "x"), (1, BASE, "00002", "x"), (None, BASE + timedelta(hours=24), "00001", "y"), (2, BASE, None, "x")]
    a, c = (Side(spark.createDataFrame(r, "id long, ts timestamp_ntz, zone string, type string"), w, known_unique=True) for w, r in (("cause", causes), ("effect", effects)))
    rule = Rule(edge_table(spark), hours)
    wanted = [(x[0], y[0], x[2], y[2]) for x in causes for y in effects if linked(x, y, hours)]
    found = link.pairs(a, c, rule).select("id_cause", "id_effect", "zone_cause", "zone_effect").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    outer = link.outer(a, c, rule)
    assert outer.columns[:4] == ["id_cause", "ts_cause", "zone_cause", "type_cause"]
    both = outer.filter("number_of_effect_cause > 0 AND number_of_cause_effect > 0").select("id_cause", "id_effect", "zone_cause", "zone_effect").collect()
    assert sorted(map(str, map(tuple, both))) == sorted(map(str, wanted))


def test_written_listing_is_small(spark, tmp_path):
    """The effects of a cause lie in order of time, so the lists of two causes repeat each other and pack well."""
    causes, effects = scattered(spark, 600, 0), scattered(spark, 3_000, 10_000)
    found = link.outer(Side(causes, "cause"), Side(effects, "effect"), Rule(hours=24)).select("id_cause", "id_effect")
    found.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows > 600_000
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size / rows < 0.65, size / rows


def test_outer_takes_counts_as_given(spark):
    causes, effects = random_rows(12, 50, 0), random_rows(13, 50, 1000)
    a, c = side(spark, "cause", causes), side(spark, "effect", effects)
    rule = Rule(edge_table(spark), 24)
    counted = link.outer(link.with_effects(a, c, rule=rule), link.with_causes(c, a, rule=rule), rule)
    plain = link.outer(a, c, rule)
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.select(counted.columns).collect()))


def test_repeated_ids_are_told(spark):
    rows = [(1, "2016-01-01 00:00:00", "a"), (7, "2016-01-01 01:00:00", "a"), (7, "2016-01-01 02:00:00", "a")]
    frame = spark.createDataFrame(rows, "id int, t string, zone string").selectExpr("id", "cast(t as timestamp_ntz) ts", "zone")
    once, twice, rule = Side(frame.where("id = 1"), "cause"), Side(frame, "effect"), Rule(hours=24)
    for found in (link.with_effects(once, twice, rule=rule).frame, link.with_causes(twice, once, rule=rule).frame, link.pairs(once, twice, rule)):
        with pytest.raises(Exception, match="effect: the id occurs more than once: 7"):
            found.collect()
    with pytest.raises(ValueError, match="effect: the id occurs more than once: 7"):
        link.require_unique_ids(once, twice)
    known = Side(frame, "effect", known_unique=True)
    assert link.pairs(once, known, rule).count() == 3
    assert link.with_effects(once, known, rule=rule).frame.first()["number_of_effect"] == 3


def test_outer_counts_each_side_once(spark):
    found = catalogue.queries()["link_outer"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 25
