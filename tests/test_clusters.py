import random
from collections import Counter
from datetime import date, timedelta

import pytest

from eventlink.operators import clusters

D = date(2016, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, zone string, date date")


def run_sizes(rows, calendar):
    """Sizes by walking each zone's days."""
    counted = Counter((z, d) for _, z, d in rows if z is not None and d is not None)
    observed = sorted({d for _, d in counted})
    days = [observed[0] + timedelta(i) for i in range((observed[-1] - observed[0]).days + 1)] if calendar else observed
    sizes = {}
    for zone in {z for z, _ in counted}:
        run = []
        for d in [*days, None]:
            if d is not None and (zone, d) in counted:
                run.append(d)
                continue
            total = sum(counted[zone, r] for r in run)
            sizes.update({(zone, r): (total, run[0]) for r in run})
            run = []
    return {
        i: (counted[z, d], *sizes[z, d]) if z is not None and d is not None else (1, 1, None) for i, z, d in rows
    }


@pytest.mark.parametrize("calendar", [False, True])
def test_against_walk(spark, calendar):
    draw = random.Random(11)
    rows = []
    for i in range(300):
        zone = draw.choice(["a", "a", "a", "b", "c", None])
        day = draw.choice([d for d in range(40) if d % 7 != 3] + [None])
        rows.append((i, zone, None if day is None else D + timedelta(day)))
    wanted = run_sizes(rows, calendar)
    found = clusters.with_clusters(rows_of(spark, rows), calendar=calendar).collect()
    assert len(found) == len(rows)
    for r in found:
        daily, whole, first = wanted[r["id"]]
        assert (r["daily_cluster_size"], r["consecutive_cluster_size"]) == (daily, whole)
        assert r["cluster_id"] == (f"{r['zone']}/{first}" if first else None)


def test_day_observed_nowhere_does_not_break_a_run(spark):
    rows = [(1, "A", D), (2, "A", D + timedelta(2)), (3, "A", D + timedelta(4)), (4, "B", D)]
    rows += [(5, "B", D + timedelta(2)), (6, "B", D + timedelta(3))]
    sizes = {r["id"]: r["consecutive_cluster_size"] for r in clusters.with_clusters(rows_of(spark, rows)).collect()}
    assert sizes == {1: 2, 2: 2, 3: 1, 4: 3, 5: 3, 6: 3}


def test_catalogue_adds_up(spark):
    rows = [(i, "z", D + timedelta(i % 5 + (i % 5 > 2))) for i in range(23)] + [(99, "y", D + timedelta(3))]
    found = clusters.catalogue(rows_of(spark, rows)).collect()
    assert sum(r["n_complaints"] for r in found) == 24
    assert {(r["cluster_id"], r["n_days"]) for r in found} == {("z/2016-01-01", 3), ("z/2016-01-05", 2), ("y/2016-01-04", 1)}
