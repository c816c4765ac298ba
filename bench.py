"""Time the headline queries; prints one JSON line.

Each query is run whole into a sink that discards its rows, after one untimed query has warmed the JVM.
"""

from __future__ import annotations

import json
import os
import time

from eventlink.plans.catalogue import queries
from eventlink.session import build_session

HEADLINE = (
    "link_causes",
    "link_effects",
    "link_pairs",
    "link_outer",
    "link_calendar",
    "abc_chain",
    "abc_shares",
    "from_work_related_anomaly",
    "type_pct_followed",
    "year_pct_followed_wide",
    "attribution_multihot",
    "attribution_totals",
    "random_baseline",
    "poisson_by_type",
    "cluster_sizes",
    "cluster_catalogue",
    "merge_event_spans",
    "incident_rollup",
    "demographic_rates",
    "hourly_profile_normalised",
    "histogram_by_group",
    "density_curve",
    "reconcile_outer",
    "operations_per_order",
    "dedupe_readings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("points_per_zone")
    taken = {name: run(name) for name in HEADLINE}
    total = round(sum(taken.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": taken, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
