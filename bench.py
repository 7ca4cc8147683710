"""Time the headline queries and print one JSON line.

Each query is built, planned and run in full into a sink that discards rows. The first
round warms the JVM up; the time of a query is its best of the following rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weektide.catalog.queries import QUERIES  # noqa: E402
from weektide.session import local_session  # noqa: E402

HEADLINE = [
    "weekly_panel",
    "weekly_lite",
    "live_two_phase",
    "country_lookup",
    "null_profile",
    "clean_rows",
    "top_events_all_time",
    "radar_top50",
    "returns_vol",
    "vix_zscore",
    "direction_target",
    "interactions",
    "evolution",
    "per_class_report",
    "live_refresh",
    "gbt_scores",
    "stream_weekly",
]
# Timed once, with the fit of its models.
ONCE = {"gbt_scores"}
ROUNDS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    best: dict[str, float] = {}
    for number in range(ROUNDS + 1):
        for name in HEADLINE:
            if name in ONCE and number != 1:
                continue
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if number:
                best[name] = min(best.get(name, float("inf")), time.perf_counter() - start)
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in best.items()},
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
