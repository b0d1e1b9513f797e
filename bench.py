"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchlake.catalog import QUERIES, inputs  # noqa: E402
from matchlake.session import build_session  # noqa: E402

HEADLINE = [
    "S04_extract_comments",
    "C06_match_week",
    "T02_rolling_form",
    "T03_recent_form",
    "T06_season_aggregate",
    "T07_final_points_training",
    "T10_final_table",
    "T12_cutoff_sweep",
    "T20_psych_table",
    "T21_discipline_training",
    "T23_outcome_features",
    "T29_over_training",
    "T30_fixture_over_features",
    "T33_corner_stats",
    "P01_merge_player_tables",
    "P05_star_index",
    "P08_star_label",
    "P11_clutch_features",
    "M08_binary_report",
    "M10_stratified_split",
    "M02_player_goals",
    "T28_fixture_goals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    seconds = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # Reading the base tables and storing the source and match tables is timed on its own.
    timed("load_sources", lambda: inputs(spark, sf_dir).matches)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
