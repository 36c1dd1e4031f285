"""Time the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON
line. Each query is built and fully computed once to warm up, then the median of three runs is
taken (one run for queries whose warm-up took over ten seconds).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "w3_all_periods",
    "job1_growth_ranking_7d",
    "job2_trending_page",
    "job3_catalog_buzz",
    "job4_detail_items",
    "job5_entity_overview",
    "job6_vote_upsert",
    "job7_digest_tops",
    "job12_applied_reviews",
    "job13_overridden_links",
    "job15_reclassify_updates",
    "job16_merged_links",
    "job18_catalog_upsert_plan",
    "job21_discovered_candidates",
    "snk2_item_upsert",
    "snk5_rebuilt_mentions",
    "a5_vote_tally",
    "a16_merge_preview",
    "j4_catalog_tags",
    "sf1_normalize_text",
    "sf17_parsed_judgments",
    "j11_title_matches",
    "j12_ambiguous_candidates",
    "st2_vote_outcomes",
    "st3_vote_bursts",
]


def main() -> None:
    from risemeter.queries import QUERIES
    from risemeter.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "risemeter-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        warm = run(name)
        runs = [run(name) for _ in range(1 if warm > 10 else 3)]
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {warm:.2f} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
