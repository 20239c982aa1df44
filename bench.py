"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from larkspur.plans import registered
from larkspur.session import build_session, release_runs

HEADLINE = (
    "l1_listing_search", "n1_normalize_listings", "a1_dedupe_listings", "f2_search_listings", "w1_rails_score",
    "o1_sort_pay", "a2_top_industries", "j3_company_domain", "a15_skill_trend", "a17_job_skill_bridge",
    "s6_shard_meta", "f3_window_slice", "r0_enrich_requests", "a7_usage_by_date", "a8_usage_report",
    "a10_vote_state_with_authors", "a12_user_stats", "t1_thread_tree", "j4_loaded_comments",
    "x1_extract_contacts", "x2_job_postings", "n14_clean_body", "f9_allowed_pages", "m1_usage_stream",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.time()
        registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.time() - start
        release_runs(spark)
        return took

    times = {}
    for name in HEADLINE:
        seconds(name)  # warm-up
        times[name] = round(statistics.median(seconds(name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the median seconds of the headline queries", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
