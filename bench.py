"""Headline queries on the given tables; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from weekgrid.plans import QUERIES
from weekgrid.session import local_session

HEADLINE = (
    "coverage_cells", "safe_listings", "collapse_duplicates", "rank_nearby", "city_rollup", "audit_counts",
    "slice_cells", "online_page", "geocode_completion", "venue_borrow", "catalog_merge", "vector_topk",
    "latest_user_turn", "keyword_documents", "page_lines",
)


def seconds(spark, name: str, sf: str) -> float:
    """The median of BENCH_RUNS timed runs after one warm-up run, every column computed."""
    times = []
    for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    timed = sorted(times[1:])
    return round(timed[len(timed) // 2], 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "weekgrid-bench")
    queries = {name: seconds(spark, name, sf) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
