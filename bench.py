"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidings.plans import QUERIES
from tidings.session import build_session

HEADLINE = (
    "item_simhash",
    "canonical_items",
    "keyword_hits",
    "combined_matches",
    "keyword_coverage",
    "relevance_prefilter",
    "cluster_decisions",
    "ranked_stories",
    "topic_lines",
    "hybrid_search",
    "similar_titles",
    "rss_items",
    "page_texts",
    "budget_blocked",
    "rate_windows",
    "feedback_by_source",
    "canonical_urls",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()  # session start is not a query's
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
