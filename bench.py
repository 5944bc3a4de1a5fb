"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the best of $BENCH_RUNS runs of each."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from verification.check import session  # noqa: E402
from verification.registry import QUERIES  # noqa: E402

HEADLINES = [
    "extract_claims",
    "sanitize_narrative",
    "govern",
    "promotion_summary",
    "silver",
    "quarantine",
    "dim_claimant",
    "fact_claims",
    "analytical_mart",
    "kpi_summary",
    "net_amount_ytd",
    "exposure_by_province",
    "audit_ledger",
    "verdict_counts",
    "chunk_documents",
    "search_text",
    "search_vectors",
    "latest_by_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session()
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
