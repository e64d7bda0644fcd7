"""Times the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads (8).
Every query starts from the Parquet files; nothing cached by an earlier one is left.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import queries
from checks.compare import session

HEADLINE = [
    "quality_report", "clean_records", "score_sentiment", "score_emotion", "score_topic", "detect_issue",
    "enriched_rows", "issue_summary", "recurring_counts", "sample_feedbacks", "top_terms",
    "theme_examples", "sentiment_trend", "kpi_summary", "all_insights", "recommendations",
    "text_only_profile", "lexicon_sentiment", "model_probabilities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registry = queries.registry()
    # Start-up of the JVM and of the file readers is not part of a query.
    registry["non_null_count"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
