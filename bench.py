"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "top_sources", "url_dedup", "near_dup_keep_first", "batch_dedup", "event_clusters", "topk_similar",
    "resonance", "history_match", "divergence_signal", "flow_push_tier", "sector_flow", "asof_change",
    "market_enrichment", "pending_outcomes", "category_bias", "ema_bias", "source_weights", "threshold_grid",
    "source_stalls", "debounced_alerts", "keyword_intensity", "deviation_scores", "content_quality",
    "geo_multipliers", "strategic_matches", "priority_scores", "screened_headlines", "lexicon_sentiment",
    "event_decisions", "page_headlines", "stream_source_stalls",
]


def main() -> None:
    from newsflow.plans import QUERIES
    from tests.session import session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
