"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallygrid.session import local_session  # noqa: E402
from workload import catalog  # noqa: E402

HEADLINE = (
    "top_entities_by_score", "top_entities_in_group", "entity_comparison", "group_totals",
    "yearly_trend", "largest_increase", "category_increase", "top_entities_by_category",
    "category_trend", "resolve_entity", "ambiguous_names", "latest_snapshot",
    "feature_base", "category_pivot", "feature_table", "feature_matrix", "lag_features",
    "median_impute", "tertile_bucket", "tertile_by_rank", "stratified_split",
    "baseline_stats", "histogram", "drift_report", "daily_feature_stats",
    "chunk_documents", "tag_chunks", "upsert_chunks", "cosine_topk", "build_context",
    "tag_template", "route_questions", "extract_group", "quality_notes",
    "rubric_score", "eval_by_tool", "classification_metrics",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def once(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = list(queries)
    seconds = {}
    for name in names:
        once(queries[name], spark, sf_dir)
        seconds[name] = round(
            statistics.median(once(queries[name], spark, sf_dir) for _ in range(RUNS)), 3
        )
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
