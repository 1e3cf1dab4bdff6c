"""Time the headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogspark import plans  # noqa: E402
from catalogspark.session import build_session  # noqa: E402

HEADLINE = [
    "catalog_stats", "month_histogram", "year_rollup", "decision_stats", "journal_runs", "collision_tiers", "dedupe_exact", "choose_keeper",
    "dup_summary", "cluster_similar", "hamming_pairs", "tag_assets", "phrase_confidence", "retag_stale", "effective_tags", "boolean_search", "search_words", "search_smart", "regex_search",
    "fuzzy_word", "ask_blend", "decide_places", "sequence_neighbors", "upsert_scan", "extract_generation", "trace_prompt_graph", "word_frequency", "propose_corrections", "decide_description",
    "plan_metadata", "assign_serials", "plan_organize", "validate_plan", "apply_run_results", "browse", "order_browse", "watch_catalog",
    "decide_dates", "assets_per_month",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", "bench", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    queries = plans.load_all().QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            seconds[name] = None
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(v for v in seconds.values() if v is not None), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
