"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = (
    "rank_subjects", "subject_query_combined", "query_ast_nested", "box_overlap_join", "co_occurrences", "appearances", "visits", "mine_patterns", "detect_statistical", "detect_graph",
    "change_point_cusum", "mot_metrics", "zone_hysteresis", "track_boxes", "ingest_gate", "isolation_forest", "hard_nms", "soft_nms", "top_k_vectors", "roc_curve", "mask_set_operations",
)


def main() -> None:
    from trackmesh.plans import catalog
    from trackmesh.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took, found = {}, catalog.queries()
    found["rank_subjects"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first run compiles code
    for name in QUERIES:
        start = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
