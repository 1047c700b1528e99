"""Time the headline queries and print one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillon.plans import catalog, gates, lookups, projects, recall, records, relations, structure, styles  # noqa: F401  (these add their queries to the catalog)

HEADLINE = "a1_confidence a3_author_trust a5_merge_replicas a9_stage_factors a21_precision_recall a25_median_p95 a36_blame a_rollup g6_impact g7_merge_field g11_components j4_belief_diff j9_as_of m5_consensus p14_stop_gate r1_rubric r6_shingles r10_reuse_ladder r11_clusters s9_code_graph t1_retrieve t13_knn w2_ring_recurrence w4_cusum".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
