"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from grafmill.plans import registry

#: knn_cosine, user-based, meets 49 million pairs at sf0.1.
HEADLINE = [
    "pagerank", "hits", "sssp", "reachable_hops", "bfs_band", "hadi_diameter", "degree_dist_out", "adjacency_list", "induced_subgraph", "id_mapping", "matmul_dense",
    "knn_cosine", "knn_cosine_items", "knn_pearson_items", "relational_prediction", "pairwise_prefs", "mf_sgd_gaussian", "mf_sgd_bias", "mf_fold_gaussian", "cmf", "bpr", "tensor_cp", "als_general", "predict_pairs", "predict_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory(prefix="grafmill-bench-") as shared:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", shared)
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        queries = registry.queries()
        names = sys.argv[1:] or HEADLINE
        queries["edge_count"](spark, sf_dir).collect()  # classes are loaded
        took = {}
        for name in names:
            t = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t, 3)
        spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
