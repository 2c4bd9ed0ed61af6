"""Time the headline queries; prints one JSON line."""
import json
import os
import time

from loomgraph.core.session import local_session
from loomgraph.plans import catalog

HEADLINE = ["gcn_norm", "gcn_conv", "graph_conv", "sage_conv", "gat_conv", "appnp", "softmax_by_target", "degree_weighted",
            "laplacian_sym", "topk_ratio", "pool_edge", "two_hop", "knn_graph", "spmv", "aat", "node_features",
            "csr_scale_idf", "csr_similar_rows_cosine", "last_k_neighbors", "temporal_split", "wl_conv", "random_walks"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    table = catalog.queries()
    spark.read.parquet(f"{path}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        table[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(path).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
