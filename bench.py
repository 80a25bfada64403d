"""Times the headline queries on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from importlib.util import find_spec

from pyspark.sql import SparkSession

from kinfold.plans import registry

HEADLINE = [
    "doc_shingle_oph", "doc_nearest_topk", "seq_minimizers", "seq_edit_distance", "csr_exact_measures", "csr_lsh_candidates",
    "csr_densified", "csr_probminhash", "kmer_exact_counts", "basket_oph", "lineitem_count_sketch", "embedding_cosine_topk",
]
EXTRA = ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_containers", "p10_found"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {q: registry.QUERIES[q] for q in HEADLINE}
    if find_spec("kinfold.llm"):
        from kinfold.llm import queries as more

        todo |= {q: more.QUERIES[q] for q in EXTRA}
    times = {}
    for name, f in todo.items():
        began = time.time()
        f(spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds, headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
