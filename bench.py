"""Time the headline queries; prints one JSON line.

The data folder comes from BENCH_SF_DIR, the number of cores from BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import sys
import time

from newsloom.catalog import QUERIES
from newsloom.session import spark_session

HEADLINE = ["similar_docs", "vector_duplicates", "size_bounded_clusters", "missing_from_all", "parse_pages",
            "traverse_outbound", "doc_vectors_core", "assign_newbies", "frontier_links", "apply_batch",
            "update_docs", "inverted_index", "split_sentences", "feed_versions"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = spark_session("bench", cores=os.environ.get("BENCH_CPUS", "8"), memory="16g")
    # start the JVM's and Python's workers before the clock runs
    QUERIES["count_docs"](spark, folder).collect()
    QUERIES["nearest_pivot"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
