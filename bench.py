"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from textmatch.queries import load
from textmatch.session import local_session

HEADLINE = (
    "c1_sentences",
    "t10_basic_tokens",
    "a14_word_counts",
    "t12_tokenize",
    "a2_match_percent",
    "j2_nearest_exact",
    "g2_chunk_plan",
    "w4_near_equal_runs",
    "c8_evaluate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = load()[0]
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 2)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
