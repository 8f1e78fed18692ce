"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "o09_primary_link", "w20_candidates", "f05_links_with_context", "f06_split_sentences", "f09_latex_to_text", "f10_link_score",
    "w01_keep_first", "j05_merge_fill", "w03_global_ids", "w04_token_windows", "w06_context", "w14_character_packing",
    "a03_yearly_counts", "a07_mean_vote", "a09_description", "a10_binary_metrics", "a17_mean_metrics", "o02_cosine_top_k",
    "o05_keyword_search", "j10_section_asof", "w16_balanced_shards", "t01_polling",
]

# Keeps its intake for the session: a second run would measure nothing.
ONCE = {"t01_polling"}


def main() -> None:
    from paperlode.queries.registry import QUERIES
    from paperlode.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").write.format("noop").mode("overwrite").save()
    QUERIES["f06_split_sentences"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is no query's time
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(1 if name in ONCE else 3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
