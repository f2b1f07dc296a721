"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
Each query is run once, to its last row; a small warm-up query before them pays for starting Spark.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kindred.plans import catalog  # noqa: E402
from kindred.session import local_session  # noqa: E402

HEADLINE = (
    "ratings_utility user_avg rating_counts dense_ids seed_sample item_pearson user_pearson minhash_signatures "
    "lsh_verified_jaccard lsh_user_pearson item_predict user_predict friends_avg term_freq item_profile_top200 "
    "user_profile content_scores keyword_search vector_cosine_topn content_recommend hybrid_union "
    "als_holdout als_recommend co_rating_pairs lsh_candidates lsh_user_pearson_search lsh_recall item_predict_from_file "
    "text_tfidf text_pipeline_w2v content_recommend_w2v hybrid_als"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["global_avg"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
