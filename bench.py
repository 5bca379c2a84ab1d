"""Time headline queries; prints one JSON line.

Each query runs once to warm the JVM on the small tables and then once, timed, on the bench tables,
with its full result written to the no-op sink. ``embeds_per_sec`` counts hashed passages.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.operators import hashed  # noqa: E402
from pairloom.plans import queries as Q  # noqa: E402
from pairloom.session import local_session  # noqa: E402

HEADLINE = (
    "clean_ascii clean_markup filter_text mine_duplicates mine_labeled_positives negative_pool_texts prep_stats prepare_job "
    "sample_capped shuffle_epoch negatives_reject token_ids hash_embed mean_pool embed_table embed_batch_udf sliding_passages "
    "query_from_passage token_lookup retrieve_top1 retrieve_topk triplet_loss train_step triplet_metrics retrieval_quality "
    "ir_metrics latency_nearest_rank latency_linear repeat_summary"
).split()


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pairloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    known = Q.all_queries()
    took: dict[str, float] = {}
    for name in names:
        if os.path.isdir(warm_dir):
            drain(known[name](spark, warm_dir))
        start = time.time()
        drain(known[name](spark, sf_dir))
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    passages = Q.passage_rows(spark, sf_dir).select("passage").persist()
    count = passages.count()
    best = float("inf")
    for _ in range(3):
        start = time.time()
        drain(hashed.hash_embed(passages, "passage", keep=[]))
        best = min(best, time.time() - start)
    passages.unpersist()
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")), "embeds_per_sec": round(count / best, 1), "passages": count,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
