"""Time the headline queries and print one JSON line.

Each query runs over the tables of $BENCH_SF_DIR and its whole result is
produced (written to the no-op sink). ``queries`` are the times of a second pass
in the same session; those of the first pass, which include class loading and
code generation, are given as ``first_pass``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from feedloom.plans import catalog  # noqa: E402
from feedloom.session import local_session  # noqa: E402

HEADLINE = [
    "rerank", "rerank_corpus", "global_rank", "page_text", "long_lines", "story_body", "dedupe_by_key", "new_only",
    "hash_embedding", "embed_distinct", "profile_scores", "sparse_profile_scores", "topk_candidates",
    "topk_candidates_shuffled", "question_topk", "request_grid", "build_prompts", "replay_generate", "generate",
    "parse_queries", "explode_outputs", "drop_failed_models", "model_stats", "box_data", "sample_outputs",
    "original_rank", "embed_cached", "cached_text", "cache_refresh", "box_outliers", "repeated_lines", "best_sentences",
    "query_diversity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session(cores, int(cores), "12g", **{"spark.checkpoint.dir": shared})

    def run(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    first = {name: run(name) for name in names}
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "first_pass": first,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
