"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR   folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_ONLY     name prefixes, comma separated, for a shorter run
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b2_encode_sentences",
    "b4_byte_tokens",
    "a3_read_indexed",
    "c7_sample_bounds",
    "c8_shuffle_samples",
    "c9_materialize",
    "c10_lm_columns",
    "c11_ltor_columns",
    "c13_blend_stride",
    "c13_blend_exact",
    "c16_build_splits",
    "c19_sentence_runs",
    "c21_pair_samples",
    "c25_fill_in_middle",
    "c27_chat_targets",
    "c29_pack_chat",
    "d2_pack_nfd",
    "d3_pack_best_fit",
    "d5_assemble_bins",
    "e2_advantages",
    "e4_rollout_metrics",
    "e7_policy_terms",
    "f1_merge_results",
    "f4_score_anls",
    "f10_score_mmmu",
    "g2_compare_golden",
    "g5_recommend_tolerance",
    "g15_progress",
    "g17_run_summary",
    "h1_release_in_order",
]


def main() -> None:
    from weft.plans import QUERIES
    from weft.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before timing
    times = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        began = time.time()
        # every column of every row is computed, nothing is brought to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    encode, warm = times.get("b2_encode_sentences"), None
    if encode:
        began = time.time()  # once more: plans and workers are warm
        QUERIES["b2_encode_sentences"](spark, folder).write.format("noop").mode("overwrite").save()
        warm = time.time() - began
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "documents": docs,
                "encode_docs_per_sec": round(docs / encode, 1) if encode else None,
                "encode_docs_per_sec_warm": round(docs / warm, 1) if warm else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
