"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wardline.catalog import QUERIES
from wardline.session import build_session

HEADLINE = [
    "front_gate_counts",
    "front_gate_detail",
    "moderate_pairs",
    "post_gate",
    "keyword_hits",
    "keyword_table_hits",
    "keyword_table_noise_counts",
    "category_sets",
    "tri_state_guardrail",
    "window_audit_max",
    "char_windows",
    "kb_chunks",
    "sentence_chunks",
    "bm25_topk",
    "cosine_topk",
    "hybrid_topk",
    "relevance_gate",
    "session_rollup",
    "user_rollup",
    "retained_turns",
    "event_context",
    "context_messages",
    "key_usage",
    "key_changes",
    "moderate_chat",
    "reward_summary",
    "pad_truncate",
    "loss_mask_multi_turn",
    "interleave_oversample",
    "stream_gate",
    "stream_session_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for warm in ("front_gate_counts", "relevance_gate"):
        run(warm)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
