"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds per query (best of two, after
one run that compiles code)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quern.plans import registry  # noqa: E402
from quern.session import build_session, table  # noqa: E402

HEADLINE = [
    "t1_dense_topk",
    "t2_lexical_topk",
    "q1_hybrid_search",
    "a4_repeated_questions",
    "n4_t9_gap_order",
    "a7_j12_volume_per_day",
    "j10_never_returned",
    "j11_searches_since_indexing",
    "a20_j22_auc",
    "a22_j23_floor_sweep",
    "j8_s24_snapshot_diff",
    "s28_path_conflicts",
    "j14_four_way",
    "r2_sliding_log",
    "w5_resolved_links",
    "c1_chunk_documents",
    "c17_pii_findings",
    "c3_c11_convert_pages",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds, rows = registry.queries(), {}, {}
    for name in HEADLINE:
        times = []
        for k in range(3):
            t = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.time() - t)
        seconds[name] = round(min(times), 3)
    docs = table(spark, sf, "documents").count()
    asked = table(spark, sf, "conversations").filter("role = 'user' AND conv_id % 50 = 0").count()
    rows["documents_chunked_per_sec"] = round(docs / seconds["c1_chunk_documents"], 1)
    rows["hybrid_searches_per_sec"] = round(asked / seconds["q1_hybrid_search"], 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("/", 1)[-1], "rates": rows}))


if __name__ == "__main__":
    main()
