"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strideframe.plans import QUERIES  # noqa: E402
from strideframe.session import build_session  # noqa: E402

HEADLINE = [
    "signal_auc_timing", "phase_grid_linear", "curve_band", "segment_join", "sliding_windows", "window_quality", "welch_psd", "cycle_features",
    "permutation_entropy", "channel_qc_time", "qc_summary", "scale_p99", "pairwise_correlation", "cocontraction", "cycle_stability",
    "paired_stats_fdr", "paired_tests_dispatch", "wilcoxon_normal", "mcnemar_labels", "permutation_test", "nearest_centroid", "component_similarity",
    "select_k", "fuse_wide", "lookup_precedence", "recode_group", "unique_rows", "filtered_channels", "factor_select_k", "nnls_activations",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    found = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
