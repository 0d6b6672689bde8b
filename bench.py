"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one JSON line.

Each query is forced end to end with the ``noop`` sink (full computation, nothing
collected).  A short untimed warm-up on the smallest scale factor loads and JIT-compiles
the code paths first; each query then reports the median of $BENCH_REPEAT runs (default 1).
``value`` is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabspark.plans.registry import all_queries  # noqa: E402
from tabspark.session import local_session, temporary  # noqa: E402

HEADLINE = [
    "flagship_feature_slice",
    "fe_log1p",
    "fe_clip_iqr",
    "cross_num_num",
    "cross_num_cat",
    "enc_ordinal",
    "enc_fold_target",
    "enc_m_estimate",
    "prof_numeric_stats",
    "prof_univariate",
    "prof_histogram_by_class",
    "prof_kde",
    "prof_cramers_v",
    "prof_anova",
    "prof_outlier_summary",
    "blend_equal",
    "blend_rank",
    "blend_weights",
    "blend_leaderboard",
    "diag_diversity",
    "diag_oof_test_distance",
    "cv_oof_random_forest",
    "stream_feature_slice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("tabspark-bench", cores=cpus, shuffle_partitions=int(cpus) * 2)
    qs = all_queries()
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("flagship_feature_slice", "blend_equal", "prof_univariate"):
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.time()
            with temporary():  # what a query keeps ends with it, inside the clock
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
