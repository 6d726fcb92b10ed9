"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a no-op write (full computation, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foldspark.plans.queries import REGISTRY  # noqa: E402
from foldspark.session import get_spark  # noqa: E402

# Headline queries: one per operator family (splits, prep, SMOTE, metrics, ROC, sweep, tests, search, learner).
HEADLINE = ["audit_summary", "stratified_kfold", "prep_apply_long", "smote_rows", "metrics_by_model_fold",
            "roc_points", "threshold_sweep", "wilcoxon_greater", "search_best_so_far", "permutation_importance_formula",
            "cv_logistic_summary"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
