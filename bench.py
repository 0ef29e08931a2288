"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskloom.queries.catalogue import runs  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = (
    "G1_history_per_client",
    "G2_panel_per_credit",
    "G4_panel_per_client",
    "G5_previous_per_client",
    "J7_assemble",
    "W6_roll_rates",
    "W12_prefix_sums",
    "AUD16_numeric_profile",
    "M1_flag_signal",
    "M2_rank_signal",
    "M10_pearson_pairs",
    "V2_information_value",
    "K3_first_crossing",
    "X1_stratified_split",
    "X2_stratified_folds",
    "E1_ranking",
    "E2_strategy_curve",
    "P1_winsorise",
    "P8_median_imputation",
    "P14_fit_on_train_only",
    "L1_logistic",
    "L2_forest",
    "L3_boosted",
    "X6_synthetic_minority",
    "X7_synthetic_without_links",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "riskloom-bench")
    plans, times = runs(), {}
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    for name in HEADLINE:
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.perf_counter()
        plans[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
