"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local cores. Stage tables
are timed under ``stage_*`` when they are first written; every query after
them is timed on its own work, into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTRY  # noqa: E402
from checks.stages import stages  # noqa: E402
from riskrank.session import build_session  # noqa: E402

STAGES = ["accounts", "transactions", "enriched", "target", "scorecard", "features", "frame",
          "logistic_fit", "additive_fit", "model_scores"]
QUERIES = [
    "csv_transactions", "mapping_summary", "daily_profile", "accounts_per_entity",
    "enriched_transactions", "population_target", "profile_md5", "attribute_distribution",
    "scorecard_points", "rating_distribution", "directional_events", "amount_zscore",
    "customer_activity", "customer_features", "feature_means", "median_comparison",
    "mann_whitney", "chi_square", "stratified_split", "curve_areas_stand_in", "calibration_stand_in",
    "model_comparison_stand_in", "global_importance", "additive_local_contributions",
    "logistic_local_contributions", "champion_decision_stand_in",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "16g", **{
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskrank-")})
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    held = stages(spark, folder)
    for name in STAGES:
        timed(f"stage_{name}", lambda: getattr(held, name))
    for name in QUERIES:
        timed(name, lambda: REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
