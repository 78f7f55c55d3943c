"""Benchmark: end-to-end stages, then headline queries on the stored stages.

Prints one JSON line. The stages (ingest, features, scores, live features, live
records) are timed on their own; the queries after them read what they wrote, as in
a scheduled run. Queries that scan transactions do so in full.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from merchantscope.plans import driver  # noqa: E402
from starbook.benches import workbench  # noqa: E402
from merchantscope.session import build_session  # noqa: E402

STAGES = ["tx", "features", "scored_z", "live_features", "live_records", "explorer_tx", "split_ceilings"]
QUERIES = [
    "activity_audit", "volume_features", "ticket_features", "geo_concentration",
    "card_behaviour", "ticket_percentiles", "monthly_velocity", "descriptor_features",
    "event_bursts", "split_bursts", "peer_zscores", "composite_score", "rules_and_flags",
    "exposure_queue", "dba_corp_grouping_sets", "family_pivot", "monthly_trend",
    "recent_rows_cap", "evidence_sample", "split_groups", "descriptor_timeline",
    "deviations", "peer_standing", "threshold_curve", "rank_auc", "registry_metrics",
    "surcharge_portfolio", "live_base_features", "change_point", "rapid_repeats",
    "graph_metrics", "neighbor_counts", "mcc_prediction", "ensemble_scores", "lane_rollup",
    "daily_trend", "case_rollup", "integrity_logistic", "family_volume", "sql_split_ticket_groups",
    "sql_riskiest_merchant_transactions", "peer_histogram", "keyword_matches", "head_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    bench, times = workbench(spark, folder), {}
    for stage in STAGES:
        start = time.perf_counter()
        getattr(bench, stage)
        times[f"stage_{stage}"] = round(time.perf_counter() - start, 3)
    queries = driver.all_queries()
    for name in QUERIES:
        start = time.perf_counter()
        queries[name](bench).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "merchant integrity run, all stages and headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
