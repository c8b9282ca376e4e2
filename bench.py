"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from flowtables import session
from flowtables.queries import QUERIES

HEADLINE = (
    "window_incremental_agg window_scan window_v2 expected_runs cron_prev runs_merged sensor_ready upstream_bulk_resolve registry_diff "
    "priority_weight downstream_closure cycle_nodes run_state_fold operator_run_fold alert_routes replay_plan macro_render sql_lineage load_merge profile_window"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g")
    local = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false"}
    for key, value in {**session.SETTINGS, **session.NEW_SESSION, **local}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
