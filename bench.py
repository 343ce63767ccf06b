"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidefold.plans.catalog import QUERIES

NAMES = ["stage_agg_sum", "stage_agg_filter", "stage_latest", "stage_liveset", "stage_foreach_agg", "stage_join_inner", "stage_merge_full", "proj_rules_fold", "proj_delete_row", "proj_agg_array", "proj_scalar_filtered", "proj_spine_lookup", "proj_stage_fed", "mirror_keyed", "log_compact_snapshot", "type_migration_chain"]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        for _ in range(2):  # the second run counts: code is compiled by then
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "read-model queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
