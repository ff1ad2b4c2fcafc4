"""Times the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from cairnspark.plans.registry import QUERIES

HEADLINE = ["anchor_distances", "radius_count", "radius_percentiles", "knn_stats", "comparables_cascade", "hier_fallback", "group_typology", "geo_stats", "smoothed_encode", "lag_pivot_yoy", "leave_group_out", "leave_fold_out_encode", "segment_errors", "within_group_z", "percent_rank_avg", "duplicate_keys", "stack_ridge"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
