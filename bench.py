"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from moraine import catalogue  # noqa: E402

HEADLINES = (
    "dedup_savings", "dedup_groups", "first_copy", "select_prefix", "folder_rollup", "work_order", "unit_fixed_pack", "unit_report", "stored_size", "info_summary",
    "unit_sizes", "unit_vote", "compact_remap", "upsert_latest", "damage_report", "byte_entropy", "cdc_chunks", "codec_race", "extract_all",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "500").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalogue.queries(), {}
    found["dedup_savings"](spark, sf_dir).collect()  # code is compiled and files are cached before the clock starts
    for name in HEADLINES:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "lake_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
