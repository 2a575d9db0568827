"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from alertloom.plans import places  # noqa: E402
from alertloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "q1_active_alerts", "q2_alert_history", "q3_map_alerts", "q4_nearby_alerts", "q4_nearby_for_viewers", "j3_with_children",
    "j5_within_radius", "j14_geoip_join", "a2_summary_metrics", "a12_tile_clusters", "v1_validate_alerts", "k1_content_hash",
    "w7_revision_chain", "w8_consecutive_failures", "i1_classify", "i4_apply_upsert", "x6_fold", "e4_scan_documents", "e4_scan",
    "e5_extract", "rs5_primary_location", "s1_cap_scan", "s3_read_quake_table", "s5_extract_links", "b9_river_conditions",
    "b10_structure_bulletins", "s15_to_geojson", "st3_stream_upsert", "st6_stream_window_counts", "st7_stream_health",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    started = time.perf_counter()
    places.index(spark, folder)  # the place index is built once, like a deployed table
    seconds["build_place_index"] = round(time.perf_counter() - started, 3)
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
