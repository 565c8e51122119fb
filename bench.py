"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: median of three warm runs each, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import load_all  # noqa: E402
from millrace.session import build_session  # noqa: E402

HEADLINE = (
    "a1_user_features", "a2_product_features", "a5_kpi_row", "a6_channel_breakdown", "a13_user_behavior", "a16_churn_labels_rule",
    "a17_quality_report", "a30_latency_percentiles", "f1_drop_malformed", "p15_stream_columns", "u3_dedupe", "j3_region_enrichment",
    "j6_point_in_time", "a22_roc_auc", "l4_threshold_alerts", "w12_counter_rate", "m14_drift_psi", "m7_trend_forecast", "v1_chunks",
    "v4_exact_search", "g1_redact_text", "r1_hourly_windows", "r7_ingest_stream",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog, seconds, failed = load_all(), {}, {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        try:
            times = []
            for attempt in range(RUNS + 1):
                start = time.perf_counter()
                catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                if attempt:  # the first run warms up
                    times.append(time.perf_counter() - start)
            seconds[name] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(name, seconds.get(name), file=sys.stderr, flush=True)
    records = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
           "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if "r7_ingest_stream" in seconds:
        # The stream query publishes each event twice, so it decodes twice the number of events.
        out["stream_records_per_sec"] = round(2 * records / seconds["r7_ingest_stream"])
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
