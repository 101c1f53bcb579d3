"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, default headline).
Each query is built and run to the end (all rows are made, none are collected), after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from fairlead.plans.registry import load
from fairlead.session import get_spark

HEADLINE = (
    "enrich_positions", "alerts_throttled", "alert_texts", "enrich_with_master", "geofence_events", "proximity_pairs",
    "collision_risk", "tracks_summary", "track_smoothed", "track_simplified", "track_gapfill", "speed_change_5min",
    "movement_hourly", "weather_hourly", "port_traffic_daily", "density_grid", "vessel_daily", "latest_positions",
    "last_n_positions", "vessel_history", "search_vessels", "weather_nearby", "nearest_vessels", "decode_envelopes",
    "decode_weather", "normalise_instants", "upsert_weather", "history_append", "live_operation_sets",
    "stream_alerts", "stream_fan_out",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = get_spark("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    catalog["latest_positions"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
