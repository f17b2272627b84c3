"""Times the headline queries on the tables of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time


def main() -> None:
    from skyloom.queries import QUERIES
    from skyloom.session import local_session, ship_package

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    names = ["q_scan_cuts", "q_galactic", "q_gnomonic", "q_patch_gate", "q_sr_counts", "q_roi_cells", "q_rois", "q_hist_score", "q_knn_score", "q_candidates", "q_candidate_members"]
    times: dict[str, float] = {}
    QUERIES["q_patch_grid"](spark, sf_dir).count()  # starts the session
    for name in names:
        begun = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
    stars = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {"without_scores": round(stars / times["q_candidates"]), "with_scores": round(stars / times["q_candidate_members"])}
    spark.stop()
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "stars_per_second": rates, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    sys.exit(main())
