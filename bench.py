"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``stages`` repeats the timings as stage, elapsed_seconds, frames and throughput_fps, where
frames are the input rows an operator reads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelframe.catalogue import QUERIES  # noqa: E402
from reelframe.session import build_session, release_tables  # noqa: E402

# Query and the table whose rows are its frames.
HEADLINE = {
    "quality_gate_scan": "lineitem",
    "quality_gate": "events",
    "vo_summary": "events",
    "momentum": "lineitem",
    "stationary_hysteresis": "events",
    "trajectory_consistency": "events",
    "integrate_trajectory": "events",
    "nearest_day": "lineitem",
    "nearest_join": "events",
    "band_pairs": "lineitem",
    "nms": "events",
    "min_interval_select": "events",
    "keyframe_chain": "events",
    "gric": "lineitem",
    "ray_dispersion": "lineitem",
    "descriptor_match": "embeddings",
    "raw_quality": "embeddings",
    "pair_ssim": "embeddings",
    "reproject_cubemap": "embeddings",
    "gravity_moving_average": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(HEADLINE)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    for name in ("quality_gate", "raw_quality"):  # starts code generation and Python workers
        QUERIES[name].run(spark, sf_dir).limit(1).collect()
    times, stages = {}, []
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        times[name] = round(took, 3)
        frames = rows[HEADLINE[name]]
        stages.append(
            {"stage": name, "elapsed_seconds": round(took, 3), "frames": frames, "throughput_fps": round(frames / took, 1)}
        )
        print(f"{name}: {took:.2f}s", file=sys.stderr, flush=True)
    release_tables(spark)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "stages": stages,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
