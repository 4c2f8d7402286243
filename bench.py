"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the queries it times signal workloads on synthetic four-channel recordings at 15 kHz and gives them as multiples of real time: filtering
in halo blocks and template matching over 120 s, catalogue construction and the whole sort over 30 s.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = """robust_threshold_events A01_median_mad A04_isi_histogram A05_density A07_cosine_with_max A11_silhouette C05_cross_correlograms E01_global_peaks E02_geometrical_peaks J01_range_join_orders J01_waveform_cut
J02_cell_labels J08_noise_anti_join J11_suppressed_peaks K19_trash_small K23_order_clusters R04_sliding_rates T01_centroids W07_common_reference W09_normalised X13_residual""".split()


def signal_workloads(spark, seconds: int = 120, rate: float = 15000.0) -> dict[str, float]:
    from spindrift.operators import catalogue, filters, peeling
    from spindrift.sources.raw import from_arrays
    from spindrift.sources.synthetic import recording, templates

    n = int(seconds * rate)
    x, truth = recording(n // 8, gap=600)
    frames = from_arrays(spark, [x] * 8).repartition(8, "segment").persist()
    frames.count()
    out = {}
    t = time.time()
    filters.preprocess_blocks(frames, filters.Preprocessing(rate, 300.0, 5000.0), int(10 * rate), 150).write.format("noop").mode("overwrite").save()
    out["filter_s"] = time.time() - t
    made = catalogue.make_catalogue([0, 1, 2], templates(), -15, 20, -30, rate, 6.0, 5, neighbours=[[c for c in range(4) if abs(c - a) <= 1] for a in range(4)])
    t = time.time()
    peeling.peel_segments(frames, made).write.format("noop").mode("overwrite").save()
    out["peel_s"] = time.time() - t
    frames.unpersist()
    # catalogue construction and the whole sort, on one segment of 30 s
    from spindrift.operators import detect
    from spindrift.plans import pipeline

    short = 30
    x, _ = recording(int(short * rate), gap=600)
    probe = detect.default_geometry(spark, 0, [0, 1, 2, 3])
    p = pipeline.automatic(4, rate, threshold=8.0, left_ms=-1.0, right_ms=1.3)
    frames = from_arrays(spark, [x])
    t = time.time()
    processed = pipeline.process(frames, p)[0].persist()
    made, _ = pipeline.build_catalogue(processed, probe, p)
    out["catalogue_s"] = time.time() - t
    peeling.peel_blocks(processed, made, int(5 * rate)).write.format("noop").mode("overwrite").save()
    out["sort_s"] = time.time() - t
    processed.unpersist()
    real = {"filter_x_real_time": seconds / out["filter_s"], "peel_x_real_time": seconds / out["peel_s"], "catalogue_x_real_time": short / out["catalogue_s"], "sort_x_real_time": short / out["sort_s"]}
    return out | real


def main() -> None:
    from pyspark.sql import SparkSession

    from spindrift.plans.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    signals = {k: round(v, 2) for k, v in signal_workloads(spark).items()}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "signals": signals, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
