"""Runs the headline queries and prints one JSON line: seconds for each (median of the warm runs) and in all."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = ("align", "align_stamps", "align_multi", "candle", "quodist", "qq", "opt", "sex1", "accsum", "accrpl", "sma", "ewma", "rolling", "fra", "spread", "eva", "imp_summary", "xevent", "sea_profile", "sea_apply", "evt_erlang_fit", "evt_poisson", "thours", "loghist")


def main() -> None:
    sys.path.insert(0, str(ROOT))
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    from tickspark import plans

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            plans.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({"metric": "headline queries, median of warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(SF_DIR).name.removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
