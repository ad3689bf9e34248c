"""Times the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mistgrove.catalog.inputs import CLASSES, KEY, NUMERIC, labelled, model_inputs
from mistgrove.catalog.queries import QUERIES
from mistgrove.operators import cuts as cutting
from mistgrove.operators.score import score_table
from mistgrove.plans.partitioning import fuzzy_partition
from mistgrove.plans.trees import train_binary, train_multi


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    """Compute every row and column without storing them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    times: dict[str, float] = {}

    def timed(name: str, job) -> object:
        best, result = None, None
        for _ in range(repeats):
            started = time.perf_counter()
            result = job()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
        return result

    df, features = model_inputs(spark, folder)
    drain(df)
    for name in ("best_split_multi", "exact_quantiles", "uniform_scale", "equi_frequency_cuts", "contingency_width",
                 "binary_split_numeric", "binned_rows"):
        timed(name, lambda name=name: drain(QUERIES[name](spark, folder)))
    timed("fuzzy_partition_width", lambda: drain(fuzzy_partition(
        labelled(spark, folder), NUMERIC, "cls", CLASSES, cutting.EQUAL_WIDTH, max_bins=1000)))
    multi = timed("train_multi", lambda: train_multi(df, features, "cls", CLASSES, max_depth=3))
    timed("score_multi", lambda: drain(score_table(df, multi, KEY)))
    binary = timed("train_binary", lambda: train_binary(df, features, "cls", CLASSES, max_depth=4))
    timed("score_binary", lambda: drain(score_table(df, binary, KEY)))
    timed("accuracy_stats", lambda: drain(QUERIES["accuracy_stats"](spark, folder)))
    print(json.dumps({
        "metric": "total time of headline jobs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
