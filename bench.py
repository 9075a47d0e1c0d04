"""Headline queries, one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Every query starts from the tables: frames kept by earlier queries are dropped.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "causal_fill", "robust_transform", "features", "memory_boundary", "knn_channel",
    "knn_global", "gated_fusion", "score_components", "select_score_params", "eval_summary",
    "event_effect", "detect_native", "detect", "detect_daily", "ledger_latest", "grid_integrity",
    "latency_summary", "auprc",
)


def main() -> None:
    from pyspark.sql import SparkSession
    from spark_analog.queries.registry import QUERIES, forget
    import spark_analog.queries  # noqa: F401

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench_')}")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["family_of"](spark, SF_DIR).count()

    seconds, rows, jobs, stages = {}, {}, {}, {}
    for name in HEADLINE:
        forget()
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        df = QUERIES[name](spark, SF_DIR)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
        jobs[name] = len(ids)
        stages[name] = sum(len(info.stageIds) for i in ids
                           if (info := spark.sparkContext.statusTracker().getJobInfo(i)))
        if name == "features":  # one row per window and feature; windows are counted once
            windows = df.select("entity", "channel", "w").distinct().count()
            rows["windows_per_second"] = round(windows / seconds[name], 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").split("/")[-1].removeprefix("sf"),
        "jobs": jobs, "stages": stages, **rows}))


if __name__ == "__main__":
    main()
