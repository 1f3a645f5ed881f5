"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line.

For each decision-support query: ``qN`` is the plain query, ``qN_all`` runs
it with capture (the result keeps its pointers) and traces every output row
to its main access, ``qN_single`` captures and traces one output row.
``value`` is the total of all; ``ratio_all`` and ``ratio_single`` are the
geometric means of qN_all / qN and qN_single / qN, the published metric;
``backtrace_single`` is the mean share of qN that tracing one row alone takes.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import time

from pyspark.sql import SparkSession

from sparktrail.operators import backtrace, capture, keep_result, release
from sparktrail.plans import micro, tpch

ACCESS = {"q2": "s", "q4": "o", "q9": "p", "q10": "o", "q11": "l1", "q12": "o", "q13": "o", "q14": "p", "q15": "l1", "q16": "p", "q19": "p", "q20": "p", "q22": "c"}


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = micro.Tables(spark, sf_dir)
    times: dict[str, float] = {}
    alone: dict[str, list[float]] = {}
    for name, plan in tpch.PLANS.items():
        access = ACCESS.get(name, "l")
        captured = capture(plan(t))
        run(captured.result)  # compile once
        plain = min(run(captured.result) for _ in range(3))
        keys = [c for c in captured.data if c in dict(captured.keys)] or list(captured.data[:1])
        seconds: dict[str, list[float]] = {"all": [], "single": []}
        for _ in range(2):
            for part, options in (("all", {}), ("single", {"offset": 0})):
                kept = keep_result(capture(plan(t)))
                ran = run(kept.df)
                traced = run(backtrace(kept, access, keys, **options))
                release(kept)
                seconds[part].append(ran + traced)
                if part == "single":
                    alone.setdefault(name, []).append(traced)
        times |= {name: plain, f"{name}_all": min(seconds["all"]), f"{name}_single": min(seconds["single"])}
    mean = lambda values: math.exp(sum(map(math.log, values)) / len(values))
    ratios = {f"ratio_{part}": round(mean([times[f"{q}_{part}"] / times[q] for q in tpch.PLANS]), 3) for part in ("all", "single")}
    ratios["backtrace_single"] = round(mean([min(alone[q]) / times[q] for q in tpch.PLANS]), 3)
    print(json.dumps({"metric": "lineage queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in times.items()}, "sf": sf_dir.rstrip("/").rpartition("sf")[2], **ratios}))
    spark.stop()


if __name__ == "__main__":
    main()
