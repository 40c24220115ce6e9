"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated name
prefixes, default all), BENCH_RUNS (timed runs per query, the median counts, default 1), BENCH_BUDGET
(seconds after which no further query is started, default none; what was left out is an error)."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

from landloom.session import build_session


# The longest-running searches go last, so that a short budget still covers everything else.
LAST = ["w4_suppress_duplicate_plots", "j14_score_transforms"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    # The numeric libraries of eight Python workers share eight cores: one thread each.
    single = {f"spark.executorEnv.{v}": "1" for v in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS")}
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, **single})
    spark.sparkContext.setLogLevel("ERROR")

    from landloom.plans import registry

    registry.load_all()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    budget = float(os.environ.get("BENCH_BUDGET", "inf"))
    began = time.perf_counter()
    for name in sorted(registry.QUERIES, key=lambda n: LAST.index(n) + 1 if n in LAST else 0):
        fn = registry.QUERIES[name]
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        if time.perf_counter() - began > budget:
            errors[name] = "not started: the budget was used up"
            continue
        took = []
        try:
            for _ in range(runs):
                start = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            times[name] = round(statistics.median(took), 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as exc:  # one failing query must not hide the others
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            print(f"{name} FAILED {errors[name]}", file=sys.stderr, flush=True)
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/"))}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
