"""Benchmark: wall seconds per headline query key at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each key is fully materialised with the ``noop`` sink (no driver collect), after
one warm-up run; the reported time is the median of ``$BENCH_REPS`` runs (default 3),
and the cache is cleared before every run, so none is served from an earlier one.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shotloom.plans import registry  # noqa: E402
from shotloom.session import get_spark  # noqa: E402

HEADLINE = ["retrieve_jaccard", "retrieve_dot", "prompt_build", "repair_literals", "sql_edges",
            "retrieve_random", "retrieve_class", "correction_prompt", "complexity", "content_index"]


def run_once(spark, key: str, sf_dir: str) -> float:
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in registry.QUERIES]
    spark = get_spark()
    times = {}
    for key in keys:
        run_once(spark, key, sf_dir)  # warm-up: JIT, codegen, file listing
        times[key] = round(statistics.median(run_once(spark, key, sf_dir) for _ in range(reps)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "reps": reps}))


if __name__ == "__main__":
    main()
