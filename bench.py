"""Benchmark the headline queries.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; every query is executed into the ``noop`` sink (full
execution, nothing collected), once cold and three times warm (the median counts).
``value`` is the warm total of the same ten queries as in earlier rounds; ``heavier`` has
queries with many scans, once each. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.operators.materialize import release  # noqa: E402
from shelfwise.registry import REGISTRY, present  # noqa: E402
from shelfwise.session import get_session  # noqa: E402
from shelfwise.sources.catalog import Catalog  # noqa: E402

HEADLINE = ["q03", "q15", "q16", "q22", "q28", "q43", "m05", "m06", "k09_product_performance", "k14_cohorts"]

HEAVIER = ["c1_c2_keys", "c3_foreign_keys", "c4_c5_domains_ranges", "c6_c7_row_checks", "k08_category_performance", "k18_operations_overview",
           "k23_operational_risks", "k28_financial_risks", "m09", "m12"]
WARM_RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="shelfwise-bench-")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "8g", "spark.local.dir": scratch})
    def timed(name: str) -> float:
        t0 = time.perf_counter()
        present(REGISTRY[name](Catalog.from_tpch(spark, sf_dir))).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t0
        release(spark)  # rows held for a ranking: every run computes its own
        return took

    names = [n for n in HEADLINE if n in REGISTRY]
    cold = {n: round(timed(n), 3) for n in names}
    runs = [{n: timed(n) for n in names} for _ in range(WARM_RUNS)]
    warm = {n: round(median(r[n] for r in runs), 3) for n in names}
    heavier = {n: round(timed(n), 3) for n in HEAVIER if n in REGISTRY}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "heavier": heavier, "cold_total": round(sum(cold.values()), 3), "sf": sf,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
