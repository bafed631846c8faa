"""Times the headline queries: one line of JSON with the median seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quern.plans import catalogue
from quern.session import build_session

#: TPC-H shapes, cyclic joins in both ways, sub-queries and sorts.
HEADLINE = [
    *("tpch_q1 tpch_q3 tpch_q4 tpch_q5 tpch_q6 tpch_q7 tpch_q8 tpch_q10 tpch_q12 tpch_q13 tpch_q14 tpch_q15 tpch_q17 tpch_q18 tpch_q19 tpch_q21 tpch_q22".split()),
    *("join_6way join_cyclic join_triangle join_triangle_multiway join_band exists_residual correlated_avg agg_global topk order_nulls".split()),
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for k in range(REPEATS + 1):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:  # the first warms up
                runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
