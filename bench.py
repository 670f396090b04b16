"""Headline queries of the engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once cold and then BENCH_RUNS times (default 3); its figure is the median of the warm runs. Results go
to Spark's no-op sink, so every row is made and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

from tesserae.queries import QUERIES, run_text  # noqa: E402
from tesserae.session import session  # noqa: E402

TEXTS = {
    "scan": "SELECT * FROM lineitem",
    "filter": "SELECT * FROM lineitem WHERE l_quantity >= 45",
    "group_by": "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY l_suppkey",
    "distinct": "SELECT l_returnflag, uniq(l_partkey) AS u FROM lineitem GROUP BY l_returnflag",
    "quantile": "SELECT l_returnflag, quantiles(0.9, l_extendedprice) AS q FROM lineitem GROUP BY l_returnflag",
    "top_n": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "top_k": "SELECT l_linestatus, topK(10, l_partkey) AS t FROM lineitem GROUP BY l_linestatus",
    "functions": "SELECT toYYYYMM(l_shipdate) AS m, intDiv(l_orderkey, 100) AS d, l_tax / l_discount AS q FROM lineitem",
}
OTHERS = ("group_sum_count", "group_min_max", "group_avg", "filter_mixed_string")
#: Life-cycle queries: they write parts, so they run once.
ONCE = ("mv_sum", "merge_plain")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, count = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    frames = {n: (lambda t=t: run_text(spark, sf_dir, t)) for n, t in TEXTS.items()} | {n: (lambda n=n: QUERIES[n](spark, sf_dir)) for n in (*OTHERS, *ONCE)}
    seconds = {}
    for name, make in frames.items():
        times = []
        for _ in range(1 if name in ONCE else count + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:] or times), 4)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
