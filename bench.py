"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestar import registry, session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "scan_filter_range", "index_point_lookup", "project_computed", "join_inner_equi", "join_residual", "join_three_way", "join_left", "agg_group_by", "agg_group_multi", "agg_count_distinct",
    "q1_like", "q3_like", "q6_like", "distinct_column", "topk", "sort_multi", "in_subquery", "correlated_scalar", "unnest_split_tokens", "regexp", "text_match_boolean", "view_as_basic", "window_extra",
)


def main() -> None:
    spark = session.session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        times[name] = round(min(best), 4)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "lineitem_rows": rows, "q1_rows_per_s": round(rows / times["q1_like"])}))
    spark.stop()


if __name__ == "__main__":
    main()
