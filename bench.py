"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# In this order: a query that builds a graph comes before those that read it.
HEADLINE = [
    "nodes_fk", "nodes_turns", "nodes_flow", "edges_fk", "coupling_fk", "health_score_fk", "depth_warnings_fk",
    "blast_radius_fk", "shortest_path_flow", "topological_layers_fk", "timeline_steps_fk", "mini_graph_fk",
    "diff_edges_fk", "removal_impact_changes_fk", "rule_violations_fk", "imports_py", "imports_js", "imports_cs",
    "page_links", "churn_per_file", "bursts", "sliding_limit",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from linkloom.plans.catalog import load
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("linkloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    only = sys.argv[1:]
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        catalog[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
