"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one line of JSON.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (3 unless set); its figure is the median.  ``baseline`` holds
the same results by the plain Spark SQL text, in the same session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from weftline import catalogue  # noqa: E402
from weftline.queries.graphs import EDGES  # noqa: E402
from weftline.queries.registry import session  # noqa: E402

HEADLINE = [
    "agg_filter_group", "agg_frame", "join_inner_on", "join_inner_residual", "row_project_distinct", "set_except",
    "subgraph_S1", "subgraph_S2", "subgraph_S3", "subgraph_S4", "subgraph_S5", "subgraph_S6", "subgraph_S7", "subgraph_S8",
    "subgraph_C1", "subgraph_C2", "subgraph_C3", "subgraph_C4", "pattern_triangle",
    "analytic_I1_pagerank", "analytic_I2_components", "analytic_I3_shortest_hops", "analytic_G2I1_pagerank",
    "olap_O1", "olap_O2", "olap_O3", "olap_O4", "olap_O5", "olap_O6", "olap_O10", "olap_O11", "olap_O12",
    "workload_W1_star", "workload_W2_snowflake", "workload_W3_line", "workload_W4_tree", "workload_W5_cycle", "workload_W9_line_project", "workload_W10_line_count",
]

_O = "SELECT l_suppkey AS person_id, l_partkey AS movie_id FROM lineitem"
#: Plain formulations, as a user would write them, of queries for which ours plans otherwise.
PLAIN = {
    "subgraph_S1": "SELECT x.src AS a, count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src",
    "subgraph_S4": """SELECT ab.src AS a, count(*) AS n FROM e ab JOIN e bc ON ab.dst = bc.src JOIN e cd ON bc.dst = cd.src JOIN e da ON cd.dst = da.src AND da.dst = ab.src
        JOIN e ac ON ac.src = ab.src AND ac.dst = bc.dst JOIN e bd ON bd.src = bc.src AND bd.dst = cd.dst GROUP BY ab.src""",
    "olap_O6": f"""SELECT p_name AS movie_name, count(*) AS n FROM ({_O}) c JOIN part ON p_partkey = movie_id
        JOIN (SELECT DISTINCT l_partkey AS k, l_linenumber FROM lineitem) k ON k.k = movie_id JOIN supplier ON s_suppkey = person_id GROUP BY p_name""",
    "olap_O10": f"""SELECT p_name AS movie_name, count(*) AS n FROM ({_O}) a JOIN ({_O}) b ON a.person_id = b.person_id
        JOIN part ON p_partkey = a.movie_id GROUP BY p_name""",
}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("weftline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return round(median(times[1:]), 3)

    took = {name: timed(lambda name=name: catalogue.QUERIES[name](spark, folder)) for name in HEADLINE}
    session(spark, folder)
    spark.sql(EDGES).createOrReplaceTempView("e")
    plain = {name: timed(lambda text=text: spark.sql(text)) for name, text in PLAIN.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(folder.rstrip("/")), "runs": runs, "baseline": {"plain_spark_sql": plain},
            }
        )
    )


if __name__ == "__main__":
    main()
