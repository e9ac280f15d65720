"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then its median of ``RUNS`` runs counts; results are written to a no-op sink, so all rows are made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from quern import workload
from quern.operators import match, scd2
from quern.session import load, register, session

SF_DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), 3

SQL = {
    "limit": "SELECT * FROM lineitem LIMIT 100",
    "full_scan": "SELECT * FROM lineitem",
    "equality": "SELECT * FROM lineitem WHERE l_orderkey = 777",
    "range": "SELECT * FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 5000",
    "count": "SELECT count(*) AS n FROM lineitem",
    "sum": "SELECT sum(l_extendedprice) AS s FROM lineitem",
    "group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2",
    "group_order": "SELECT l_suppkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1 ORDER BY s DESC",
    "group_having": "SELECT l_partkey, avg(l_quantity) AS a FROM lineitem GROUP BY 1 HAVING count(*) > 30",
    "top10": "SELECT * FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10",
    "like": "SELECT p_partkey FROM part WHERE p_name LIKE '%ed%'",
    "row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
}
NAMED = ("agg_group_having_order", "join_multiway", "filter_exists", "scd2_initial", "scd2_changed", "match_word_similarity", "win_anomaly_zscore", "profile_columns")


def main() -> None:
    spark = session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    register(spark, SF_DIR)

    def delta(s, d):
        """All rows changed."""
        c = load(s, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_totalprice")
        spec = scd2.Scd2(key=("o_orderkey",))
        h = scd2.apply_scd2(c, None, spec, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        return scd2.apply_scd2(c.withColumn("o_totalprice", F.col("o_totalprice") + 1), h, spec, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))

    def jaro(s, d):
        rule = match.MatchRule("jw", "p_partkey", ("p_brand", "p_size"), ("p_name",), "jaro_winkler", ">=", 0.9)
        return match.match(load(s, d, "part"), [rule])

    todo = {k: (lambda s, d, q=q: s.sql(q)) for k, q in SQL.items()} | {k: workload.QUERIES[k] for k in NAMED} | {"scd2_delta_all_changed": delta, "match_jaro_winkler": jaro}
    took = {}
    for name, f in todo.items():
        times = []
        for _ in range(RUNS + 1):
            t = time.perf_counter()
            f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
