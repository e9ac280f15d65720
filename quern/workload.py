"""Registered queries of the engine's operators, each with its DuckDB text.

``_sql`` registers a query that is the same text in both dialects (or gives DuckDB's own); ``_frame`` one that is built with the
DataFrame API or by an operator.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, tables
from .operators import datamart, dml, match, mdm, profile, scd2
from .plans import engine, pipeline, templates, triggers
from .plans.store import Store
from .session import TABLES, load, register
from .sources import connectors, files, remote
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _sql(name: str, text: str, duck: str | None = None) -> None:
    words = set(re.findall(r"\w+", text))
    named = tuple(t for t in TABLES if t in words)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, named)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, duck or text


def _frame(name: str, duck: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if duck:
            ORACLE[name] = duck
        return f

    return add


def shared(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; a local one only for a local master."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
    return f"{base}/q-{uuid.uuid4().hex}"


# Aggregations
# Lines are summed by order before the join, on the key that the join shuffles by anyway.
_sql("agg_group_having_order", """
WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS r, sum(l_quantity) AS q FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY l_orderkey)
SELECT c_mktsegment, o_orderpriority, sum(n) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, round(sum(r), 2) AS revenue
FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderpriority HAVING sum(q) > 100 ORDER BY revenue DESC, 1, 2""", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY c_mktsegment, o_orderpriority HAVING sum(l_quantity) > 100 ORDER BY revenue DESC, 1, 2""")
_sql("agg_count_distinct", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(nullif(event_type, 'click')) AS not_click FROM events GROUP BY event_type")
_sql("agg_sum_avg_distinct", "SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS sd, round(avg(DISTINCT l_quantity), 4) AS ad, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag")
_sql("agg_minmax_text", "SELECT c_nationkey, min(c_name) AS lo, max(c_name) AS hi, min(c_acctbal) AS lo_bal, max(c_acctbal) AS hi_bal FROM customer GROUP BY c_nationkey")
_sql("agg_expr_over_agg", "SELECT l_returnflag, round(sum(l_extendedprice) - sum(l_discount * l_extendedprice), 2) AS net, round(avg(l_tax) * 100, 4) AS tax FROM lineitem GROUP BY l_returnflag")
_sql("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
_sql("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
_sql("agg_null_group", "SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'P')")
_sql("agg_having_unselected", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 1000")
_sql("agg_group_by_ordinal_alias", "SELECT substr(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY p")
_sql("agg_string_agg_distinct", "SELECT n_regionkey, concat_ws('~', array_sort(collect_set(n_name))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, '~' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_sql("agg_pivot_case", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_orderpriority")
_frame("agg_approx_distinct")(lambda s, d: load(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median")))

# Joins
_sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
for _kind in ("LEFT", "RIGHT", "FULL"):
    _sql(f"join_{_kind.lower()}", f"SELECT c_custkey, o_orderkey, s_suppkey FROM customer {_kind} JOIN orders o ON c_custkey = o_custkey {_kind} JOIN supplier ON s_suppkey = o_orderkey AND s_acctbal > 0")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_frame("join_self", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")(
    lambda s, d: match.pairs(load(s, d, "customer"), "c_custkey", ("c_nationkey", "c_mktsegment")).selectExpr("a_id AS a", "b_id AS b")
)
_sql("join_multiway", """
SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY r_name, n_name""")
_sql("join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > n.n_nationkey * 300")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderpriority = '1-URGENT')")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 300000)")
_sql("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
_sql("join_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate)")

# Filters, predicates, projections
_sql("filter_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <> 2000 AND NOT (o_orderstatus = 'O' OR o_orderkey <= 10)")
_sql("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 20000 AND o_orderkey NOT BETWEEN 100 AND 200")
_sql("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
_sql("filter_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_sql("filter_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'X%'")
_sql("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%ING' AND c_name NOT ILIKE '%99'")
_sql("filter_is_null", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NULL AS gone FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL")
_sql("filter_null_logic", "SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'O')")
_sql("filter_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders")
_sql("filter_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30)")
_sql("filter_not_exists", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9900)")
_sql("filter_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_sql("proj_star", "SELECT * FROM nation")
_sql("proj_qualified_star", "SELECT n.*, r.r_name AS region_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("proj_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql("proj_cast", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS STRING) AS txt, CAST('1.50' AS DECIMAL(10,2)) AS money FROM orders", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS VARCHAR) AS txt, CAST('1.50' AS DECIMAL(10,2)) AS money FROM orders")
_sql("proj_arith", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice - l_tax, 4) AS a, -l_quantity AS neg, try_divide(l_extendedprice, l_quantity - 1) AS per, try_mod(l_partkey, l_suppkey - 1) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice - l_tax, 4) AS a, -l_quantity AS neg, CASE WHEN l_quantity <> 1 THEN l_extendedprice / (l_quantity - 1) END AS per, CASE WHEN l_suppkey <> 1 THEN l_partkey % (l_suppkey - 1) END AS m FROM lineitem")
_sql("proj_concat_operator", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, c_name || nullif(c_mktsegment, 'BUILDING') AS maybe FROM customer")
_sql("proj_literals", "SELECT 1 AS i, 'it''s' AS s, TRUE AS t, NULL IS NULL AS n, 'a' || 'b' AS ab")
_sql("proj_no_from", "SELECT 1 + 2 AS three, upper('x') AS x")
_sql("derived_table", "SELECT a.seg, a.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) a WHERE a.n > 1")
_sql("cte_chain", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT k, s FROM a WHERE s > (SELECT avg(s) FROM a)) SELECT k, round(s, 2) AS s FROM b UNION ALL SELECT -1, round(max(s), 2) FROM a")
_sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n, n * n AS sq FROM t")

# Set operations
_sql("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_sql("set_chain", "SELECT n_nationkey AS k FROM nation UNION SELECT 100 INTERSECT SELECT 100 EXCEPT SELECT 3")

# Windows
_sql("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn FROM orders")
_sql("win_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d FROM customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS d FROM customer")
_sql("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0D) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_sql("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_sql("win_running", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, round(avg(value) OVER (PARTITION BY user_id), 4) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_sql("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 3) AS s FROM events")
_sql("win_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM customer")
_sql("win_expr", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice, 1, o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS delta FROM orders")
_sql("win_ntile_percent", "SELECT o_orderkey, ntile(4) OVER w AS q, percent_rank() OVER w AS p, cume_dist() OVER w AS c, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)", "SELECT o_orderkey, CAST(ntile(4) OVER w AS INT) AS q, percent_rank() OVER w AS p, cume_dist() OVER w AS c, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)")


_ZSCORE = """
SELECT event_id, round(z, 4) AS z, abs(z) > 3 AS is_anomaly FROM (SELECT event_id,
  CASE WHEN count(value) OVER w < 2 THEN 0.0 ELSE (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-10) END AS z
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))"""


def _zscore(chunk):
    return lambda s, d: profile.anomalies(load(s, d, "events"), ["event_type"], ["ts", "event_id"], "value", split=F.date_trunc("HOUR", "ts"), chunk=chunk).select("event_id", F.round("z", 4).alias("z"), "is_anomaly")


_frame("win_anomaly_zscore", _ZSCORE)(_zscore(500_000))
_frame("win_anomaly_chunks", _ZSCORE)(_zscore(500))


# Sort and limit
_sql("sort_multi", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC LIMIT 50")
_sql("sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st FROM orders ORDER BY st ASC NULLS LAST, o_orderkey DESC LIMIT 40")
_sql("sort_ordinal", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
_sql("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 30 ROWS FETCH FIRST 15 ROWS ONLY")
_sql("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("sort_topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")

# Scalar functions
_sql("fn_string_case_trim", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, trim(concat('  ', c_name, ' ')) AS t, ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, reverse(c_name) AS r FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INT) AS n, trim('  ' || c_name || ' ') AS t, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, reverse(c_name) AS r FROM customer")
_sql("fn_string_substr", "SELECT c_custkey, substr(c_name, 3, 4) AS s, substr(c_name, 200) AS past, left(c_name, 3) AS l, right(c_name, 3) AS r, repeat(c_mktsegment, 2) AS rep FROM customer")
_sql("fn_string_pad_find", "SELECT c_custkey, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 4, '*') AS rp, instr(c_name, '0') AS pos, replace(c_name, '0', 'o') AS rpl FROM customer", "SELECT c_custkey, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 4, '*') AS rp, CAST(instr(c_name, '0') AS INT) AS pos, replace(c_name, '0', 'o') AS rpl FROM customer")
_sql("fn_string_concat", "SELECT c_custkey, concat_ws('', c_name, nullif(c_mktsegment, 'BUILDING'), 'x') AS skip, concat_ws('-', nullif(c_name, ''), c_mktsegment) AS ws, md5(c_name) AS h, split_part(c_name, '#', 2) AS part FROM customer")
_sql("fn_math", "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice, 1) AS r, round(sqrt(p_size), 6) AS q, round(exp(p_size / 10.0D), 4) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, power(p_size, 2) AS p, p_size % 7 AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, round(sqrt(p_size), 6) AS q, round(exp(p_size / 10.0), 4) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, CAST(power(p_size, 2) AS DOUBLE) AS p, p_size % 7 AS m FROM part")
_sql("fn_cond", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS c, if(o_totalprice > 100000, 'hi', 'lo') AS i, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey, CAST(NULL AS BIGINT)) AS l FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS c, CASE WHEN o_totalprice > 100000 THEN 'hi' ELSE 'lo' END AS i, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
_sql("fn_convert", "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS num, try_cast(o_orderpriority AS DOUBLE) AS bad, lower(o_orderstatus) IN ('true', 'o') AS flag FROM orders")
_sql("fn_date", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, year(o_orderdate) AS y, date_trunc('MONTH', o_orderdate) AS m, datediff(DATE '1998-12-31', CAST(o_orderdate AS DATE)) AS age FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INT) AS y, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(DATE '1998-12-31' - CAST(o_orderdate AS DATE) AS INT) AS age FROM orders")
_sql("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
@_frame("fn_levenshtein", "SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def _(spark, d):
    return _part_pairs(spark, d, "levenshtein").select("a", "b", F.col("v").cast("int").alias("d"))


_WORD_SIMILARITY = "CASE WHEN length({q}) < 3 AND length({d}) < 3 THEN CAST(lower({q}) = lower({d}) AS DOUBLE) WHEN length({q}) < 3 THEN 0.0 ELSE len(list_filter(generate_series(1, length({q}) - 2), lambda i: instr({d}, substr({q}, CAST(i AS BIGINT), 3)) > 0)) / CAST(length({q}) - 2 AS DOUBLE) END"
_PAIRS = "part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


def _part_pairs(spark, d, metric):
    return match.pairs(load(spark, d, "part"), "p_partkey", ("p_brand", "p_size"), "p_name", metric).withColumnsRenamed({"a_id": "a", "b_id": "b"})


@_frame("fn_word_similarity", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({_WORD_SIMILARITY.format(q='a.p_name', d='b.p_name')}, 6) AS s FROM {_PAIRS}")
def _(spark, d):
    return _part_pairs(spark, d, "word_similarity").select("a", "b", F.round("v", 6).alias("s"))


# DuckDB rounds the halved transpositions down, so there is no SQL; tests hold it against brute force.
@_frame("fn_jaro_winkler")
def _(spark, d):
    return _part_pairs(spark, d, "jaro_winkler").select("a", "b", F.round("v", 6).alias("s"))


@_frame("fn_normalize", "SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '  X'), '[ \\t\\n\\r]+', ' ', 'g')) AS name, regexp_replace(c_name, '[^0-9]', '', 'g') AS inn FROM customer")
def _(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", scalar.normalize_name(F.concat(F.lit("  "), "c_name", F.lit("  X"))).alias("name"), scalar.normalize_inn(F.col("c_name")).alias("inn"))


_sql("fn_pi_random", "SELECT round(pi(), 10) AS p, r >= 0 AND r < 1 AS within FROM (SELECT rand() AS r)", "SELECT round(pi(), 10) AS p, r >= 0 AND r < 1 AS within FROM (SELECT random() AS r)")
_sql("fn_now", "SELECT unix_timestamp() BETWEEN 1700000000 AND 4000000000 AS plausible, now() = current_timestamp() AS same, cast(current_date() AS STRING) = substr(cast(current_timestamp() AS STRING), 1, 10) AS day", "SELECT epoch(now()) BETWEEN 1700000000 AND 4000000000 AS plausible, now() = current_timestamp AS same, TRUE AS day")
_sql("fn_arrays", "SELECT c_custkey, size(parts) AS n, parts[0] AS first, array_contains(parts, 'Customer') AS has, array_join(reverse(parts), '/') AS back FROM (SELECT c_custkey, split(c_name, '#') AS parts FROM customer)", "SELECT c_custkey, CAST(len(parts) AS INT) AS n, parts[1] AS first, list_contains(parts, 'Customer') AS has, array_to_string(list_reverse(parts), '/') AS back FROM (SELECT c_custkey, string_split(c_name, '#') AS parts FROM customer)")
_sql("fn_maps", "SELECT c_mktsegment, element_at(m, 'lo') AS lo, element_at(m, 'hi') AS hi, cast(size(m) AS BIGINT) AS n FROM (SELECT c_mktsegment, map('lo', min(c_custkey), 'hi', max(c_custkey)) AS m FROM customer GROUP BY c_mktsegment)", "SELECT c_mktsegment, min(c_custkey) AS lo, max(c_custkey) AS hi, CAST(2 AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")


@_frame("fn_helpers", "SELECT c_custkey, substr(c_name, 1, 4) AS sub, substr(c_name, 3) AS rest, regexp_replace(c_name, '#.*', '') AS part, CAST(floor(c_acctbal) AS BIGINT) AS whole, CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS per, c_nationkey = 1 AS flag, CAST(sign(c_acctbal) AS INT) AS sg, c_mktsegment AS trimmed FROM customer")
def _(spark, d):
    c, n, b = F.col("c_name"), F.col("c_nationkey"), F.col("c_acctbal")
    return load(spark, d, "customer").select("c_custkey", scalar.substr(c, -3, 4).alias("sub"), scalar.substr(c, 3, -1).alias("rest"), scalar.split_part(F.concat(F.lit("##"), c), "#", 1).alias("part"), scalar.to_int(b.cast("string")).alias("whole"), scalar.safe_divide(b, n).alias("per"), scalar.to_bool(n.cast("string")).alias("flag"), F.signum(b).cast("int").alias("sg"), scalar.trim_blank(F.concat(F.lit("\t "), "c_mktsegment", F.lit(" \t"))).alias("trimmed"))


@_frame("fn_table_function", "SELECT c_custkey, CAST(i AS INT) AS pos, substr(c_name, i, 3) AS gram FROM (SELECT c_custkey, c_name, unnest(generate_series(1, length(c_name) - 2)) AS i FROM customer)")
def _(spark, d):
    register(spark, d, ("customer",))
    tables.register_tables(spark)
    return spark.sql("SELECT c_custkey, pos, gram FROM customer, LATERAL trigrams(c_name)")


# Master data
_SNAP2 = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END AS is_deleted
  FROM customer WHERE c_custkey % 10 <> 2 UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment, 0 FROM customer WHERE c_custkey % 10 = 3"""
_T1, _T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _history(spark, d, spec, again=False):
    register(spark, d, ("customer",))
    first = spark.sql("SELECT c_custkey, c_name, c_mktsegment, 0 AS is_deleted FROM customer")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    h = scd2.apply_scd2(first, None, spec, at(_T1))
    h = scd2.apply_scd2(spark.sql(_SNAP2), h, spec, at(_T2))
    return scd2.apply_scd2(spark.sql(_SNAP2), h, spec, at("2024-03-01 00:00:00")) if again else h


_SCD2_SQL = f"""
WITH s1 AS (SELECT c_custkey, c_name, c_mktsegment FROM customer), s2 AS ({_SNAP2}),
h AS (SELECT s1.*, CASE WHEN s2.is_deleted = 1 OR (s2.c_custkey IS NOT NULL AND s2.c_mktsegment IS DISTINCT FROM s1.c_mktsegment) THEN TIMESTAMP '{_T2}' END AS valid_to FROM s1 LEFT JOIN s2 USING (c_custkey))
SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '{_T1}' AS valid_from, valid_to, valid_to IS NULL AS is_current, CAST(1 AS BIGINT) AS version FROM h
UNION ALL SELECT s2.c_custkey, s2.c_name, s2.c_mktsegment, TIMESTAMP '{_T2}', NULL, TRUE, CASE WHEN s1.c_custkey IS NULL THEN 1 ELSE 2 END
FROM s2 LEFT JOIN s1 USING (c_custkey) WHERE s2.is_deleted = 0 AND (s1.c_custkey IS NULL OR s1.c_mktsegment IS DISTINCT FROM s2.c_mktsegment)"""
_SPEC = scd2.Scd2(key=("c_custkey",), deleted="is_deleted", version="version")
_frame("scd2_initial", f"SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '{_T1}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current, CAST(1 AS BIGINT) AS version FROM customer")(
    lambda s, d: scd2.apply_scd2(load(s, d, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "0 AS is_deleted"), None, _SPEC, F.lit(_T1).cast("timestamp_ntz"))
)
_frame("scd2_changed", _SCD2_SQL)(lambda s, d: _history(s, d, _SPEC))
_frame("scd2_idempotent", _SCD2_SQL)(lambda s, d: _history(s, d, _SPEC, again=True))
_frame("scd2_hash", f"SELECT c_custkey, c_name, c_mktsegment, valid_from, valid_to, is_current, md5(concat(c_name, chr(31), c_mktsegment)) AS row_hash FROM ({_SCD2_SQL})")(
    lambda s, d: _history(s, d, scd2.Scd2(key=("c_custkey",), deleted="is_deleted", hash="row_hash", compare=("c_name", "c_mktsegment")))
)


@_frame("match_word_similarity", f"SELECT a.c_custkey AS id_a, b.c_custkey AS id_b, 'by_name' AS rule_name, round({_WORD_SIMILARITY.format(q='lower(a.c_name)', d='lower(b.c_name)')}, 6) AS metric_value FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE {_WORD_SIMILARITY.format(q='lower(a.c_name)', d='lower(b.c_name)')} >= 0.85")
def _(spark, d):
    rule = match.MatchRule("by_name", "c_custkey", ("c_nationkey", "c_mktsegment"), ("c_name",), threshold=0.85)
    return match.match(load(spark, d, "customer"), [rule]).withColumn("metric_value", F.round("metric_value", 6))


@_frame("match_levenshtein", "SELECT a.c_custkey AS id_a, b.c_custkey AS id_b, 'lev' AS rule_name, CAST(levenshtein(regexp_replace(a.c_name, '[^0-9]', '', 'g'), regexp_replace(b.c_name, '[^0-9]', '', 'g')) AS DOUBLE) AS metric_value FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE levenshtein(regexp_replace(a.c_name, '[^0-9]', '', 'g'), regexp_replace(b.c_name, '[^0-9]', '', 'g')) < 2")
def _(spark, d):
    return match.match(load(spark, d, "customer"), [match.MatchRule("lev", "c_custkey", ("c_nationkey",), ("c_name",), "levenshtein", "<", 2, "inn")])


@_frame("mdm_accept", "WITH p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey) SELECT id, min(least(id, other)) AS canonical_id FROM (SELECT a AS id, b AS other FROM p UNION ALL SELECT b, a FROM p) GROUP BY id")
def _(spark, d):
    return mdm.accept_matches(match.match(load(spark, d, "orders"), [match.MatchRule("eq", "o_orderkey", ("o_custkey", "o_orderpriority"), ("o_orderpriority",), "equal", ">=", 1.0, "none")]))


@_frame("mdm_docs_agg", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '~' ORDER BY first) AS numbers FROM (SELECT l_orderkey, l_partkey, min((l_linenumber, CAST(l_partkey AS VARCHAR))) AS first FROM lineitem GROUP BY l_orderkey, l_partkey) GROUP BY l_orderkey")
def _(spark, d):
    return mdm.aggregate_documents(load(spark, d, "lineitem").withColumn("l_partkey", F.col("l_partkey").cast("string")), "l_orderkey", "l_partkey", "l_linenumber")


@_frame("mdm_keys", "SELECT c_custkey AS source_id, 'crm' AS system_name, '01::FIO+BD::' || c_nationkey || ':' || lower(c_name) || ':' || c_mktsegment AS rule_value FROM customer UNION ALL SELECT c_custkey, 'crm', '02::DUL::' || unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) FROM customer UNION ALL SELECT c_custkey, 'crm', '03::INN::' || regexp_replace(c_name, '[^0-9]', '', 'g') FROM customer WHERE regexp_replace(c_name, '[^0-9]', '', 'g') <> ''")
def _(spark, d):
    c = load(spark, d, "customer").withColumns({"numbers": F.concat_ws("~", "c_mktsegment", F.lit(""), F.col("c_nationkey").cast("string")), "inn": scalar.normalize_inn(F.col("c_name")), "first": F.lower("c_name"), "system": F.lit("crm")})
    return mdm.match_keys(c, "c_custkey", "system", "first", "c_mktsegment", "c_nationkey", "numbers", "inn")


@_frame("mdm_clean", "SELECT c_custkey, lower(trim(c_name)) AS c_name, upper(regexp_replace(c_mktsegment || '-' || c_custkey, '[^A-Za-z0-9]', '', 'g')) AS number FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def _(spark, d):
    c = load(spark, d, "customer").withColumn("number", F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")))
    return mdm.clean_person(mdm.clean_document(c, "number", "c_mktsegment", ["BUILDING", "FURNITURE"]), ["c_name"]).select("c_custkey", "c_name", "number")


_frame("golden_latest_per_key", "SELECT o_custkey, o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate)")(
    lambda s, d: mdm.latest_per_key(load(s, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")
)


@_frame("classify_messages", "SELECT c_custkey, CASE WHEN cat = 'P' AND (grp IS NULL OR grp = '5') THEN 'PHYSICAL' WHEN cat = 'C' OR (cat = 'P' AND grp = '0') THEN 'LEGAL' ELSE 'UNKNOWN' END AS party_type, CASE WHEN cat = 'P' AND (grp IS NULL OR grp = '5') THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END END AS segment, CASE WHEN cat = 'C' OR (cat = 'P' AND grp = '0') THEN c_name END AS company FROM (SELECT c_custkey, c_name, c_mktsegment, CASE c_nationkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'X' END AS cat, CASE c_custkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '0' END AS grp FROM customer)")
def _(spark, d):
    fields = {"CCAT": "CASE c_nationkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'X' END", "SERVICE_GROUP": "CASE c_custkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '0' END", "SEG": "c_mktsegment", "NAME": "c_name"}
    one = F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])
    # Every second message is wrapped in a list.
    m = load(spark, d, "customer").withColumn("value", F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.array(one).alias("ows.CLIENT")))).otherwise(F.to_json(one)))
    return mdm.map_messages(m, "value", "ows.CLIENT", {"PHYSICAL": {"SEG": "segment"}, "LEGAL": {"NAME": "company"}}, {"SEG": {"BUILDING": "B"}}, "CCAT", "SERVICE_GROUP").select("c_custkey", "party_type", "segment", "company")


_frame("kafka_json", "SELECT event_id AS kafka_offset, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: remote.parse_messages(load(s, d, "events").select(F.col("event_id").alias("offset"), F.col("props").cast("binary").alias("value")), "k bigint")
)
_frame("kafka_csv", "SELECT event_id AS kafka_offset, user_id, event_type FROM events")(
    lambda s, d: remote.parse_messages(load(s, d, "events").select(F.col("event_id").alias("offset"), F.concat_ws(",", F.col("user_id").cast("string"), "event_type").cast("binary").alias("value")), "user_id bigint, event_type string", "csv")
)


@_frame("mdm_consents", "SELECT o_orderkey AS agreement_id, CASE o_orderkey % 3 WHEN 0 THEN 'MFCMARKETING' WHEN 1 THEN 'ESIACREDIT' ELSE 'PERSONALDATA' END AS agreement_type_cd, c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'crm' || c_custkey ELSE 'UNDEFINED' END AS crm_id, 'flg_by_inn=' || CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END || '|flg_by_duls=N|flg_by_phones=N|flg_by_birth_date=N|flg_by_keys=N' AS verified_by FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'")
def _(spark, d):
    consents = load(spark, d, "orders").selectExpr("o_orderkey AS agreement_id", "cast(o_orderkey % 3 AS STRING) AS agreement_type_cd", "o_custkey AS owner_id", "CASE WHEN o_orderstatus = 'P' THEN 'gone' WHEN o_orderstatus = 'F' THEN '' END AS deleted_ts", "CASE WHEN o_orderstatus = 'F' THEN 'Y' END AS flg_by_inn")
    parties = load(spark, d, "customer").selectExpr("c_custkey AS owner_id", "c_custkey + 100 AS party_id", "c_name", "c_nationkey")
    masters = parties.filter("c_nationkey % 2 = 0").selectExpr("party_id", "concat('crm', owner_id) AS crm_id", "'' AS mdm_id")
    return mdm.link_consents(consents, parties, masters, F.lit("2024-01-01")).select("agreement_id", "agreement_type_cd", "c_name", "crm_id", "verified_by")


# Changes, transactions, datamarts, pipelines
_frame("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")(
    lambda s, d: dml.update(load(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), {"c_mktsegment": "DEBT"}, "c_acctbal < 0").drop("c_acctbal")
)
_frame("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'O', FALSE)")(lambda s, d: dml.delete(load(s, d, "orders"), "nullif(o_orderstatus, 'P') = 'O'").select("o_orderkey"))
_frame("dml_upsert", "SELECT c_custkey, 'new' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 5000000, 'new' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")(
    lambda s, d: dml.upsert(
        load(s, d, "customer").select("c_custkey", "c_mktsegment"),
        load(s, d, "customer").filter("c_custkey % 3 < 2").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 5000000).alias("c_custkey"), F.lit("new").alias("c_mktsegment")),
        ["c_custkey"],
    )
)


@_frame("txn_commit", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE s_name END AS s_name FROM supplier WHERE NOT (s_nationkey = 3) UNION ALL SELECT -1, 'added' UNION ALL SELECT n_nationkey + 1000000, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    """One transaction over two tables, by statements; the second table's rows are read after the commit."""
    db = dml.Database(spark, shared(spark))
    db.commit({"sup": load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "nat": load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")})
    e = engine.Engine(spark, database=db)
    for text in ("BEGIN", "UPDATE sup SET s_name = 'rich' WHERE s_acctbal > 5000", "DELETE FROM sup WHERE s_nationkey = 3", "INSERT INTO sup (s_suppkey, s_name) VALUES (-1, 'added')", "DELETE FROM nat WHERE n_regionkey <> 1", "COMMIT"):
        e.execute(text)
    return e.sql("SELECT s_suppkey, s_name FROM sup UNION ALL SELECT n_nationkey + 1000000, n_name FROM nat")


@_frame("index_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(spark, d):
    """A table clustered by a key: point and range filters reach its files' statistics."""
    db = dml.Database(spark, shared(spark))
    db.write("ord", load(spark, d, "orders"), cluster_by=("o_orderkey",))
    o = db.read("ord").select("o_orderkey", "o_totalprice")
    return o.filter("o_orderkey BETWEEN 100 AND 5000").unionByName(o.filter("o_orderkey = 77"))


@_frame("ingest_csv_append", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), NULL FROM region")
def _(spark, d):
    path = shared(spark)
    files.write_csv(load(spark, d, "nation").select("n_nationkey", "n_name"), f"{path}/a")
    files.write_csv(load(spark, d, "region").selectExpr("r_regionkey AS n_nationkey"), f"{path}/b")
    e = engine.Engine(spark, database=dml.Database(spark, f"{path}/db"))
    e.ingest_csv("nat", f"{path}/a")
    e.ingest_csv("nat", f"{path}/b")
    return e.sql("SELECT * FROM nat")


@_frame("ingest_parquet_replace", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    e = engine.Engine(spark, database=dml.Database(spark, shared(spark)))
    e.ingest_parquet("t", f"{d}/nation.parquet")
    e.ingest_parquet("t", f"{d}/region.parquet")
    return e.sql("SELECT r_regionkey, r_name FROM t")


@_frame("saved_result", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    e = engine.Engine(spark, database=dml.Database(spark, shared(spark)))
    e.register("customer", f"{d}/customer.parquet")
    return e.result(e.save_result("segments", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"))


@_frame("jdbc_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_regionkey = 3")
def _(spark, d):
    """Keyed writes to a database that Spark's own driver holds in memory."""
    db = connectors.open_connector(spark, "jdbc", url=f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true")
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    db.write(n.filter("n_regionkey <> 3").select("n_nationkey", "n_name"), "nations", mode="overwrite")
    new = n.filter("n_regionkey = 2").selectExpr("n_nationkey", "concat(upper(n_name), '!') AS n_name").unionByName(n.filter("n_regionkey = 3").selectExpr("n_nationkey + 1000 AS n_nationkey", "n_name"))
    db.write(new, "nations", key=("n_nationkey",))
    db.write(new, "nations", key=("n_nationkey",))
    return db.read("nations")


@_frame("pipeline_yaml", "SELECT a.c_custkey AS id_a, b.c_custkey AS id_b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND lower(a.c_mktsegment) = lower(b.c_mktsegment) WHERE a.c_acctbal > 9000 AND b.c_acctbal > 9000")
def _(spark, d):
    """Source, match, history and sink steps from YAML."""
    path = shared(spark)
    text = """
name: mdm
vars: {low: 9000}
steps:
- {id: customers, source: {connector: parquet, path: '{{ dir }}/customer.parquet'}, target: customers, cursor: c_custkey}
- {id: rich, sql: 'SELECT c_custkey, c_nationkey, c_mktsegment FROM {@prev} WHERE c_acctbal > {low}', deps: [customers]}
- id: pairs
  sql: SELECT * FROM rich
  deps: [rich]
  match: [{name: seg, id_column: c_custkey, scan_columns: [c_nationkey], test_columns: [c_mktsegment], metric: equal, threshold: 1.0}]
- {id: history, sql: 'SELECT c_custkey, c_mktsegment FROM rich', deps: [rich], scd2: {key: [c_custkey]}, target: history}
- {id: out, sql: 'SELECT id_a, id_b FROM pairs WHERE id_a IN (SELECT c_custkey FROM history WHERE is_current)', deps: [pairs, history], sink: {connector: parquet, path: '{{ out }}'}, mode: append}
"""
    p = pipeline.Pipeline.from_yaml(text, {"dir": d, "out": f"{path}/out"}, database=dml.Database(spark, f"{path}/db"), state=Store(spark, f"{path}/state"))
    p.run(spark)
    return spark.read.parquet(f"{path}/out")


@_frame("pipeline_incremental", "SELECT event_id, user_id FROM events")
def _(spark, d):
    """Two runs of an incremental step: the second reads only what came since the first and appends it."""
    path = shared(spark)
    e = load(spark, d, "events").select("event_id", "user_id")
    mid = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    db, state = dml.Database(spark, f"{path}/db"), Store(spark, f"{path}/state")
    for seen in (e.filter(F.col("event_id") <= mid), e):
        pipeline.Pipeline("inc", [pipeline.Step("read", source=lambda s, seen=seen: seen, cursor="event_id", target="rows", mode="append")], database=db, state=state).run(spark)
    return db.read("rows")


@_frame("datamart_refresh", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    register(spark, d, ("customer",))
    return datamart.Datamart("segments", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY c_mktsegment", shared(spark)).refresh(spark)


@_frame("pipeline_dag", "SELECT n_name, n_customers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) JOIN nation ON n_nationkey = c_nationkey WHERE n_customers >= (SELECT min(n_regionkey) FROM nation)")
def _(spark, d):
    register(spark, d, ("customer", "nation"))
    steps = [
        pipeline.Step("joined", sql="SELECT n_name, n_customers FROM counts JOIN nation ON n_nationkey = c_nationkey WHERE n_customers >= {@step:least:k}", deps=("counts", "least")),
        pipeline.Step("least", sql="SELECT min(n_regionkey) AS k FROM nation"),
        pipeline.Step("counts", fn=lambda df: df.groupBy("c_nationkey").agg(F.count("*").alias("n_customers")), deps=("positive",)),
        pipeline.Step("positive", sql="SELECT * FROM customer WHERE c_acctbal > {floor}"),
    ]
    return pipeline.Pipeline("demo", steps, {"floor": 0}).run(spark, only="joined")


@_frame("template_params", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5")
def _(spark, d):
    register(spark, d, ("customer",))
    return spark.sql(templates.render("SELECT c_custkey FROM {t_raw} WHERE c_mktsegment = {seg} AND c_acctbal > {low}", {"t": "customer", "seg": "BUILDING", "low": 100.5}))


@_frame("named_params", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, d):
    e = engine.Engine(spark)
    e.register("orders", f"{d}/orders.parquet")
    return e.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :st AND o_totalprice > :low", {"st": "F", "low": 100000})


@_frame("positional_params", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, d):
    e = engine.Engine(spark)
    e.register("orders", f"{d}/orders.parquet")
    return e.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = $2 AND o_totalprice > $1", [100000, "F"])


@_frame("rls_filter", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_custkey = 7)")
def _(spark, d):
    e = engine.Engine(spark, engine.Policy({"orders": "o_custkey = {user_id}"}, (("analyst", "ord*", frozenset({"select"})),)))
    e.register("orders", f"{d}/orders.parquet")
    return e.sql("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", principal=engine.Principal("7", "analyst"))


@_frame("incremental_watermark", "SELECT event_id, user_id FROM events WHERE event_id > 500")
def _(spark, d):
    return pipeline.incremental(load(spark, d, "events"), "event_id", 500)[0].select("event_id", "user_id")


@_frame("catalog_columns", "SELECT 'nation' AS table_name, name AS column_name, CAST(cid + 1 AS INT) AS ordinal_position FROM pragma_table_info('nation') UNION ALL SELECT 'region', name, CAST(cid + 1 AS INT) FROM pragma_table_info('region')")
def _(spark, d):
    e = engine.Engine(spark)
    for t in ("nation", "region"):
        e.register(t, f"{d}/{t}.parquet")
    e.information_schema()
    return e.sql("SELECT c.table_name, column_name, ordinal_position FROM information_schema_columns c JOIN information_schema_tables t ON c.table_name = t.table_name")


@_frame("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def _(spark, d):
    return profile.profile(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@_frame("quality_checks", "SELECT 'key' AS check_name, count(*) AS n_rows, count(o_orderkey) - count(DISTINCT o_orderkey) AS n_failed, count(o_orderkey) = count(DISTINCT o_orderkey) AS passed FROM orders UNION ALL SELECT 'price', count(*), count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 300000), count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 300000) = 0 FROM orders UNION ALL SELECT 'prio', count(*), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]')), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]')) = 0 FROM orders UNION ALL SELECT 'present', count(*), count(*) FILTER (o_orderstatus IS NULL), count(*) FILTER (o_orderstatus IS NULL) = 0 FROM orders UNION ALL SELECT 'own', count(*), count(*) FILTER (NOT o_orderkey > o_custkey), count(*) FILTER (NOT o_orderkey > o_custkey) = 0 FROM orders")
def _(spark, d):
    c = profile.Check
    return profile.run_checks(load(spark, d, "orders"), [c("key", "UNIQUE", "o_orderkey"), c("price", "RANGE", "o_totalprice", (1000, 300000)), c("prio", "REGEX", "o_orderpriority", ("^[1-4]",)), c("present", "NOT_NULL", "o_orderstatus"), c("own", "CUSTOM", "", ("o_orderkey > o_custkey",))])


# Files and streams
@_frame("csv_roundtrip_nulls", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, nullif(lang, 'en') AS lang, CASE WHEN lang = 'de' THEN '' ELSE source END AS source FROM documents")
def _(spark, d):
    path = shared(spark)
    docs = load(spark, d, "documents").selectExpr("cast(doc_id AS STRING) AS doc_id", "text", "nullif(lang, 'en') AS lang", "CASE WHEN lang = 'de' THEN '' ELSE source END AS source")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, ",", strict=True)


@_frame("csv_lines", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def _(spark, d):
    path = shared(spark)
    files.write_csv(load(spark, d, "customer").selectExpr("c_custkey", "c_name", "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment"), path)
    return files.read_csv(spark, path, strict=True, lines=True)


@_frame("parquet_roundtrip", "SELECT * FROM part")
def _(spark, d):
    path = shared(spark)
    load(spark, d, "part").write.parquet(path)
    return spark.read.parquet(f"{path}/*.parquet")


@_frame("xml_roundtrip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = shared(spark)
    files.write_xml(load(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return files.read_xml(spark, path, "row").select("n_nationkey", "n_name")


def _stream(spark, d, build):
    """Runs a streaming query over the events, which arrive in four files one after the other, and gives what it wrote."""
    path = shared(spark)
    e = load(spark, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        low, high = (F.lit(lo + (hi - lo) * j / 4).cast("timestamp_ntz") for j in (k, k + 1))
        part = e.filter((F.col("ts") >= low) & ((F.col("ts") <= high) if k == 3 else (F.col("ts") < high)))
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = build(events.file_stream(spark, f"{path}/in", e.schema, files_per_trigger=1))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


_WINDOWED = "SELECT time_bucket(INTERVAL '{size}', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"
_frame("stream_tumbling_batch", _WINDOWED.format(size="1 hour"))(lambda s, d: events.windowed(load(s, d, "events"), "ts", "value", ["event_type"], "1 hour").withColumn("total", F.round("total", 3)))
_frame("stream_sliding_batch", "SELECT window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2")(
    lambda s, d: events.windowed(load(s, d, "events"), "ts", "value", ["event_type"], "1 hour", "30 minutes").withColumn("total", F.round("total", 3))
)
_frame("stream_session_batch", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM n GROUP BY user_id, k")(
    lambda s, d: events.sessions(load(s, d, "events"), "ts", "user_id", "30 minutes")
)


@_frame("stream_file_incremental", "SELECT event_id, user_id, event_type FROM events WHERE value > 10")
def _(spark, d):
    return _stream(spark, d, lambda e: e.filter("value > 10").select("event_id", "user_id", "event_type"))


@_frame("stream_dedup", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    return _stream(spark, d, lambda e: events.deduplicated(e.unionByName(e), "ts", ["event_id"], "1 day").select("event_id"))


@_frame("stream_tumbling", f"SELECT * FROM ({_WINDOWED.format(size='1 hour')}) WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def _(spark, d):
    return _stream(spark, d, lambda e: events.windowed(e, "ts", "value", ["event_type"], "1 hour", late="2 hours")).withColumn("total", F.round("total", 3))


@_frame("cdc_apply", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'U2' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 2 UNION ALL SELECT c_custkey + 9000000, 'I' FROM customer WHERE c_custkey % 4 = 3")
def _(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    one = lambda rows, op, seg, lsn: rows.select("c_custkey", F.lit(seg).alias("c_mktsegment"), F.lit(op).alias("op"), F.lit(lsn).alias("lsn"))
    changes = one(c.filter("c_custkey % 4 = 1"), "UPDATE", "U1", 1).unionByName(one(c.filter("c_custkey % 4 = 1"), "UPDATE", "U2", 2)).unionByName(one(c.filter("c_custkey % 4 = 2"), "DELETE", "", 3)).unionByName(one(c.filter("c_custkey % 4 = 3").withColumn("c_custkey", F.col("c_custkey") + 9000000), "INSERT", "I", 4))
    return events.apply_changes(c, changes, ["c_custkey"])


@_frame("stream_sliding", "SELECT * FROM (SELECT window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2) WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def _(spark, d):
    return _stream(spark, d, lambda e: events.windowed(e, "ts", "value", ["event_type"], "1 hour", "30 minutes", late="2 hours")).withColumn("total", F.round("total", 3))


@_frame("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def _(spark, d):
    return _stream(spark, d, lambda e: events.sessions(e, "ts", "user_id", "30 minutes", late="2 hours"))


@_frame("stream_join", "SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1 hour'")
def _(spark, d):
    """A stateful join of two streams within a time range."""

    def build(e):
        clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
        buys = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"))
        return events.joined(clicks, buys, ["user_id"], "ts", "other_ts", "1 hour", late="2 hours").select("event_id", "other_id")

    return _stream(spark, d, build)


@_frame("cdc_slot", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'it''s new' WHEN c_custkey % 4 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 2")
def _(spark, d):
    """A slot's text changes, parsed and applied."""
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    key = F.concat(F.lit("c_custkey[bigint]:"), F.col("c_custkey").cast("string"))
    data = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("table public.cust: UPDATE: "), key, F.lit(" c_mktsegment[character varying]:'it''s new'"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("table public.cust: DELETE: "), key)).when(F.col("c_custkey") % 4 == 3, F.concat(F.lit("table public.cust: UPDATE: "), key, F.lit(" c_mktsegment[text]:null"))).otherwise(F.lit("BEGIN 1"))
    slot = c.select(F.concat(F.lit("A/"), F.hex("c_custkey")).alias("lsn"), data.alias("data"))
    changes = events.parse_changes(slot, "public.cust", ["c_custkey", "c_mktsegment"]).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    return events.apply_changes(c, changes, ["c_custkey"])


def _plain(path: str) -> str:
    """The shared folder as a path for open(), where it is a file system's."""
    return path.removeprefix("file:").replace("//", "/")


# Services, triggers and the query surface; services are stood in for by functions that answer from a table
def _service(spark, d, shape):
    """A fetch function over the nations, ten a page; ``shape`` makes a page's body from its rows."""
    rows = [r.asDict() for r in load(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]

    def fetch(url, body, headers):
        numbers = [int(n) for n in re.findall(r"(?:offset=|StartRowNum=|<start>)(\d+)", url + (body or b"").decode())]
        return shape(rows[numbers[0] : numbers[0] + 10])

    return fetch


_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"
_frame("source_json_http", _NATIONS)(lambda s, d: connectors.open_connector(s, "json_http", url="http://nations", data_path="data.rows", page_size=10, fetch=_service(s, d, lambda rows: json.dumps({"data": {"rows": rows}}).encode())).read())
_frame("source_eai", _NATIONS)(lambda s, d: connectors.open_connector(s, "eai", url="http://nations", page_size=10, fetch=_service(s, d, lambda rows: json.dumps({"items": rows}).encode())).read())
_frame("source_soap", _NATIONS)(
    lambda s, d: connectors.open_connector(s, "soap", url="http://nations", template="<q><start>{StartRow}</start></q>", row_tag="row", page_size=10, fetch=_service(s, d, lambda rows: remote.soap_envelope(rows, "Nations").encode())).read()
)


@_frame("sink_http", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """Rows posted as JSON arrays, which the receiver keeps one a line in files of its own."""
    path = _plain(shared(spark))
    os.makedirs(path)

    def send(url, body, headers):
        with open(f"{path}/{uuid.uuid4().hex}.json", "wb") as f:
            f.write(body)
        return b"{}"

    connectors.open_connector(spark, "json_http", url="http://nations", fetch=send).write(load(spark, d, "nation").select("n_nationkey", "n_name"))
    return spark.read.schema("n_nationkey int, n_name string").option("multiLine", True).json(path)


@_frame("csv_encoding", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'страна, при море ' || n_name AS n_name FROM nation")
def _(spark, d):
    """A file in a code page, which is detected."""
    path = _plain(shared(spark))
    os.makedirs(path)
    with open(f"{path}/nation.csv", "w", encoding="cp1251") as f:
        f.writelines(["n_nationkey,n_name\n", *(f'{r[0]},"страна, при море {r[1]}"\n' for r in load(spark, d, "nation").select("n_nationkey", "n_name").collect())])
    e = engine.Engine(spark, database=dml.Database(spark, f"{path}-db"))
    e.ingest_csv("nat", path)
    return e.sql("SELECT * FROM nat")


@_frame("agg_approx_within", "SELECT TRUE AS parts, TRUE AS median")
def _(spark, d):
    """Estimates within five hundredths of the exact values."""
    li = load(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    near = lambda a, b: F.abs(a - b) <= 0.05 * b
    # One aggregate of all four would keep a sketch for each part; the exact ones are made of counted groups instead.
    guess = li.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts_near"), F.percentile_approx("l_extendedprice", 0.5).alias("median_near"))
    parts = li.select("l_partkey").distinct().agg(F.count("l_partkey").alias("parts_exact"))
    found = guess.crossJoin(parts).crossJoin(profile.exact_median(li, "l_extendedprice").withColumnRenamed("median", "median_exact"))
    return found.select(near(F.col("parts_near"), F.col("parts_exact")).alias("parts"), near(F.col("median_near"), F.col("median_exact")).alias("median"))


@_frame("page_cap", "SELECT o_orderkey, TRUE AS truncated FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    e = engine.Engine(spark)
    e.register("orders", f"{d}/orders.parquet")
    rows, more = e.page("SELECT o_orderkey FROM orders ORDER BY o_orderkey", 20)
    return spark.createDataFrame([(r["o_orderkey"], more) for r in rows], "o_orderkey bigint, truncated boolean")


@_frame("acl_tables", "SELECT * FROM (VALUES ('nation', TRUE), ('orders', FALSE), ('region', FALSE)) AS t(name, allowed)")
def _(spark, d):
    """What a role may select from; a table without a grant does not exist for it."""
    e = engine.Engine(spark, engine.Policy(grants=(("clerk", "nat*", frozenset({"select"})), ("clerk", "reg*", frozenset({"insert"})))))
    rows = []
    for t in ("nation", "orders", "region"):
        e.register(t, f"{d}/{t}.parquet")
        try:
            rows.append((t, e.sql(f"SELECT * FROM {t}", principal=engine.Principal("c", "clerk")).limit(1).count() == 1))
        except AnalysisException:
            rows.append((t, False))
    return spark.createDataFrame(rows, "name string, allowed boolean")


@_frame("arrow_export", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    e = engine.Engine(spark)
    e.register("customer", f"{d}/customer.parquet")
    return spark.createDataFrame(e.arrow("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"))


@_frame("api_tables", "SELECT 'nation' AS name, name AS column_name FROM pragma_table_info('nation') UNION ALL SELECT 'region', name FROM pragma_table_info('region')")
def _(spark, d):
    e = engine.Engine(spark)
    for t in ("nation", "region", "part"):
        e.register(t, f"{d}/{t}.parquet")
    e.drop("part")
    return spark.createDataFrame([(t, c) for t in e.tables() for c, _ in e.schema(t)], "name string, column_name string")


@_frame("connector_describe", "SELECT 'customer.parquet' AS entity, name AS column_name FROM pragma_table_info('customer')")
def _(spark, d):
    c = connectors.open_connector(spark, "parquet", path=d)
    entity = next(e for e in c.entities() if e.startswith("customer"))
    return spark.createDataFrame([(entity, n) for n, _ in c.describe(entity)], "entity string, column_name string")


@_frame("pipeline_retry", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    """A step that fails twice with a passing error."""
    tries = []

    def source(s):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("connection reset")
        return load(s, d, "nation")

    steps = [pipeline.Step("nat", source=source, retries=3), pipeline.Step("out", sql="SELECT n_name FROM nat WHERE n_regionkey = {region}", deps=("nat",), params={"region": 2})]
    return pipeline.Pipeline("retry", steps).run(spark, wait=lambda seconds: None)


@_frame("trigger_runs", "SELECT * FROM (VALUES (600, 'nightly'), (600, 'poll'), (660, 'files'), (900, 'nightly'), (900, 'poll')) AS t(moment, name)")
def _(spark, d):
    """What cron, interval and file triggers start as the clock goes on."""
    path = shared(spark)
    runner = triggers.Runner(spark, Store(spark, f"{path}/state"))
    one = lambda name: pipeline.Pipeline(name, [pipeline.Step("x", sql="SELECT 1 AS one")])
    runner.add(one("nightly"), triggers.Trigger("nightly", "cron", "*/5 * * * *"))
    runner.add(one("poll"), triggers.Trigger("poll", "interval", "300"))
    runner.add(one("files"), triggers.Trigger("files", "file", f"{path}/in/*.parquet"))
    rows = []
    for at in (600, 660, 720, 900):
        if at == 660:
            load(spark, d, "region").coalesce(1).write.parquet(f"{path}/in")
        rows += [(at, name) for name in runner.tick(float(at))]
    return spark.createDataFrame(rows, "moment int, name string")


@_frame("datamart_on_write", "SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT 'NEW') GROUP BY c_mktsegment")
def _(spark, d):
    """An insert through the engine refreshes the marts of its table."""
    path = shared(spark)
    db = dml.Database(spark, f"{path}/db")
    db.write("mart_customer", load(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    e, runner = engine.Engine(spark, database=db), triggers.Runner(spark, Store(spark, f"{path}/state"))
    runner.marts["segments"] = datamart.Datamart("segments", "SELECT c_mktsegment, count(*) AS n FROM mart_customer GROUP BY c_mktsegment", f"{path}/mart", "on_write", sources=("mart_customer",), stale=False)
    e.written.append(runner.table_written)
    e.execute("INSERT INTO mart_customer VALUES (-1, 'NEW')")
    return dml.Table(spark, f"{path}/mart").read()


@_frame("connection_pipeline", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    """A kept pipeline over a named connection, run from the stores."""
    store = Store(spark, f"{shared(spark)}/state")
    lake = connectors.Connections(spark, store)
    lake.save("lake", "parquet", path=d)
    specs = pipeline.Specs(store)
    specs.save("count", "name: count\nsteps:\n- {id: r, source: {connection: lake, entity: region.parquet}}\n- {id: n, source: {connection: lake, entity: nation.parquet}}\n- {id: c, sql: 'SELECT r_name, count(*) AS n FROM r JOIN n ON n_regionkey = r_regionkey GROUP BY r_name', deps: [r, n]}\n")
    return specs.load("count", connections=lake).run(spark)


@_frame("kafka_avro", "SELECT event_id AS kafka_offset, user_id AS id, CASE WHEN user_id % 2 = 0 THEN event_type END AS kind FROM events")
def _(spark, d):
    """Avro values made from the events by built-in functions: numbers of seven bits a byte, a union with null, text."""
    low = lambda n, shift: F.shiftright(n, shift).bitwiseAND(127)
    two = F.col("user_id") * 2

    def byte(n):
        return F.unhex(F.lpad(F.hex(n), 2, "0"))

    # user_id stays below 2 ** 20, so its zigzag number has three bytes here, the first two with the mark that more follow.
    number = F.concat(byte(low(two, 0) + 128), byte(low(two, 7) + 128), byte(low(two, 14)))
    text = F.encode("event_type", "UTF-8")
    kind = F.when(F.col("user_id") % 2 == 0, F.concat(F.unhex(F.lit("02")), byte(F.length(text).cast("long") * 2), text)).otherwise(F.unhex(F.lit("00")))
    messages = load(spark, d, "events").select(F.col("event_id").alias("offset"), F.concat(F.unhex(F.lit("0000000007")), number, kind).alias("value"))
    schema = {"type": "record", "name": "E", "fields": [{"name": "id", "type": "long"}, {"name": "kind", "type": ["null", "string"]}]}
    return remote.parse_messages(messages, json.dumps(schema), "avro")
