"""Relational queries: one text for Spark and the oracle where both read it alike."""

from __future__ import annotations

from tessera.sources.tables import sql

SAME = {
    "sql_select_star": "SELECT * FROM region",
    "sql_project_alias": "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders",
    "sql_filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 200000 AND o_orderkey >= 10 AND o_orderkey < 9000 AND o_custkey <> 7 AND o_orderstatus = 'O'",
    "sql_filter_and_or_not": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'A' OR l_quantity < 10) AND (l_linestatus = 'O' OR l_discount > 0.05)",
    "sql_is_null": "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL",
    "sql_is_not_null": "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL",
    "sql_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'",
    "sql_like_ci": "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%STEEL%' OR p_type ILIKE 'promo%'",
    "sql_in": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 9, 20)",
    "sql_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000",
    "sql_qualified_columns": "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_custkey = 11",
    "sql_compat_not_null_logic": "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '5-LOW') = '1-URGENT', false)",
    "sql_case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(o_custkey AS VARCHAR(20)) AS cust FROM orders",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_order_desc_str": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey LIMIT 30",
    "sql_limit_offset": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15",
    "sql_topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "sql_scalar_functions": "SELECT c_custkey, upper(c_name) AS up, CAST(length(c_name) AS BIGINT) AS n, round(abs(c_acctbal), 1) AS bal, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer",
    "agg_pricing_summary": """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS sum_price,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "agg_global": "SELECT count(*) AS n, count(l_comment) AS n2, min(l_quantity) AS lo, max(l_quantity) AS hi FROM (SELECT l_quantity, nullif(l_returnflag, 'N') AS l_comment FROM lineitem) t",
    "agg_group": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus",
    "agg_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_avg": "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY c_mktsegment",
    "agg_min_max": "SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand",
    "agg_multi_key": "SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey, l_returnflag",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_select_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "agg_conditional_counts": "SELECT CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(*) AS total FROM events",
    "agg_stddev": "SELECT event_type, round(stddev_pop(value), 4) AS sd, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "agg_utilisation": "SELECT s_nationkey, round(100.0 * sum(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END) / nullif(sum(abs(s_acctbal)), 0), 4) AS pct FROM supplier GROUP BY s_nationkey",
    "index_point_lookup": "SELECT * FROM orders WHERE o_orderkey = 42",
    "index_range_scan_closed": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200 ORDER BY o_orderkey",
    "index_range_scan_open": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey < 200 ORDER BY o_orderkey",
    "index_range_scan_left": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY o_orderkey",
    "index_range_scan_right": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200 ORDER BY o_orderkey",
    "index_scan_all": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey",
    "lock_compatibility": """WITH modes AS (SELECT 'S' AS m UNION ALL SELECT 'X' UNION ALL SELECT 'IS' UNION ALL SELECT 'IX' UNION ALL SELECT 'SIX')
SELECT a.m AS held, b.m AS wanted, CASE WHEN a.m = 'X' OR b.m = 'X' THEN false WHEN a.m = 'IS' OR b.m = 'IS' THEN true WHEN a.m = 'SIX' OR b.m = 'SIX' THEN false ELSE a.m = b.m END AS compatible FROM modes a CROSS JOIN modes b""",
    "ext_join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "ext_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "ext_join_right": "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1",
    "ext_join_full": "SELECT coalesce(a.n_nationkey, -1) AS a, coalesce(b.n_nationkey, -1) AS b FROM nation a FULL OUTER JOIN nation b ON a.n_nationkey = b.n_nationkey + 10",
    "ext_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "ext_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "ext_join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "ext_join_range": "SELECT b.lo, count(*) AS n FROM orders JOIN (SELECT 0 AS lo, 50000 AS hi UNION ALL SELECT 50000, 150000 UNION ALL SELECT 150000, 10000000) b ON o_totalprice >= b.lo AND o_totalprice < b.hi GROUP BY b.lo",
    "ext_join_three_way": "SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "ext_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "ext_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "ext_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "ext_except": "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "ext_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "ext_window_running": "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS s FROM events",
    "ext_window_lag": "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events",
    "ext_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "ext_rollup": "SELECT p_brand, coalesce(p_size, -1) AS size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "ext_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "ext_cte_subquery": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus",
    "policy_stats": "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type",
    "audit_stats": "SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "obj_list": "SELECT source AS bucket, concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20))) AS path FROM documents WHERE source LIKE 'src1%'",
    "gpu_healthy": "SELECT event_id AS gpu_id FROM events WHERE event_type <> 'error' AND value < 90 AND event_id % 11 <> 0",
    "numa_feasible": "SELECT numa, free FROM (SELECT user_id % 8 AS numa, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS free FROM events GROUP BY user_id % 8) t WHERE free >= 4",
    "ext_json_type": "SELECT event_type, count(*) AS n FROM events WHERE props LIKE '{%' GROUP BY event_type",
}

#: Spark text, oracle text.
PAIRS = {
    "cert_current": (
        "SELECT user_id AS spiffe, max(event_id) AS cert, max_by(event_type, event_id) AS kind FROM events WHERE event_id % 17 <> 0 GROUP BY user_id",
        "SELECT user_id AS spiffe, max(event_id) AS cert, arg_max(event_type, event_id) AS kind FROM events WHERE event_id % 17 <> 0 GROUP BY user_id",
    ),
    "obj_checksum": ("SELECT doc_id, sha2(text, 256) AS checksum, base64(encode(substr(text, 1, 12), 'UTF-8')) AS head FROM documents", "SELECT doc_id, sha256(text) AS checksum, base64(encode(substr(text, 1, 12))) AS head FROM documents"),
    "obj_dedup": ("SELECT sha2(text, 256) AS checksum, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY sha2(text, 256)", "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY sha256(text)"),
    "bucket_totals": ("SELECT source AS bucket, count(*) AS objects, sum(octet_length(text)) AS bytes FROM documents GROUP BY source", "SELECT source AS bucket, count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source"),
    "ext_json": (
        "SELECT event_id, CAST(size(json_object_keys(props)) AS BIGINT) AS n_keys FROM events",
        "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events",
    ),
    "baseline_stats": (
        "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type",
        "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type",
    ),
}


def _run(text: str):
    return lambda spark, sf_dir: sql(spark, sf_dir, text)


QUERIES = {k: _run(v) for k, v in SAME.items()} | {k: _run(v[0]) for k, v in PAIRS.items()}
ORACLE = SAME | {k: v[1] for k, v in PAIRS.items()}
