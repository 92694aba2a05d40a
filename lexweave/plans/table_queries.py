"""Relational operators over the star schema, as SQL that Spark and DuckDB both read.

A statement names its tables in braces. Catalyst plans joins, aggregates and pruning; wherever rows
fan out, children are aggregated before they are joined, and every ranking has a total order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: By operator of the inventory.
STATEMENTS = {
    "s11_unmatched_rows_stay": "SELECT c.c_custkey, coalesce(o.o_orderstatus, 'none') AS status FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "s12_resume_set": "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "j1_inner_chain": "SELECT l.l_orderkey, l.l_linenumber, c.c_name FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 45",
    "j2_child_counts": "SELECT o.o_orderkey, coalesce(a.parts, 0) AS parts, coalesce(a.suppliers, 0) AS suppliers FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_orderkey) a ON a.l_orderkey = o.o_orderkey",
    "j3_adjacent_rows": "SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_linenumber < 3 THEN 'BEFORE' WHEN l.l_linenumber > 3 THEN 'AFTER' ELSE 'TARGET' END AS place, abs(l.l_linenumber - 3) AS distance FROM {lineitem} l JOIN (SELECT l_orderkey AS k FROM {lineitem} WHERE l_linenumber = 3) t ON l.l_orderkey = t.k WHERE l.l_linenumber BETWEEN 2 AND 4",
    "j5_semi_join": "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.09)",
    "j9_exact_link": "SELECT o.o_orderkey, min(c.c_custkey) AS case_id FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey GROUP BY o.o_orderkey",
    "j12_turn_chaining": "SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS responds_to, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM {conversations}",
    "j13_tree_levels": "SELECT r.r_name AS level1, n.n_name AS level2, c.c_name AS level3 FROM {region} r LEFT JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey",
    "j14_thread_on_a_row": "SELECT a.conv_id, a.turn AS opening, b.turn AS response, c.turn AS reply FROM {conversations} a LEFT JOIN {conversations} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 LEFT JOIN {conversations} c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2 WHERE a.turn = 0",
    "j15_recursive_chain": "WITH RECURSIVE chain(conv_id, turn, depth) AS (SELECT conv_id, turn, 1 FROM {conversations} WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, chain.depth + 1 FROM {conversations} c JOIN chain ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1) SELECT conv_id, turn, depth FROM chain",
    "j20_null_safe_key": "SELECT a.conv_id, a.turn, b.turn AS prev FROM (SELECT conv_id, turn, nullif(turn, 0) AS parent FROM {conversations}) a JOIN (SELECT conv_id, turn, nullif(turn, 0) AS parent FROM {conversations}) b ON a.conv_id = b.conv_id AND coalesce(a.parent, -1) = coalesce(b.parent, -1)",
    "j23_comma_blind_match": "SELECT c.c_custkey, s.s_suppkey FROM {customer} c JOIN {supplier} s ON replace(replace(c.c_name, ',', ''), 'Customer', 'Supplier') = replace(s.s_name, ',', '')",
    "a1_scalar_bundle": "SELECT (SELECT count(*) FROM {orders}) AS orders, (SELECT count(*) FROM {lineitem}) AS lineitems, (SELECT count(*) FROM {customer}) AS customers",
    "a2_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag",
    "a3_sum_avg_min_max": "SELECT l_linestatus, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_discount) AS lo, max(l_discount) AS hi FROM {lineitem} GROUP BY l_linestatus",
    "a4_having": "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) >= 100",
    "a5_conditional_sum": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS reversed, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "a6_filter_clause": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n, count(*) FILTER (WHERE o_totalprice > 100000) AS large_n FROM {orders} GROUP BY o_orderpriority",
    "a7_safe_percentage": "SELECT c.c_mktsegment, coalesce(round(100.0 * count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') / nullif(count(o.o_orderkey), 0), 4), 0) AS rate FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "a8_share_of_total": "SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM {lineitem} GROUP BY l_returnflag",
    "a11_canonical_min": "SELECT n_regionkey, min(n_nationkey) AS canonical, count(*) AS n FROM {nation} GROUP BY n_regionkey",
    "a12_distributions": "SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n FROM {orders} GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM {orders} GROUP BY o_orderpriority",
    "a14_five_issue_columns": "SELECT l_orderkey, max(CASE WHEN n = 1 THEN l_partkey END) AS issue1, max(CASE WHEN n = 2 THEN l_partkey END) AS issue2, max(CASE WHEN n = 3 THEN l_partkey END) AS issue3, max(CASE WHEN n = 4 THEN l_partkey END) AS issue4, max(CASE WHEN n = 5 THEN l_partkey END) AS issue5 FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM {lineitem}) t WHERE n <= 5 GROUP BY l_orderkey",
    "a15_batch_statistics": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, CASE WHEN count(*) > 0 THEN round(100.0 * count(CASE WHEN value > 0 THEN 1 END) / count(*), 4) ELSE 0 END AS success_rate FROM {events} GROUP BY event_type",
    "a16_year_type_statistics": "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS year, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY extract(year FROM o_orderdate), o_orderpriority",
    "a17_top_cited": "SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20",
    "a17_winning_suppliers": "SELECT s.s_name, count(DISTINCT l.l_orderkey) AS cases, CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_name HAVING count(DISTINCT l.l_orderkey) >= 5 ORDER BY wins DESC, s.s_name LIMIT 20",
    "a18_child_count": "SELECT c.c_custkey, coalesce(o.n, 0) AS n FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    "a19_max_case": "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS returned FROM {lineitem} GROUP BY l_orderkey",
    "a22_table_counts": "SELECT 'orders' AS name, count(*) AS n FROM {orders} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'documents', count(*) FROM {documents}",
    "o1_top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "o2_page": "SELECT c_custkey, c_name FROM {customer} ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40",
    "o3_nulls_first": "SELECT conv_id, turn, nullif(role, 'user') AS role FROM {conversations} ORDER BY nullif(role, 'user') DESC NULLS FIRST, conv_id, turn",
    "o4_distinct": "SELECT DISTINCT p_brand, p_type FROM {part}",
    "o5_distinct_on": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}) t WHERE n = 1",
    "o6_union_all": "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region}",
    "o7_first_seen": "SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS n FROM {lineitem}) t WHERE n = 1",
    "o9_exact_content_dedup": "SELECT h, doc_id FROM (SELECT md5(text) AS h, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY length(source), source, doc_id) AS n FROM {documents}) t WHERE n = 1",
    "o10_child_listing": "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_orderkey = (SELECT min(l_orderkey) FROM {lineitem}) ORDER BY l_shipdate, l_linenumber",
    "m10_status_backfill": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_totalprice > 150000 THEN 'review' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'new' END AS status FROM {orders}",
    "r6_like_patterns": "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE '%a%' AND p_type LIKE 'S%' AND p_brand LIKE '%1'",
    "r21_membership": "SELECT o_orderkey FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
}


def statement(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a statement over the tables it names, none of which is registered in the catalog."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


QUERIES = {name: lambda spark, sf_dir, sql=sql: statement(sql, spark, sf_dir) for name, sql in STATEMENTS.items()}
ORACLE_SQL = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in STATEMENTS.items()}
