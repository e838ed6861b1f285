"""Scans, joins, aggregation, sorting, subqueries."""

from __future__ import annotations

from lodestar.queries import sql

MONEY = "ROUND(CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE), 2)"


def total(x: str) -> str:
    return MONEY.format(x)


sql("scan_all", "SELECT * FROM nation")
sql("scan_columns", "SELECT o_orderkey, o_totalprice FROM orders")
sql("scan_filter_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
sql("scan_filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00'")
sql("index_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
sql("index_range_residual", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_totalprice > 1000")
sql("values_inline", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, val)")
sql("select_no_from", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'x' AS s")
sql("select_star_plus_expr", "SELECT *, n_nationkey + 1 AS next_key FROM nation")
sql("project_computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
sql("project_alias", "SELECT p.p_partkey AS id, p.p_name AS label FROM part AS p")
sql("where_and_or_null", "SELECT c_custkey FROM customer WHERE (NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY' OR c_acctbal > 5000) AND c_nationkey < 20")
sql("where_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 AND c_nationkey = 3)")
sql("where_nullif_is_null", "SELECT c_custkey, NULLIF(c_nationkey, 5) AS nk FROM customer WHERE NULLIF(c_nationkey, 5) IS NULL")
sql("where_is_not_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 5) IS NOT NULL")

sql("join_inner_equi", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
sql("join_inner_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_orderkey < 200")
sql("join_residual", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey")
sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
sql("join_full", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
sql("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey")
sql("join_self", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.c_custkey < 60 AND b.c_custkey < 60")
sql("join_three_way", f"SELECT n.n_name, COUNT(*) AS orders_n, {total('o.o_totalprice')} AS value FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
for kind, hint in (("hash", "SHUFFLE_HASH(c)"), ("merge", "MERGE(c)"), ("broadcast", "BROADCAST(n)")):
    plain = "o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey" if kind != "broadcast" else "c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    sql(f"join_hint_{kind}", f"SELECT /*+ {hint} */ {plain}", f"SELECT {plain}")
NULLED = "(SELECT c_custkey, NULLIF(c_nationkey, 7) AS k FROM customer WHERE c_custkey < 40)"
sql("join_null_safe", f"SELECT a.c_custkey AS x, b.c_custkey AS y FROM {NULLED} a JOIN {NULLED} b ON a.k <=> b.k", f"SELECT a.c_custkey AS x, b.c_custkey AS y FROM {NULLED} a JOIN {NULLED} b ON a.k IS NOT DISTINCT FROM b.k")
sql("join_null_never_matches", f"SELECT a.c_custkey AS x, b.c_custkey AS y FROM {NULLED} a JOIN {NULLED} b ON a.k = b.k")
sql("join_semi", "SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P')")
sql("join_anti", "SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P')")

sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
sql("agg_count_col", "SELECT COUNT(NULLIF(l_returnflag, 'N')) AS n FROM lineitem")
sql("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql("agg_sum", f"SELECT {total('l_quantity')} AS q FROM lineitem")
sql("agg_avg", "SELECT l_returnflag, ROUND(CAST(AVG(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 2) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_min_max", "SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders")
sql("agg_min_max_string", "SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer")
sql("agg_global", f"SELECT COUNT(*) AS n, {total('o_totalprice')} AS s FROM orders")
sql("agg_global_empty", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0")
sql("agg_group_by", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
sql("agg_group_multi", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {total('l_quantity')} AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_expr", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")
sql("agg_group_null_key", "SELECT NULLIF(c_nationkey, 7) AS k, COUNT(*) AS n FROM customer GROUP BY NULLIF(c_nationkey, 7)")
sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("agg_in_expression", "SELECT o_orderstatus, -COUNT(*) + 1 AS x, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY o_orderstatus")
sql("agg_group_concat", "SELECT n_regionkey, ARRAY_JOIN(ARRAY_SORT(COLLECT_LIST(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_stddev_variance", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 4) AS sd, ROUND(VAR_SAMP(l_quantity), 3) AS v FROM lineitem GROUP BY l_returnflag")
sql("agg_array_agg", "SELECT r_regionkey, ARRAY_JOIN(ARRAY_SORT(ARRAY_AGG(n_nationkey)), ' ') AS ks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, STRING_AGG(CAST(n_nationkey AS VARCHAR), ' ' ORDER BY n_nationkey) AS ks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
sql("q1_like", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {total('l_quantity')} AS sum_qty, {total('l_extendedprice * (1 - l_discount)')} AS revenue, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1 ORDER BY l_returnflag, l_linestatus LIMIT 10",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 2) AS sum_qty, ROUND(CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS revenue, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1")
sql("q3_like", f"SELECT l.l_orderkey, o.o_orderdate, {total('l.l_extendedprice * (1 - l.l_discount)')} AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10")
sql("q6_like", f"SELECT {total('l_extendedprice * l_discount')} AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("distinct_column", "SELECT DISTINCT l_suppkey FROM lineitem")
sql("rollup_extra", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
sql("window_extra", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
sql("union_extra", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
sql("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey LIMIT 50")
sql("sort_desc_nulls", "SELECT c_custkey, NULLIF(c_nationkey, 7) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey LIMIT 20")
sql("sort_asc_nulls", "SELECT c_custkey, NULLIF(c_nationkey, 7) AS k FROM customer ORDER BY k, c_custkey LIMIT 20", "SELECT c_custkey, NULLIF(c_nationkey, 7) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 20")
sql("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 20")
sql("offset_only", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("cte_simple", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus")
sql("cte_columns", "WITH t(k, n) AS (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM t GROUP BY n")
sql("derived_table", "SELECT d.n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d GROUP BY d.n")
sql("nested_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders))")
sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")
sql("correlated_scalar", "SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
sql("any_subquery", "SELECT p_partkey FROM part WHERE p_size IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
sql("all_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
sql("exists_extra", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
sql("unnest_embeddings", "SELECT vec_id, COUNT(*) AS n, MIN(CAST(e AS DOUBLE)) AS lo, MAX(CAST(e AS DOUBLE)) AS hi FROM (SELECT vec_id, EXPLODE(embedding) AS e FROM embeddings) GROUP BY vec_id", "SELECT vec_id, COUNT(*) AS n, MIN(CAST(e AS DOUBLE)) AS lo, MAX(CAST(e AS DOUBLE)) AS hi FROM (SELECT vec_id, UNNEST(embedding) AS e FROM embeddings) GROUP BY vec_id")
sql("unnest_split_tokens", "SELECT tok, COUNT(*) AS n FROM (SELECT EXPLODE(SPLIT(p_name, ' ')) AS tok FROM part) GROUP BY tok", "SELECT tok, COUNT(*) AS n FROM (SELECT UNNEST(STRING_SPLIT(p_name, ' ')) AS tok FROM part) GROUP BY tok")
sql("unnest_empty_null", "SELECT id, EXPLODE(a) AS x FROM (VALUES (1, ARRAY(10, 20)), (2, CAST(NULL AS ARRAY<INT>)), (3, SLICE(ARRAY(1), 1, 0))) AS t(id, a)", "SELECT id, UNNEST(a) AS x FROM (VALUES (1, [10, 20]), (2, NULL), (3, [])) AS t(id, a)")
sql("array_any", "SELECT vec_id FROM embeddings WHERE EXISTS(embedding, x -> x > 0.35)", "SELECT vec_id FROM embeddings WHERE LEN(LIST_FILTER(embedding, lambda x: x > 0.35)) > 0")
# the bound as a float, as the second engine reads it beside floats: 0.35 read from a float column is not below it
sql("array_all", "SELECT vec_id FROM embeddings WHERE FORALL(embedding, x -> x < CAST(0.35 AS FLOAT))", "SELECT vec_id FROM embeddings WHERE LEN(LIST_FILTER(embedding, lambda x: x < 0.35)) = LEN(embedding)")
