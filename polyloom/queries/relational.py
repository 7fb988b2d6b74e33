"""Scans, predicates, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from polyloom.queries import same

# -- scans -------------------------------------------------------------------------------------------------------------
same("s1_scan", "SELECT DISTINCT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders WHERE o_totalprice > 1000 ORDER BY y, o_orderstatus")
same("s2_point_get", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
same("s3_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
same("s4_index_lookup", "SELECT p_partkey, p_name FROM part WHERE p_size = 15")
same("s5_columnar_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00'")
same("s12_estimate_count", "SELECT count(*) AS n FROM lineitem")
same("p1_projection", "SELECT n_name, n_regionkey FROM nation")
same("p2_computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
same(
    "p3_arithmetic",
    "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, try_divide(l_quantity, l_linenumber - 1) AS d, try_mod(l_linenumber, l_linenumber - 1) AS e FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, l_quantity / nullif(l_linenumber - 1, 0) AS d, (l_linenumber % nullif(l_linenumber - 1, 0))::INTEGER AS e FROM lineitem",
)
same(
    "p4_concat",
    "SELECT c_custkey, concat(c_name, '-', coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS s FROM customer",
    "SELECT c_custkey, c_name || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS s FROM customer",
)
same("p5_comparisons", "SELECT count(*) AS n, count(CASE WHEN l_quantity <> l_linenumber THEN 1 END) AS ne FROM lineitem WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_tax < 0.06 AND l_quantity > l_linenumber")
same("p6_boolean", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_size < 5) AND NOT p_brand = 'Brand#11'")
same(
    "p7_try_cast",
    "SELECT p_partkey, try_cast(p_brand AS INT) AS bad, try_cast(CAST(p_size AS STRING) AS BIGINT) AS ok, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part",
    "SELECT p_partkey, try_cast(p_brand AS INT) AS bad, try_cast(p_size::VARCHAR AS BIGINT) AS ok, floor(p_retailprice)::BIGINT AS whole FROM part",
)
same("p8_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS simple, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS searched FROM orders")
same("p9_coalesce_nullif", "SELECT p_partkey, coalesce(nullif(p_size, 10), -1) AS s FROM part")
same("p10_is_null", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND d.text IS NOT NULL")
same("p12_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
same("p13_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_type NOT LIKE 'X%' AND p_name ILIKE '%A%' AND p_name NOT ILIKE 'zz_%'")
same("p14_in", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3, 4)")
same("p15_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1100")
same("p16_or_groups", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 45) OR (l_returnflag = 'A' AND l_quantity < 3)")
same("p17_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
same("p17_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
same("p18_scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
same("p21_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM (SELECT n FROM big WHERE n > 2) t GROUP BY n")
same(
    "p22_recursive_cte",
    "WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM t JOIN nation n ON n.n_nationkey = t.k + 3 WHERE t.depth < 10) SELECT k, depth FROM t",
)
# -- joins -------------------------------------------------------------------------------------------------------------
same("j1_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000")
same("j2_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
same("j3_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000")
same("j4_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey")
same("j5_semi", "SELECT p.p_partkey FROM part p LEFT SEMI JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 49", "SELECT p.p_partkey FROM part p SEMI JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 49")
same("j6_anti", "SELECT p.p_partkey FROM part p LEFT ANTI JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 48", "SELECT p.p_partkey FROM part p ANTI JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 48")
same("j7_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
same("j8_theta", "SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey * 5 AND n.n_regionkey <> r.r_regionkey")
same("j9_broadcast", "SELECT /*+ BROADCAST(n) */ n.n_name, count(*) AS n_cust FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
same("j10_shuffle", "SELECT /*+ SHUFFLE_HASH(o) */ o.o_orderstatus, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus")
same("j11_star", "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 2 GROUP BY n.n_name")
# -- aggregates --------------------------------------------------------------------------------------------------------
same("a1_count", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS nt FROM lineitem GROUP BY l_returnflag")
same("a2_sum_avg", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("a5_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
same("a6_stddev", "SELECT p_brand, round(CASE WHEN count(p_retailprice) >= 2 THEN stddev_pop(p_retailprice) END, 6) AS sp, round(CASE WHEN count(p_retailprice) >= 2 THEN stddev_samp(p_retailprice) END, 6) AS ss, round(CASE WHEN count(p_retailprice) >= 2 THEN var_pop(p_retailprice) END, 4) AS vp, round(CASE WHEN count(p_retailprice) >= 2 THEN var_samp(p_retailprice) END, 4) AS vs FROM part GROUP BY p_brand")
same(
    "a10_array_agg",
    "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ';') AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ';') AS names FROM nation GROUP BY n_regionkey",
)
same(
    "a11_string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
same(
    "a12_percentile_cont",
    "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus",
)
same("a13_group_by_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
same("a14_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
same(
    "a15_nested",
    "SELECT c_nationkey, sum(n) AS n, array_join(transform(array_sort(collect_list(struct(c_mktsegment, n))), x -> concat(x.c_mktsegment, ':', x.n)), '|') AS sub_groups FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY c_nationkey",
    "SELECT c_nationkey, sum(n)::BIGINT AS n, string_agg(c_mktsegment || ':' || n, '|' ORDER BY c_mktsegment) AS sub_groups FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY c_nationkey",
)
same("a18_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS av FROM lineitem")
same("a20_filtered", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
same(
    "a21_first_last",
    "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id",
    "SELECT user_id, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY user_id",
)
same("a22_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
same("a23_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("a23_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
same("a23_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
# -- windows -----------------------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
same("w1_row_number", f"SELECT o_orderkey, row_number() {_W} AS rn FROM orders", f"SELECT o_orderkey, (row_number() {_W})::INTEGER AS rn FROM orders")
same("w2_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INTEGER AS r, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INTEGER AS d FROM part")
same("w4_ntile", "SELECT p_partkey, ntile(5) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part", "SELECT p_partkey, (ntile(5) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))::INTEGER AS q FROM part")
same("w5_lag_lead", f"SELECT o_orderkey, lag(o_totalprice, 1, CAST(0 AS DOUBLE)) {_W} AS prev, lead(o_totalprice, 2) {_W} AS nxt FROM orders")
same("w7_running", f"SELECT o_orderkey, round(sum(o_totalprice) {_W[:-1]} ROWS UNBOUNDED PRECEDING), 2) AS s, count(*) {_W} AS n, round(avg(o_totalprice) {_W[:-1]} ROWS UNBOUNDED PRECEDING), 4) AS a, min(o_totalprice) {_W} AS lo, max(o_totalprice) {_W} AS hi FROM orders")
same("w8_first_last", f"SELECT o_orderkey, first_value(o_totalprice) {_W} AS f, last_value(o_totalprice) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
same("w9_frames", f"SELECT o_orderkey, round(sum(o_totalprice) {_W[:-1]} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
same("w12_distribution", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd, nth_value(p_size, 2) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nv FROM part")
# -- sorting and sets --------------------------------------------------------------------------------------------------
same("o1_order_by", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size ASC, p_partkey")
same("o3_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
same("o5_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
same("u1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
same("u2_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
same("u3_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
same("u4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'")
same("u4_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
# -- whole queries -----------------------------------------------------------------------------------------------------
same("q1_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
same("q3_shipping", "SELECT o.o_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10")
