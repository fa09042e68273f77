"""Ad-hoc SQL over registered views: one query per construct users can write.

Each entry is Spark text and, where the dialects differ, the DuckDB twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casframe.sources import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_REVENUE = "sum(l_extendedprice * (1 - l_discount))"

SUITE: dict[str, str | tuple[str, str]] = {
    "sql_inner_join": f"SELECT n_name, round({_REVENUE}, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k",
    "sql_using_join": "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders) JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) USING (k) GROUP BY k",
    "sql_semi_join": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "sql_anti_join": ("SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)"),
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "sql_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_lateral": "SELECT c_custkey, t.m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) t",
    "sql_asof": (
        "SELECT event_id, max(prev_ts) AS prev_ts FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '0.000001' SECOND PRECEDING) AS prev_ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE prev_ts IS NOT NULL GROUP BY event_id",
        "SELECT e.event_id, max(o.ts) AS prev_ts FROM events e JOIN events o ON e.user_id = o.user_id AND o.ts < e.ts AND o.event_type = 'purchase' GROUP BY e.event_id",
    ),
    "sql_interval_join": "SELECT p_size, count(*) AS n FROM part JOIN (SELECT 1 AS lo, 10 AS hi UNION ALL SELECT 11, 30 UNION ALL SELECT 31, 50) b ON p_size BETWEEN lo AND hi GROUP BY p_size",
    "sql_exists": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY o_orderpriority",
    "sql_scalar_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)",
    "sql_aggregate_filter": ("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, count(*) FILTER (WHERE l_discount > 0.05) AS nd FROM lineitem GROUP BY ALL HAVING count(*) > 10"),
    "sql_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "sql_statistics": ("SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(median(c_acctbal), 4) AS med, round(percentile(c_acctbal, 0.9), 4) AS p90, max_by(c_custkey, c_acctbal) AS top, bool_and(c_acctbal > -2000) AS ok, bit_xor(c_custkey) AS bx FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(median(c_acctbal), 4) AS med, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, max_by(c_custkey, c_acctbal) AS top, bool_and(c_acctbal > -2000) AS ok, bit_xor(c_custkey) AS bx FROM customer GROUP BY c_mktsegment"),
    "sql_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "sql_ordered_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_distinct_count": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "sql_ranking": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS t, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)",
    "sql_analytic": ("SELECT o_orderkey, lag(o_totalprice) OVER w AS lg, nth_value(o_totalprice, 2) OVER w AS nv, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END) IGNORE NULLS OVER w AS lv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_totalprice) OVER w AS lg, nth_value(o_totalprice, 2) OVER w AS nv, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END IGNORE NULLS) OVER w AS lv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "sql_frames": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, max(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS m FROM events",
    "sql_groups_frame": ("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS g FROM orders)", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders"),
    "sql_exclude_current": ("SELECT o_orderkey, nullif(sum(o_orderkey) OVER (PARTITION BY o_custkey) - o_orderkey, 0) AS s FROM orders", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM orders"),
    "sql_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_star_except": ("SELECT * EXCEPT (s_acctbal) FROM supplier", "SELECT * EXCLUDE (s_acctbal) FROM supplier"),
    "sql_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag"),
    "sql_unnest": ("SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10",
    "sql_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t",
    "sql_strings": ("SELECT p_partkey, substr(p_name, 2, 4) AS a, lpad(p_brand, 12, '*') AS b, split_part(p_type, ' ', 2) AS c, instr(p_name, 'a') AS d, reverse(p_brand) AS e, repeat(p_brand, 2) AS f, upper(trim(p_name)) AS g, length(p_type) AS h FROM part", "SELECT p_partkey, substr(p_name, 2, 4) AS a, lpad(p_brand, 12, '*') AS b, split_part(p_type, ' ', 2) AS c, CAST(instr(p_name, 'a') AS INTEGER) AS d, reverse(p_brand) AS e, repeat(p_brand, 2) AS f, upper(trim(p_name)) AS g, CAST(length(p_type) AS INTEGER) AS h FROM part"),
    "sql_regex": ("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS a, regexp_replace(p_name, '[aeiou]', '_') AS b FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS a, regexp_replace(p_name, '[aeiou]', '_', 'g') AS b FROM part"),
    "sql_dates": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS dd, last_day(o_orderdate) AS ld, weekofyear(o_orderdate) AS w, dayofweek(o_orderdate) AS dw FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS dd, last_day(o_orderdate) AS ld, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dw FROM orders"),
    "sql_math": ("SELECT l_orderkey, l_linenumber, l_quantity / 4 AS q, l_orderkey % 7 AS m, l_orderkey div 3 AS d, round(l_tax * 100, 1) AS r, try_divide(l_quantity, l_discount) AS z, abs(l_tax - l_discount) AS a, floor(l_extendedprice) AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity / 4 AS q, l_orderkey % 7 AS m, l_orderkey // 3 AS d, round(l_tax * 100, 1) AS r, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS z, abs(l_tax - l_discount) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f FROM lineitem"),
    "sql_casts": "SELECT event_id, TRY_CAST(event_type AS INT) AS bad, TRY_CAST(CAST(user_id AS VARCHAR(20)) AS BIGINT) AS good, CAST(value AS DECIMAL(12, 2)) AS d FROM events",
    "sql_arrays": ("SELECT p_partkey, array_contains(split(p_name, ' '), 'blue') AS has, element_at(split(p_name, ' '), 1) AS first, array_join(array_sort(split(p_name, ' ')), '-') AS sorted, array_join(transform(split(p_name, ' '), x -> upper(x)), ' ') AS up, aggregate(split(p_name, ' '), 0, (s, x) -> s + length(x)) AS total FROM part", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'blue') AS has, string_split(p_name, ' ')[1] AS first, array_to_string(list_sort(string_split(p_name, ' ')), '-') AS sorted, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x)), ' ') AS up, CAST(list_sum(list_transform(string_split(p_name, ' '), lambda x: length(x))) AS INTEGER) AS total FROM part"),
    "sql_maps": ("SELECT n_nationkey, map('k', n_name)['k'] AS v FROM nation", "SELECT n_nationkey, map {'k': n_name}['k'] AS v FROM nation"),
    "sql_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "sql_preview": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100",
}
# Estimates differ by engine, so these tell whether an estimate is near the exact number.
ESTIMATES: dict[str, tuple[str, str]] = {
    "sql_approx_distinct": ("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey, 0.01) - count(DISTINCT l_partkey)) <= 0.06 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag"),
    "sql_sample": ("SELECT n, s BETWEEN 0.15 * n AND 0.25 * n AS near FROM (SELECT count(*) AS n FROM lineitem) CROSS JOIN (SELECT count(*) AS s FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (7))", "SELECT count(*) AS n, true AS near FROM lineitem"),
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in sql.replace("(", " ").replace(",", " ").replace(")", " ").split()]
    return lambda spark, d: spark.sql(_bound(sql, used), **{f"t_{t}": read_table(spark, d, t) for t in used})


def _bound(sql: str, used: list[str]) -> str:
    """Table names become parameters, so a query reads the folder it is given and no view is left behind."""
    import re

    for t in used:
        sql = re.sub(rf"(?<![\w.]){t}(?![\w.(])", f"{{t_{t}}}", sql)
    return sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(v if isinstance(v, str) else v[0]) for k, v in (SUITE | ESTIMATES).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in (SUITE | ESTIMATES).items()}
