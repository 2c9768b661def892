"""Queries of the driver contract, each with the SQL that DuckDB runs on the same tables.

Most are one text for both engines. Sums and averages of doubles are rounded, as their order differs.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import models, onnx_file
from tidewell.operators import knn as knn_
from tidewell.operators import vector_index
from tidewell.plans.pipeline import Engine, Pipeline
from tidewell.sources import docstore, jdbc, kvstore
from tidewell.sources.context import Access, Source
from tidewell.streaming.windows import windowed_counts

TABLES = "region nation customer supplier part orders lineitem events embeddings documents".split()
Query = Callable[[SparkSession, str], DataFrame]

#: name: SQL of both engines, or (Spark's, DuckDB's).
SQL: dict[str, str | tuple[str, str]] = {
    # projection, filters, predicates
    "project_alias": "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part",
    "select_star": "SELECT * FROM nation",
    "quoted_identifiers": 'SELECT n."n_name" AS "Name", n."n_nationkey" FROM nation AS n WHERE "n_regionkey" = 1',
    "constant_scan": "SELECT 1 AS id, 'test' AS name",
    "literal_in_select": "SELECT 'x' AS tag, n_nationkey FROM nation",
    "arithmetic": ("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber % 3 AS m, l_linenumber / 2 AS h, CAST(l_linenumber AS DOUBLE) / 2 AS f FROM lineitem",
                   "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber % 3 AS m, (l_linenumber // 2)::BIGINT AS h, CAST(l_linenumber AS DOUBLE) / 2 AS f FROM lineitem"),
    "casts": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderkey AS INT) AS k, CAST(o_orderkey AS VARCHAR) AS s, o_custkey::varchar AS v, o_custkey::double precision AS d, CAST(o_totalprice AS FLOAT) AS f FROM orders",
    "pattern_operators": "SELECT p_partkey, p_name ~ '.*(ar|el).*' AS m, p_name !~ '.*(ar|el).*' AS n, p_brand SIMILAR TO 'Brand#1.' AS t FROM part",
    "default_null_order": "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING'), c_custkey) AS r FROM customer",
    "comparisons": "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size <> 20 AND (p_retailprice > 1000 OR p_brand = 'Brand#11') AND 1 = 1",
    "in_like_between": "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 13) AND p_name LIKE '%a%' AND p_retailprice BETWEEN 900 AND 1500 AND NOT p_brand ILIKE '%#5_'",
    "is_null_distinct": "SELECT c_custkey, c_mktsegment IS NULL AS a, c_mktsegment IS NOT NULL AS b, nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL AS c FROM customer",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders",
    "time_range": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-06 00:00:00'",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(l_extendedprice) * 3 FROM lineitem WHERE l_quantity > (SELECT min(l_quantity) FROM lineitem))",
    "exists_subquery": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "not_exists_subquery": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, round(t, 2) AS t FROM a WHERE t > 100000) SELECT c.c_name, b.t FROM b JOIN customer c ON c.c_custkey = b.o_custkey",
    "recursive_cte": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE n > 10",
    "values_relation": "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
    "generate_series": "SELECT n FROM generate_series(1, 100, 7) AS t(n)",
    "range_table": "SELECT n FROM range(1, 100, 7) AS t(n)",
    "unnest_table": "SELECT x FROM unnest([3, 1, 2]) AS t(x)",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left_summary": "SELECT c.c_custkey, count(o.o_orderkey) AS n, round(coalesce(sum(o.o_totalprice), 0), 2) AS spent FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_full": "SELECT a.c_custkey AS ca, b.s_suppkey AS sb FROM customer a FULL JOIN (SELECT * FROM supplier WHERE s_suppkey > 50) b ON a.c_custkey = b.s_suppkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT n_nationkey, x FROM nation JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS x FROM supplier GROUP BY s_nationkey) USING (n_nationkey)",
    "join_natural": "SELECT n_nationkey, n_name, k FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey * 2 AS k FROM nation)",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_cast_key": "SELECT count(*) AS n FROM orders o JOIN customer c ON CAST(o.o_custkey AS STRING) = CAST(c.c_custkey AS STRING)",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "join_right_semi": ("SELECT c.c_custkey FROM orders o RIGHT SEMI JOIN customer c ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_right_anti": ("SELECT c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT ANTI JOIN customer c ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"),
    "join_theta": "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN nation n ON s.s_nationkey <= n.n_nationkey AND s.s_acctbal > n.n_nationkey * 100 GROUP BY s.s_suppkey",
    "join_lateral": "SELECT n.n_nationkey, t.top FROM nation n, LATERAL (SELECT max(s.s_acctbal) AS top FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t",
    "unnest": "SELECT vec_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY vec_id",
    "federated_join_agg": "WITH lines AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey) SELECT c.c_mktsegment AS segment, count(o.o_orderkey) AS orders, round(sum(l.revenue), 2) AS revenue, max(o.o_orderpriority) AS last_priority FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lines l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment",
    # aggregates
    "group_by_many": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_aggregate": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, round(avg(o_totalprice), 4) AS p FROM orders",
    "count_distinct_many": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "aggregate_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rollup": ("SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_discount), 8) AS vs, round(var_pop(l_discount), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
    "median_percentile": ("SELECT o_orderpriority, round(median(o_totalprice), 4) AS m, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS m, round(quantile_cont(o_totalprice, 0.9), 4) AS p FROM orders GROUP BY o_orderpriority"),
    "bool_bit_aggregates": "SELECT p_brand, bool_and(p_size > 1) AS a, bool_or(p_size > 49) AS o, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY p_brand",
    "string_agg_ordered": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "approximate": ("SELECT o_orderpriority, approx_percentile_cont(o_totalprice, 0.5) AS p, approx_distinct(o_orderstatus) AS d, approx_median(o_totalprice) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p, count(DISTINCT o_orderstatus) AS d, quantile_disc(o_totalprice, 0.5) AS m FROM orders GROUP BY o_orderpriority"),
    "array_agg_ordered": "SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey",
    "array_agg_keys": "SELECT p_brand, array_agg(nullif(p_size, 7) ORDER BY p_type DESC, p_size, p_partkey) AS sizes FROM part GROUP BY p_brand",
    # windows
    "window_ranks": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_ntile": ("SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS q FROM orders", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders"),
    "window_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a FROM events",
    "window_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part",
    "window_groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part",
    "window_filter": "SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 1000) OVER (PARTITION BY o_custkey), 2) AS s, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
    "qualify_top1": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    # order, limits, sets
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20",
    "order_nulls": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer ORDER BY s ASC NULLS LAST, c_custkey",
    "limit_in_cte": "WITH t AS (SELECT * FROM events ORDER BY event_id LIMIT 512) SELECT event_type, count(*) AS n FROM t GROUP BY event_type",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    # functions
    "fn_conditional": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, ifnull(nullif(c_nationkey, 3), -1) AS b, greatest(c_nationkey, 5) AS g, least(c_nationkey, 5) AS l FROM customer",
    "fn_math": ("SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 6) AS s, round(cbrt(p_size), 6) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(ln(p_size), 6) AS n, round(log(p_size), 6) AS t, round(power(p_size, 1.5), 4) AS p, CAST(signum(p_size - 10) AS INT) AS sg, round(sin(p_size), 6) AS si, round(degrees(p_size), 4) AS d, round(exp(p_size / 10.0), 3) AS e, trunc(p_retailprice) AS tr, gcd(p_size, 12) AS gc, lcm(p_size, 4) AS lc FROM part",
                "SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 6) AS s, round(cbrt(p_size), 6) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(ln(p_size), 6) AS n, round(log(p_size), 6) AS t, round(power(p_size, 1.5), 4) AS p, CAST(sign(p_size - 10) AS INT) AS sg, round(sin(p_size), 6) AS si, round(degrees(p_size), 4) AS d, round(exp(p_size / 10.0), 3) AS e, trunc(p_retailprice) AS tr, gcd(p_size, 12) AS gc, lcm(p_size, 4) AS lc FROM part"),
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substr(p_name, 2, 4) AS s, replace(p_name, 'a', 'b') AS r, reverse(p_brand) AS v, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim('  x ') AS t, split_part(p_type, ' ', 1) AS sp, starts_with(p_brand, 'Brand') AS sw, concat(p_brand, NULL, p_name) AS c, left(p_name, 3) AS le, right(p_name, 3) AS ri, ascii(p_name) AS asc_, repeat('ab', 3) AS rep, translate(p_brand, 'Bd', 'Xy') AS tr, strpos(p_name, 'e') AS pos, lower(to_hex(p_partkey)) AS hx, levenshtein(p_brand, 'Brand#1') AS lev FROM part",
    "fn_regex": ("SELECT p_partkey, regexp_like(p_name, '[aeiou]{2}') AS m, regexp_replace(p_type, '[A-Z]', '.') AS r, regexp_replace(p_type, '([A-Z])', '<\\1>', 'g') AS g, regexp_match(p_brand, '([A-Za-z]+)#([0-9]+)') AS x, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS c FROM part", "SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS m, regexp_replace(p_type, '[A-Z]', '.') AS r, regexp_replace(p_type, '([A-Z])', '<\\1>', 'g') AS g, [regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1), regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)] AS x, len(regexp_extract_all(p_name, '[aeiou]')) AS c FROM part"),
    "fn_date": ("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, to_char(o_orderdate, '%Y-%m') AS f, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS BIGINT) AS n, make_date(2024, 2, 29) AS x FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, extract(day FROM o_orderdate) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, strftime(o_orderdate, '%Y-%m') AS f, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS n, make_date(2024, 2, 29) AS x FROM orders"),
    "fn_date_bin": ("SELECT date_bin(INTERVAL '15 minutes', ts) AS bin, count(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin, count(*) AS n FROM events GROUP BY 1"),
    "fn_array": ("SELECT n_nationkey, array_length(a) AS n, array_has(a, 3) AS h, array_element(a, 1) AS f, array_to_string(transform(a, x -> CAST(x AS STRING)), '-') AS j, array_slice(a, 2, 3) AS s, array_distinct(a) AS d, array_position(a, 3) AS p, array_position(a, 99) AS z, array_reverse(a) AS r, flatten(make_array(a, make_array(9))) AS fl, array_has_all(a, [3, 7]) AS al, array_has_any(a, [99]) AS an, array_concat(a, [1]) AS cc, array_append(a, 5) AS ap, array_remove(a, 3) AS rm FROM (SELECT n_nationkey, [n_regionkey, 3, n_regionkey, 7] AS a FROM nation)", "SELECT n_nationkey, len(a) AS n, list_contains(a, 3) AS h, a[1] AS f, array_to_string(a, '-') AS j, a[2:3] AS s, CASE WHEN a[1] = 3 THEN [3, 7] ELSE [a[1], 3, 7] END AS d, CAST(list_position(a, 3) AS BIGINT) AS p, CAST(NULL AS BIGINT) AS z, list_reverse(a) AS r, flatten([a, [9]]) AS fl, list_has_all(a, [3, 7]) AS al, list_has_any(a, [99]) AS an, list_concat(a, [1]) AS cc, list_append(a, 5) AS ap, CASE WHEN a[1] = 3 THEN [3, 3, 7] ELSE [a[1], a[1], 7] END AS rm FROM (SELECT n_nationkey, [n_regionkey, 3, n_regionkey, 7] AS a FROM nation)"),
    "fn_struct_map": ("SELECT n_nationkey, named_struct('k', n_regionkey, 'v', n_name).v AS v, element_at(map('a', n_regionkey, 'b', 2), 'a') AS m, map_keys(map('a', 1, 'b', 2)) AS ks FROM nation", "SELECT n_nationkey, {'k': n_regionkey, 'v': n_name}.v AS v, map(['a', 'b'], [n_regionkey, 2])['a'] AS m, map_keys(map(['a', 'b'], [1, 2])) AS ks FROM nation"),
    "fn_hash": ("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, digest(c_name, 'sha256') AS d, encode(CAST(c_name AS BINARY), 'base64') AS b, lower(to_hex(c_custkey)) AS h FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha256(c_name) AS d, base64(c_name::BLOB) AS b, lower(to_hex(c_custkey)) AS h FROM customer"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "fn_type": ("SELECT arrow_typeof(n_nationkey) AS t, arrow_typeof(n_name) AS s, arrow_cast(n_nationkey, 'Float64') AS d FROM nation", "SELECT 'Int32' AS t, 'Utf8' AS s, CAST(n_nationkey AS DOUBLE) AS d FROM nation"),
    "time_bucket": ("SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"),
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
}


def views(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Register the tables of sf_dir, those that sql names if it is given."""
    words = set(re.findall(r"\w+", sql.lower())) if sql else None
    for t in TABLES:
        if words is None or t in words:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql_query(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return Engine(spark).sql(text)

    return run


def _for_duckdb(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")


PRODUCT_SEARCH = """metadata:
  name: order-search
  version: 1.0.0
query: |
  SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS price
  FROM orders
  WHERE ({priority} IS NULL OR o_orderpriority = {priority})
    AND ({min_price} IS NULL OR o_totalprice >= {min_price})
    AND ({max_price} IS NULL OR o_totalprice <= {max_price})
  ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT {limit}
"""


def _pipeline(request: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, [Source("orders", "parquet", path=f"{sf_dir}/orders.parquet")])
        return engine.execute(engine.prepare(Pipeline.parse(PRODUCT_SEARCH)), request)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline({"priority": "1-URGENT", "min_price": 1000, "max_price": None, "limit": 100})(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _knn(metric: str, where: str | None = None, k: int = 10) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _vectors(spark, sf_dir)
        near = knn_.knn(v, "embedding", v.filter("vec_id = 7").select("embedding"), k, where, metric)
        return near.select("vec_id", (F.round(F.col("_distance").cast("double"), 4) + F.lit(0.0)).alias("distance"))

    return run


def _knn_sql(metric: str, where: str = "TRUE", k: int = 10) -> str:
    q = "(SELECT list_transform(embedding, lambda c: c::DOUBLE) FROM embeddings WHERE vec_id = 7)"
    x = "list_transform(embedding, lambda c: c::DOUBLE)"
    d = {
        "l2": f"list_distance({x}, {q}) ^ 2",
        "cosine": f"1 - list_dot_product({x}, {q}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({q}, {q})))",
        "dot": f"1 - list_dot_product({x}, {q})",
    }[metric]
    return f"SELECT vec_id, round(CAST(CAST(d AS FLOAT) AS DOUBLE), 4) + 0.0::DOUBLE AS distance FROM (SELECT vec_id, {d} AS d FROM embeddings WHERE {where}) ORDER BY d, vec_id LIMIT {k}"


def knn_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of a vector that a subquery finds, without that vector, joined with their labels."""
    engine = Engine(spark, [Source("embeddings", "vectors", path=f"{sf_dir}/embeddings.parquet")])
    return engine.sql("""SELECT n.vec_id, n.label FROM lance_knn('embeddings', 'embedding', (SELECT embedding FROM embeddings WHERE vec_id = 3), 8, 'label < 8') AS n
                         WHERE n.vec_id <> 3""")


def knn_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return knn_.knn(v, "embedding", v.filter("vec_id < 0").select("embedding"), 5).select("vec_id", "label")


def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors, and a search that reads all of its cells, which is exact."""
    v = _vectors(spark, sf_dir)
    index = vector_index.build(v, "embedding", f"{_folder(spark)}/index")
    near = index.search(v.filter("vec_id = 7").first()["embedding"], 10, probes=len(index.cells))
    return near.select("vec_id", (F.round(F.col("_distance").cast("double"), 4) + F.lit(0.0)).alias("distance"))


def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    models.register_linear(spark, "lin", 2.0, 1.0)
    views(spark, sf_dir, "lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, CAST(lin(CAST(l_quantity AS FLOAT)) AS DOUBLE) AS y FROM lineitem")


def cached_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, [Source("nation_cached", "parquet", path=f"{sf_dir}/nation.parquet", enable_cache=True)])
    return engine.sql("SELECT n_regionkey, count(*) AS n FROM nation_cached GROUP BY n_regionkey")


def path_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT n_name, r_name FROM '{sf_dir}/nation.parquet' n JOIN '{sf_dir}/region.parquet' r ON n.n_regionkey = r.r_regionkey")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; in local mode one of this machine, which goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/catalog-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="catalog-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of customers, written by COPY, joined with Parquet."""
    at = f"{_folder(spark)}/customers.csv"
    engine = Engine(spark, [Source("orders", "parquet", path=f"{sf_dir}/orders.parquet")])
    engine.sql(f"COPY (SELECT c_custkey, c_name, c_nationkey FROM '{sf_dir}/customer.parquet') TO '{at}' STORED AS CSV")
    engine = Engine(spark, [Source("people", "csv", path=at, options={"schema_infer_max_records": "100"}), *engine.sources])
    return engine.sql("SELECT p.c_nationkey, count(*) AS n FROM people p JOIN orders o ON o.o_custkey = p.c_custkey GROUP BY p.c_nationkey")


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline-delimited JSON, written by COPY and named by an external table."""
    at, engine = f"{_folder(spark)}/events.json", Engine(spark)
    engine.sql(f"COPY (SELECT event_id, event_type, value FROM '{sf_dir}/events.parquet') TO '{at}' (FORMAT json)")
    engine.sql(f"CREATE EXTERNAL TABLE told STORED AS JSON LOCATION '{at}'")
    return engine.sql("SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM told GROUP BY event_type")


def created_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.sql(f"CREATE TABLE by_nation AS SELECT s_nationkey, count(*) AS n FROM '{sf_dir}/supplier.parquet' GROUP BY s_nationkey")
    return engine.sql("SELECT n.n_name, b.n FROM by_nation b JOIN '" + sf_dir + "/nation.parquet' n ON n.n_nationkey = b.s_nationkey")


def jdbc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT ... SELECT into a database (Derby, in memory), an UPDATE and a DELETE there, and a join with Parquet."""
    url = f"jdbc:derby:memory:shop{uuid.uuid4().hex};create=true"
    jdbc.Database(spark, url).execute("CREATE TABLE spent (id INT GENERATED ALWAYS AS IDENTITY, custkey BIGINT, orders BIGINT)")
    spent = Source("spent", "jdbc", connection_string=url, options={"dbtable": "spent"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [Source("orders", "parquet", path=f"{sf_dir}/orders.parquet"), Source("customer", "parquet", path=f"{sf_dir}/customer.parquet"), spent])
    engine.sql("INSERT INTO spent (custkey, orders) SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey")
    engine.sql("UPDATE spent SET orders = 0 WHERE orders < {least}", {"least": 5})
    engine.sql("DELETE FROM spent WHERE custkey > {most}", {"most": 1000})
    return engine.sql("SELECT c.c_mktsegment, s.orders, count(*) AS n FROM spent s JOIN customer c ON c.c_custkey = s.custkey GROUP BY c.c_mktsegment, s.orders")


def documents_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents upserted twice by key, and read back."""
    root = _folder(spark)
    docstore.upsert(spark.sql("SELECT '0' AS code, 'first' AS name, 0 AS region"), root, "nations", "code")
    store = Source("nations", "mongo", connection_string=root, options={"collection": "nations", "primary_key": "code"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [store, Source("nation", "parquet", path=f"{sf_dir}/nation.parquet")])
    engine.sql("INSERT INTO nations (code, name, region) SELECT CAST(n_nationkey AS STRING), n_name, n_regionkey FROM nation")
    return engine.sql("SELECT code, name FROM nations WHERE region < 3")


def hashes_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of a key-value store, replaced by INSERT OVERWRITE and read back as text."""
    root = _folder(spark)
    kvstore.write(spark.sql("SELECT 'x' AS code, 'old' AS name, '0' AS region"), root, "nations", "code")
    store = Source("nations", "redis", connection_string=root, options={"table": "nations", "key_column": "code"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [store, Source("nation", "parquet", path=f"{sf_dir}/nation.parquet")])
    engine.sql("INSERT OVERWRITE nations (code, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return Engine(spark, [store]).sql("SELECT code, name, region FROM nations")


def iceberg_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Iceberg table of two data files, written in its format, whose column has been renamed since."""
    from tidewell.sources import iceberg_table

    root = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    iceberg_table.write(nation.repartition(2, "n_nationkey"), f"{root}/db/nations", renamed={"n_name": "label"})
    engine = Engine(spark, [Source("nations", "iceberg", path=root, options={"namespace": "db", "table": "nations"})])
    return engine.sql("SELECT n_nationkey, label FROM nations WHERE n_regionkey <> 2")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), width="6 hours")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _model(spark: SparkSession) -> str:
    """A model file beside the shared tables; models are read by the workers as files."""
    folder = _folder(spark).removeprefix("file://")
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "sum.onnx").write_bytes(onnx_file.sum_of_two())
    return f"{folder}/sum.onnx"


def onnx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, [Source("nation", "parquet", path=f"{sf_dir}/nation.parquet")])
    return engine.sql(f"SELECT n_nationkey, CAST(onnx_predict('{_model(spark)}', n_nationkey, n_regionkey) AS DOUBLE) AS score FROM nation")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of common table expressions, a vector search by a parameter, and a model."""
    engine = Engine(spark, [Source("embeddings", "vectors", path=f"{sf_dir}/embeddings.parquet"), Source("nation", "parquet", path=f"{sf_dir}/nation.parquet")])
    pipeline = Pipeline.parse(f"""metadata: {{name: recommend, version: 1.0.0}}
query: |
  WITH seen AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = {{item}}),
  near AS (
    SELECT k.vec_id, k.label, k._distance
    FROM lance_knn('embeddings', 'embedding', (SELECT embedding FROM seen WHERE vec_id = (SELECT max(vec_id) FROM seen)), {{k}}) AS k
    WHERE k.vec_id <> {{item}}),
  scored AS (SELECT vec_id, label, onnx_predict('{_model(spark)}', CAST({{person}} AS BIGINT), vec_id) AS score FROM near)
  SELECT s.vec_id, n.n_name, CAST(s.score AS DOUBLE) AS score FROM scored s JOIN nation n ON n.n_nationkey = s.label
  ORDER BY s.score DESC, s.vec_id LIMIT {{limit}}
""")
    return engine.execute(engine.prepare(pipeline), {"item": 5, "k": 20, "person": 1000, "limit": 6})


_NEAREST = """SELECT vec_id, label FROM embeddings
  ORDER BY list_distance(list_transform(embedding, lambda c: c::DOUBLE), (SELECT list_transform(embedding, lambda c: c::DOUBLE) FROM embeddings WHERE vec_id = 5)), vec_id LIMIT 20"""
_DONE = "SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE {} ORDER BY o_totalprice NULLS LAST, o_orderkey {}"


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, text in SQL.items():
        found[name] = _sql_query(text if isinstance(text, str) else text[0])
    return found | {
        "pipeline_filters": _pipeline({"priority": "1-URGENT", "min_price": 50000, "max_price": 90000.5, "limit": None}),
        "pipeline_all_null": _pipeline({"priority": None, "min_price": None, "max_price": None, "limit": None}),
        "pipeline_limit": _pipeline({"priority": None, "min_price": None, "max_price": None, "limit": 20}),
        "knn_l2": _knn("l2"), "knn_cosine": _knn("cosine"), "knn_dot": _knn("dot"), "knn_prefilter": _knn("l2", "label = 3", 5),
        "knn_table_function": knn_table_function, "knn_empty_query": knn_empty_query, "knn_index": knn_index,
        "linear_model": linear_model, "cached_source": cached_source, "path_in_sql": path_in_sql,
        "csv_source": csv_source, "json_source": json_source, "created_table": created_table, "jdbc_source": jdbc_source, "documents_source": documents_source,
        "hashes_source": hashes_source, "iceberg_source": iceberg_source, "windowed_events": windowed_events, "onnx_scores": onnx_scores, "recommendations": recommendations,
    }


def oracle_sql() -> dict[str, str]:
    found = {name: _for_duckdb(text if isinstance(text, str) else text[1]) for name, text in SQL.items()}
    return found | {
        "pipeline_filters": _DONE.format("o_orderpriority = '1-URGENT' AND o_totalprice >= 50000 AND o_totalprice <= 90000.5", ""),
        "pipeline_all_null": _DONE.format("TRUE", ""),
        "pipeline_limit": _DONE.format("TRUE", "LIMIT 20"),
        "knn_l2": _knn_sql("l2"), "knn_cosine": _knn_sql("cosine"), "knn_dot": _knn_sql("dot"), "knn_prefilter": _knn_sql("l2", "label = 3", 5),
        "knn_table_function": "SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings WHERE label < 8 ORDER BY list_distance(list_transform(embedding, lambda c: c::DOUBLE), (SELECT list_transform(embedding, lambda c: c::DOUBLE) FROM embeddings WHERE vec_id = 3)), vec_id LIMIT 8) WHERE vec_id <> 3",
        "knn_empty_query": "SELECT vec_id, label FROM embeddings WHERE FALSE",
        "knn_index": _knn_sql("l2"),
        "linear_model": "SELECT l_orderkey, l_linenumber, CAST(CAST(2 * CAST(l_quantity AS FLOAT) + 1 AS FLOAT) AS DOUBLE) AS y FROM lineitem",
        "cached_source": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey",
        "path_in_sql": "SELECT n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        "csv_source": "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey",
        "json_source": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY event_type",
        "created_table": "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
        "jdbc_source": "SELECT c_mktsegment, orders, count(*) AS n FROM (SELECT o_custkey, CASE WHEN count(*) < 5 THEN 0 ELSE count(*) END AS orders FROM orders WHERE o_custkey <= 1000 GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, orders",
        "documents_source": "SELECT n_nationkey::VARCHAR AS code, n_name AS name FROM nation WHERE n_regionkey < 3",
        "hashes_source": "SELECT n_nationkey::VARCHAR AS code, n_name AS name, n_regionkey::VARCHAR AS region FROM nation",
        "iceberg_source": "SELECT n_nationkey, n_name AS label FROM nation WHERE n_regionkey <> 2",
        "windowed_events": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "onnx_scores": "SELECT n_nationkey, (n_nationkey + n_regionkey)::DOUBLE AS score FROM nation",
        "recommendations": f"SELECT vec_id, n_name, (1000 + vec_id)::DOUBLE AS score FROM ({_NEAREST}) JOIN nation ON n_nationkey = label WHERE vec_id <> 5 ORDER BY score DESC, vec_id LIMIT 6",
    }
