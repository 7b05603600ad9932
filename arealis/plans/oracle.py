"""SQL that the catalogue queries must agree with, for DuckDB."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# the row hash of functions/split.py in SQL
_M, _A = 2147483647, 48271


def _step(state: str, value: str = "0") -> str:
    return f"((({state}) + (({value}) % {_M})) * {_A}) % {_M}"


def _hash(*ids: str, seed: int = 1) -> str:
    state = f"{seed}::BIGINT"
    for name in ids:
        state = _step(state, name)
    for _ in range(3):
        state = f"(({state}) * {_A}) % {_M}"
    return state


def _percentile(*ids: str) -> str:
    return f"(({_hash(*ids)}) * 100) // {_M}"


_LINE_SPLIT = f"""
  SELECT *, {_percentile("l_orderkey", "l_linenumber", "l_partkey")} AS place FROM lineitem
"""
_DAILY = """
  SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2
"""
_CUSTOMER_STATS = """
  SELECT c.*, o.order_total, o.order_count FROM customer c LEFT JOIN (
    SELECT o_custkey, sum(o_totalprice) AS order_total, count(*) AS order_count FROM orders GROUP BY 1
  ) o ON c.c_custkey = o.o_custkey
"""
# one feature, penalty 0.5 relative to the label's spread
_LINE_MODEL = """
  SELECT l_suppkey, slope, my - slope * mx AS intercept,
         greatest(vy - 2 * slope * sxy + slope * slope * vx, 0) AS mse, vy
  FROM (
    SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_extendedprice) AS vy,
           var_pop(l_quantity) AS vx, covar_pop(l_extendedprice, l_quantity) AS sxy,
           covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity)
             / (1 + 0.5 / stddev_pop(l_extendedprice)) AS slope
    FROM split WHERE place < 80 GROUP BY 1)
"""

ORACLE["count_tables"] = """
SELECT 0 AS ord, 'orders' AS name, count(*) AS n FROM orders
UNION ALL SELECT 1, 'customer', count(*) FROM customer
UNION ALL SELECT 2, 'events', count(*) FROM events
UNION ALL SELECT 3, 'orders', count(*) FROM orders
UNION ALL SELECT 4, 'nation', count(*) FROM nation
"""

ORACLE["scan_statistics_table"] = """
SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY 1
"""

ORACLE["match_project"] = """
SELECT o_orderkey, o_custkey, o_totalprice AS price, 'orders' AS source, round(o_totalprice / 2, 4) AS half_price
FROM orders WHERE o_orderstatus = 'F'
"""

ORACLE["match_operators"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus
FROM lineitem
WHERE l_quantity >= 5 AND l_quantity < 45 AND l_returnflag IN ('A', 'R')
  AND l_linestatus IS DISTINCT FROM 'X' AND NOT coalesce(l_suppkey IN (1, 2, 3), false)
  AND (l_discount > 0.05 OR l_tax <= 0.02 OR l_returnflag LIKE 'R%')
"""

ORACLE["match_dates"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS big FROM orders
WHERE o_orderdate >= TIMESTAMP '1994-02-01' AND o_orderdate < TIMESTAMP '1999-07-01'
  AND o_totalprice > 300000 AND NOT o_totalprice > 450000
  AND NOT coalesce(o_orderstatus = 'P', false) AND NOT coalesce(o_orderpriority LIKE '%LOW', false)
  AND o_custkey <> 7 AND o_custkey > 3
"""

ORACLE["drop_incomplete"] = f"""
SELECT c_custkey, c_acctbal, order_count FROM ({_CUSTOMER_STATS}) WHERE order_count IS NOT NULL
"""

ORACLE["group_accumulators"] = """
SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 4) AS sum_quantity,
       round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price,
       max(l_extendedprice) AS max_price, round(stddev_pop(l_quantity), 6) AS std_pop,
       round(stddev_samp(l_quantity), 6) AS std_samp, count(*) AS n
FROM lineitem GROUP BY 1, 2
"""

ORACLE["group_first_last"] = """
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price,
       arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
FROM orders GROUP BY 1
"""

ORACLE["group_push"] = """
SELECT o_custkey, 0::BIGINT AS part, count(*) OVER (PARTITION BY o_custkey) AS n,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place,
       o_orderkey, o_totalprice
FROM orders
"""

ORACLE["match_arrays"] = """
SELECT o_custkey, max(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY 1
HAVING o_custkey % 3 = 1 AND count(*) <> 2
   AND count(*) FILTER (WHERE o_totalprice > 150000 AND o_orderdate < TIMESTAMP '1999-01-01') > 0
   AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0
   AND regexp_matches(max(o_orderpriority), '^[1-4].*(low|not|high)', 'i')
"""

ORACLE["reader_options"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000"

ORACLE["group_push_cut"] = """
SELECT l_returnflag, (row_number() OVER w - 1) // 100 AS part, count(*) OVER (PARTITION BY l_returnflag) AS n,
       l_orderkey, l_linenumber, l_extendedprice
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber)
"""

ORACLE["group_add_to_set"] = """
SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1
"""

ORACLE["sort_limit"] = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10
"""

ORACLE["sort_by_count"] = 'SELECT l_suppkey, count(*) AS "count" FROM lineitem GROUP BY 1'

ORACLE["count_matching"] = "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25"

ORACLE["unwind"] = """
SELECT vec_id, place - 1 AS place, CAST(embedding[place] AS DOUBLE) AS component
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings)
"""

ORACLE["lookup"] = """
SELECT c_custkey, c_nationkey, count(o_orderkey) AS n_orders,
       CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS sum_keys
FROM customer LEFT JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey GROUP BY 1, 2
"""

ORACLE["union_with"] = """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier
"""

ORACLE["replace_root"] = "SELECT p_partkey, upper(p_name) AS p_name, p_size FROM part"

ORACLE["bucket"] = """
SELECT CASE WHEN o_totalprice >= 1000 AND o_totalprice < 50000 THEN '1000'
            WHEN o_totalprice >= 50000 AND o_totalprice < 100000 THEN '50000'
            WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN '100000'
            WHEN o_totalprice >= 200000 AND o_totalprice < 400000 THEN '200000'
            ELSE 'other' END AS bucket,
       count(*) AS n, round(avg(o_totalprice), 4) AS avg_price
FROM orders GROUP BY 1
"""

def _bucket_auto(table: str, column: str, n: int) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY b) - 1 AS bucket, lo AS min, hi AS max, rows AS count FROM (
  SELECT b, CASE WHEN count(v) = count(*) THEN min(v) END AS lo, max(v) AS hi, count(*) AS rows FROM (
    SELECT {column} AS v, ((rank() OVER (ORDER BY {column} NULLS FIRST) - 1) * {n}) // count(*) OVER () AS b FROM {table})
  GROUP BY b)
"""


ORACLE["bucket_auto"] = _bucket_auto("orders", "o_totalprice", 8)
ORACLE["bucket_auto_nulls"] = _bucket_auto(
    "orders", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END", 5
)
ORACLE["bucket_auto_ties"] = _bucket_auto("lineitem", "l_quantity", 7)

ORACLE["sample_rows"] = f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash("o_orderkey", seed=7)}, o_orderkey LIMIT 100
"""

ORACLE["sample_rows_random"] = f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {_hash("o_orderkey", "o_custkey", seed=7)}, o_orderkey, o_custkey LIMIT 100
"""

ORACLE["moving_average"] = f"""
SELECT user_id, day, round(avg, 6) AS avg FROM (
  SELECT user_id, day,
         avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg,
         row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn
  FROM ({_DAILY})) WHERE rn >= 7
"""

ORACLE["moving_average_large_keys"] = """
SELECT event_type, ts, round(avg, 6) AS avg FROM (
  SELECT event_type, ts,
         avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                          ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS avg,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn >= 25
"""

ORACLE["moving_average_docs"] = f"""
WITH daily AS ({_DAILY}),
windows AS (
  SELECT user_id, day,
         avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg,
         row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn
  FROM daily),
starts AS (SELECT user_id, min(day) AS start FROM daily GROUP BY 1)
SELECT s.user_id, 0::BIGINT AS part, 7 AS "numDays", s.start AS "startDate", w.rn - 7 AS place,
       w.day AS date, round(w.avg, 6) AS avg
FROM starts s LEFT JOIN (SELECT * FROM windows WHERE rn >= 7) w ON s.user_id = w.user_id
"""

ORACLE["moving_average_docs_cut"] = """
WITH windows AS (
  SELECT event_type, ts, min(ts) OVER (PARTITION BY event_type) AS start,
         avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS avg,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events)
SELECT event_type, (rn - 25) // 200 AS part, 25 AS "numDays", start AS "startDate", (rn - 25) % 200 AS place,
       ts AS date, round(avg, 6) AS avg
FROM windows WHERE rn >= 25
"""

ORACLE["requested_keys"] = """
WITH asked AS (
  SELECT CAST(i - 1 AS INTEGER) AS ord, CAST(keys[i] AS INTEGER) AS c_nationkey FROM (
    SELECT keys, unnest(range(1, len(keys) + 1)) AS i
    FROM (SELECT list_concat([99, 3], list_concat(range(0, 25), [3, -1])) AS keys)))
SELECT ord, a.c_nationkey, n_customers
FROM asked a LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) c
  ON a.c_nationkey = c.c_nationkey
"""

ORACLE["requested_keys_table"] = """
WITH asked AS (
  SELECT -c_custkey AS ord, c_custkey AS o_custkey FROM customer
  UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT -c_custkey - 10000000, c_custkey + 10000000 FROM customer)
SELECT ord, o_custkey, n, spent FROM asked
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (o_custkey)
"""

ORACLE["array_window_means"] = """
SELECT vec_id, CAST(len(embedding) - 7 AS BIGINT) AS n_windows, CAST(len(embedding) - 7 AS BIGINT) AS n_range,
       round(list_sum(CAST(embedding[1:8] AS DOUBLE[])) / 8, 6) AS first_mean,
       round(list_sum(CAST(embedding[-8:] AS DOUBLE[])) / 8, 6) AS last_mean,
       round(CAST(embedding[13] AS DOUBLE), 6) AS thirteenth
FROM embeddings
"""

ORACLE["range_average"] = """
SELECT round(avg(o_totalprice), 4) AS avg FROM orders
WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-25' AND DATE '1997-02-04'
"""

ORACLE["date_range"] = """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-10' GROUP BY 1
"""

ORACLE["time_bucket_agg"] = """
SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS bucket, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n
FROM orders
WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderstatus = 'F'
GROUP BY 1
"""

ORACLE["time_bucket_dimensions"] = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, l_returnflag, l_linestatus,
       sum(l_quantity) AS quantity, count(*) AS n
FROM lineitem
WHERE (l_shipdate >= TIMESTAMP '1993-01-01' AND l_shipdate < TIMESTAMP '1995-01-01')
   OR (l_shipdate >= TIMESTAMP '1996-06-01' AND l_shipdate < TIMESTAMP '2000-01-01')
GROUP BY 1, 2, 3
"""

ORACLE["time_bucket_hours"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(sum(value), 6) AS total, count(*) AS n
FROM events GROUP BY 1
"""

ORACLE["time_bucket_filled"] = """
WITH weeks AS (
  SELECT CAST(unnest(generate_series(DATE '1995-01-09', DATE '1996-02-29', INTERVAL 7 DAY)) AS DATE) AS bucket
  UNION SELECT CAST(unnest(generate_series(DATE '1997-05-26', DATE '1997-06-19', INTERVAL 7 DAY)) AS DATE)),
found AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS bucket, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity,
         round(avg(l_extendedprice), 4) AS mean_price
  FROM lineitem
  WHERE l_quantity = 7 AND ((l_shipdate >= TIMESTAMP '1995-01-10' AND l_shipdate < TIMESTAMP '1996-03-01')
                         OR (l_shipdate >= TIMESTAMP '1997-06-01' AND l_shipdate < TIMESTAMP '1997-06-20')) GROUP BY 1, 2)
SELECT bucket, l_returnflag, coalesce(n, 0) AS n, coalesce(quantity, 0) AS quantity, mean_price
FROM (SELECT bucket, l_returnflag FROM weeks, (SELECT DISTINCT l_returnflag FROM found)) LEFT JOIN found USING (bucket, l_returnflag)
"""

ORACLE["top_n_per_bucket"] = """
SELECT bucket, user_id, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, user_id) AS rank
  FROM (SELECT CAST(ts AS DATE) AS bucket, user_id, count(*) AS n FROM events GROUP BY 1, 2))
WHERE rank <= 3
"""

_LATEST = """
  SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus, nullif(o_totalprice, 0.0) AS c_acctbal,
         CAST(o_orderdate AS DATE) AS o_orderdate
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""
_SUPPLIERS = """
  SELECT s_nationkey AS nation, s_suppkey, s_name, s_acctbal
  FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1
"""
_RICH = """
  SELECT CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nation, c_custkey,
         CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS s_acctbal
  FROM customer
"""
_RICH_ONE = f"""
  SELECT * FROM ({_RICH}) WHERE nation IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY nation ORDER BY c_custkey DESC) = 1
"""
_TOTALS = """
  SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 4) AS order_total, count(*) AS order_count
  FROM orders GROUP BY 1
"""

ORACLE["compound_inner"] = f"""
SELECT c.c_custkey, c_name, c_nationkey, coalesce(c.c_acctbal, o.c_acctbal) AS c_acctbal,
       o_orderkey, o_orderstatus, o_orderdate
FROM customer c JOIN ({_LATEST}) o ON c.c_custkey = o.c_custkey
"""

ORACLE["compound_left"] = f"""
SELECT r.nation, r.c_custkey, coalesce(r.s_acctbal, s.s_acctbal) AS s_acctbal, s_suppkey, s_name
FROM ({_RICH_ONE}) r LEFT JOIN ({_SUPPLIERS}) s ON r.nation = s.nation
UNION ALL SELECT nation, c_custkey, s_acctbal, NULL, NULL FROM ({_RICH}) WHERE nation IS NULL
"""

ORACLE["compound_right"] = f"""
SELECT r.nation, s_suppkey, s_name, coalesce(s.s_acctbal, r.s_acctbal) AS s_acctbal, r.c_custkey
FROM ({_SUPPLIERS}) s RIGHT JOIN ({_RICH_ONE}) r ON r.nation = s.nation
UNION ALL SELECT nation, NULL, NULL, s_acctbal, c_custkey FROM ({_RICH}) WHERE nation IS NULL
"""

ORACLE["compound_full"] = f"""
SELECT coalesce(s.nation, r.nation) AS nation, s_suppkey, s_name,
       coalesce(s.s_acctbal, r.s_acctbal) AS s_acctbal, r.c_custkey
FROM ({_SUPPLIERS}) s FULL JOIN ({_RICH_ONE}) r ON r.nation = s.nation
UNION ALL SELECT nation, NULL, NULL, s_acctbal, c_custkey FROM ({_RICH}) WHERE nation IS NULL
"""

ORACLE["compound_nested"] = f"""
SELECT c.c_custkey, c_name, c_nationkey, coalesce(c.c_acctbal, o.c_acctbal) AS c_acctbal,
       o_orderkey, o_orderstatus, order_total, order_count
FROM customer c JOIN ({_LATEST}) o ON c.c_custkey = o.c_custkey JOIN ({_TOTALS}) t ON c.c_custkey = t.c_custkey
"""

ORACLE["compound_nested_second"] = f"""
SELECT t.c_custkey, order_total, order_count, o_orderkey, o_orderstatus, j.c_acctbal, c_name, c_nationkey
FROM ({_TOTALS}) t LEFT JOIN (
  SELECT coalesce(o.c_custkey, c.c_custkey) AS c_custkey, o_orderkey, o_orderstatus,
         coalesce(o.c_acctbal, c.c_acctbal) AS c_acctbal, c_name, c_nationkey
  FROM ({_LATEST}) o FULL JOIN customer c ON o.c_custkey = c.c_custkey) j ON t.c_custkey = j.c_custkey
"""

ORACLE["compound_single"] = f"""
SELECT * FROM ({_RICH_ONE}) UNION ALL SELECT * FROM ({_RICH}) WHERE nation IS NULL
"""

ORACLE["compound_quoted_keys"] = """
SELECT n_name AS name, n_nationkey, count(*) AS n_customers
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
"""

ORACLE["minmax_bounds"] = """
SELECT min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
       min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
       min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max
FROM lineitem
"""

ORACLE["minmax_scale"] = """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - q0) / (q1 - q0), 6) AS quantity,
       round((l_extendedprice - p0) / (p1 - p0), 6) AS price
FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1,
                       min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem)
"""

ORACLE["prepare_features"] = f"""
WITH complete AS (SELECT * FROM ({_CUSTOMER_STATS}) WHERE c_acctbal IS NOT NULL AND order_total IS NOT NULL)
SELECT c_custkey, round((c_acctbal - a0) / (a1 - a0), 6) AS c_acctbal,
       round((order_total - t0) / (t1 - t0), 6) AS order_total,
       round((order_count - n0) / (n1 - n0), 6) AS order_count
FROM complete, (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1, min(order_total) AS t0, max(order_total) AS t1,
                       min(order_count) AS n0, max(order_count) AS n1 FROM complete)
"""

_COMPLETE = f"SELECT * FROM ({_CUSTOMER_STATS}) WHERE c_acctbal IS NOT NULL AND order_total IS NOT NULL"

ORACLE["kmeans_entities"] = f"SELECT c_custkey, true AS in_range FROM ({_COMPLETE})"

ORACLE["kmeans_invariants"] = f"""
SELECT count(*) AS entities, 10::BIGINT AS clusters, 0::BIGINT AS misplaced, true AS closer, true AS no_worse_than_reported FROM ({_COMPLETE})
"""

ORACLE["bisecting_invariants"] = f"""
SELECT count(*) AS entities, count(DISTINCT c_custkey) AS keys, 10::BIGINT AS clusters FROM ({_COMPLETE})
"""

ORACLE["mixture_invariants"] = f"""
SELECT count(*) AS entities, 0::BIGINT AS misplaced, 4::BIGINT AS components, 1::DOUBLE AS weights, true AS symmetric FROM ({_COMPLETE})
"""

ORACLE["lda_invariants"] = f"SELECT count(*) AS entities, 0::BIGINT AS uneven, 0::BIGINT AS misplaced FROM ({_COMPLETE})"

ORACLE["power_iteration_vertices"] = """
SELECT id, true AS in_range
FROM (SELECT l_suppkey * 2 AS id FROM lineitem UNION SELECT l_partkey * 2 + 1 FROM lineitem)
"""

ORACLE["train_test_split"] = f"""
SELECT CASE WHEN place < 80 THEN 'train' ELSE 'test' END AS side, l_suppkey, count(*) AS n
FROM ({_LINE_SPLIT}) GROUP BY 1, 2
"""

ORACLE["linear_regression_by_key"] = f"""
WITH split AS ({_LINE_SPLIT})
SELECT l_suppkey, 0 AS total_iterations, round(sqrt(mse), 4) AS rmse, round(1 - mse / vy, 6) AS r2,
       round(intercept, 4) AS intercept, round(slope, 6) AS slope
FROM ({_LINE_MODEL})
"""

ORACLE["linear_regression_two_features"] = f"""
WITH split AS ({_LINE_SPLIT}),
moments AS (
  SELECT l_suppkey, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
         var_pop(l_quantity) * (1 + 0.5 / stddev_pop(l_extendedprice)) AS a,
         var_pop(l_discount) * (1 + 0.5 / stddev_pop(l_extendedprice)) AS d,
         covar_pop(l_quantity, l_discount) AS b,
         covar_pop(l_extendedprice, l_quantity) AS s1, covar_pop(l_extendedprice, l_discount) AS s2
  FROM split WHERE place < 80 GROUP BY 1),
model AS (
  SELECT l_suppkey, w1, w2, my - w1 * m1 - w2 * m2 AS intercept
  FROM (SELECT *, (d * s1 - b * s2) / (a * d - b * b) AS w1, (a * s2 - b * s1) / (a * d - b * b) AS w2 FROM moments))
SELECT s.l_suppkey, round(sqrt(avg(pow(l_extendedprice - intercept - w1 * l_quantity - w2 * l_discount, 2))), 4) AS rmse,
       round(1 - avg(pow(l_extendedprice - intercept - w1 * l_quantity - w2 * l_discount, 2))
               / var_pop(l_extendedprice), 6) AS r2,
       round(any_value(intercept), 4) AS intercept, round(any_value(w1), 4) AS slope_quantity,
       round(any_value(w2), 4) AS slope_discount
FROM split s JOIN model m ON s.l_suppkey = m.l_suppkey WHERE place < 80 GROUP BY 1
"""

# coordinate descent in units of the spreads: correlations r1, r2 with the price, c between the features
ORACLE["linear_regression_iterative"] = """
WITH RECURSIVE moments AS (
  SELECT l_suppkey, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
         stddev_pop(l_quantity) AS a1, stddev_pop(l_discount) AS a2, stddev_pop(l_extendedprice) AS b,
         corr(l_extendedprice, l_quantity) AS r1, corr(l_extendedprice, l_discount) AS r2, corr(l_quantity, l_discount) AS c,
         5.0 / stddev_pop(l_extendedprice) * 0.4 AS lasso, 1 + 5.0 / stddev_pop(l_extendedprice) * 0.6 AS d
  FROM lineitem GROUP BY 1),
sweep(l_suppkey, step, w1, w2) AS (
  SELECT l_suppkey, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM moments
  UNION ALL
  SELECT l_suppkey, step, w1, sign(r2 - c * w1) * greatest(abs(r2 - c * w1) - lasso, 0) / d
  FROM (SELECT s.l_suppkey, step + 1 AS step, sign(r1 - c * w2) * greatest(abs(r1 - c * w2) - lasso, 0) / d AS w1, r2, c, lasso, d
        FROM sweep s JOIN moments m ON s.l_suppkey = m.l_suppkey WHERE step < 60)),
model AS (
  SELECT m.l_suppkey, w1 * b / a1 AS w1, w2 * b / a2 AS w2, my - w1 * b / a1 * m1 - w2 * b / a2 * m2 AS intercept
  FROM moments m JOIN sweep s ON m.l_suppkey = s.l_suppkey WHERE step = 60)
SELECT l.l_suppkey, round(sqrt(avg(pow(l_extendedprice - intercept - w1 * l_quantity - w2 * l_discount, 2))), 3) AS rmse,
       round(1 - avg(pow(l_extendedprice - intercept - w1 * l_quantity - w2 * l_discount, 2)) / var_pop(l_extendedprice), 6) AS r2,
       round(any_value(intercept), 3) AS intercept, round(any_value(w1), 4) AS slope_quantity, round(any_value(w2), 3) AS slope_discount
FROM lineitem l JOIN model m ON l.l_suppkey = m.l_suppkey GROUP BY 1
"""

ORACLE["linear_regression_elastic_net"] = """
WITH moments AS (
  SELECT l_suppkey, avg(l_discount) AS mx, avg(l_extendedprice) AS my, var_pop(l_discount) AS vx,
         covar_pop(l_extendedprice, l_discount) AS s, stddev_samp(l_extendedprice) AS b FROM lineitem GROUP BY 1),
model AS (
  SELECT l_suppkey, slope, my - slope * mx AS intercept
  FROM (SELECT *, sign(s) * greatest(abs(s) - 10 * 0.5, 0) / (vx + 10 * 0.5 / b) AS slope FROM moments))
SELECT l.l_suppkey, 1 AS total_iterations, round(sqrt(avg(pow(l_extendedprice - intercept - slope * l_discount, 2))), 4) AS rmse,
       round(any_value(intercept), 4) AS intercept, round(any_value(slope), 4) AS slope
FROM lineitem l JOIN model m ON l.l_suppkey = m.l_suppkey GROUP BY 1
"""

ORACLE["linear_regression_with_test"] = f"""
WITH split AS ({_LINE_SPLIT})
SELECT s.l_suppkey, round(sqrt(any_value(mse)), 4) AS rmse, round(any_value(slope), 6) AS slope, count(*) AS test_n,
       round(sqrt(avg(pow(l_extendedprice - intercept - slope * l_quantity, 2))), 4) AS test_rmse,
       round(1 - avg(pow(l_extendedprice - intercept - slope * l_quantity, 2)) / var_pop(l_extendedprice), 6) AS test_r2
FROM split s JOIN ({_LINE_MODEL}) m ON s.l_suppkey = m.l_suppkey WHERE place >= 80 GROUP BY 1
"""

ORACLE["linear_regression_through_origin"] = """
WITH model AS (
  SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS slope
  FROM lineitem GROUP BY 1),
fitted AS (
  SELECT l.l_returnflag, round(sqrt(avg(pow(l_extendedprice - slope * l_quantity, 2))), 4) AS rmse,
         round(1 - sum(pow(l_extendedprice - slope * l_quantity, 2)) / sum(l_extendedprice * l_extendedprice), 6) AS r2,
         CAST(0 AS DOUBLE) AS intercept, round(any_value(slope), 6) AS slope
  FROM lineitem l JOIN model m ON l.l_returnflag = m.l_returnflag GROUP BY 1)
SELECT asked.l_returnflag, rmse, r2, intercept, slope
FROM (VALUES ('R'), ('A'), ('N'), ('none')) asked(l_returnflag) LEFT JOIN fitted USING (l_returnflag)
"""

ORACLE["random_forest_stump"] = f"""
WITH split AS ({_LINE_SPLIT}),
train AS (SELECT l_suppkey, l_quantity, l_extendedprice FROM split WHERE place < 80),
whole AS (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice) AS s, avg(l_extendedprice) AS m FROM train GROUP BY 1),
cut AS (
  SELECT DISTINCT l_suppkey, l_quantity AS edge, count(*) OVER w AS nl, sum(l_extendedprice - m) OVER w AS sl, n, m
  FROM train JOIN whole USING (l_suppkey) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)),
best AS (
  SELECT l_suppkey, arg_max(edge, gain) AS edge, arg_max(m + sl / nl, gain) AS below, arg_max(m - sl / (n - nl), gain) AS above
  FROM (SELECT *, sl * sl / nl + sl * sl / (n - nl) AS gain FROM cut WHERE nl >= 3 AND n - nl >= 3) GROUP BY 1)
SELECT s.l_suppkey, count(*) AS test_n,
       round(sqrt(avg(pow(l_extendedprice - CASE WHEN l_quantity <= edge THEN below ELSE above END, 2))), 3) AS rmse,
       round(1 - avg(pow(l_extendedprice - CASE WHEN l_quantity <= edge THEN below ELSE above END, 2)) / var_pop(l_extendedprice), 5) AS r2
FROM split s JOIN best b ON s.l_suppkey = b.l_suppkey WHERE place >= 80 GROUP BY 1
"""

ORACLE["random_forest_all_suppliers"] = f"""
WITH split AS ({_LINE_SPLIT}) SELECT l_suppkey, count(*) AS test_n, true AS measured FROM split WHERE place >= 70 GROUP BY 1
"""

ORACLE["gbt_held_out"] = f"""
WITH split AS ({_LINE_SPLIT})
SELECT asked.l_returnflag, n AS test_n FROM (VALUES ('R'), ('N'), ('none'), ('A')) asked(l_returnflag)
LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM split WHERE place >= 60 GROUP BY 1) USING (l_returnflag)
"""

ORACLE["score_by_key"] = f"""
WITH split AS ({_LINE_SPLIT})
SELECT l_orderkey, l_linenumber, l_partkey, round(intercept + slope * l_quantity, 4) AS prediction
FROM split s LEFT JOIN ({_LINE_MODEL}) m ON s.l_suppkey = m.l_suppkey WHERE place >= 80
"""

_METRICS = f"""
WITH split AS ({_LINE_SPLIT})
SELECT s.l_suppkey, count(*) AS n, round(sqrt(avg(pow(l_extendedprice - intercept - slope * l_quantity, 2))), 4) AS rmse,
       round(1 - avg(pow(l_extendedprice - intercept - slope * l_quantity, 2)) / var_pop(l_extendedprice), 6) AS r2
FROM split s JOIN ({_LINE_MODEL}) m ON s.l_suppkey = m.l_suppkey WHERE place >= 80 GROUP BY 1
"""
ORACLE["regression_metrics_by_key"] = _METRICS
ORACLE["linear_metrics_by_key"] = _METRICS


def _crossing(x1: float, y1: float, x2: float, y2: float) -> str:
    return (
        f"CAST((({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - ({x1})) / CAST({y2} - ({y1}) AS DOUBLE)"
        f" * (lat - ({y1})) + ({x1}) AS INTEGER)"
    )


_CORNERS = [(-0.2, -0.1), (0.2, -0.2), (0.05, 0.0), (0.15, 0.25), (-0.15, 0.15)]
ORACLE["points_within"] = f"""
SELECT vec_id FROM (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)
WHERE ({" + ".join(_crossing(*a, *b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))}) % 2 = 1
"""

ORACLE["json_rows"] = """
SELECT CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus,
                                o_orderpriority := o_orderpriority)) AS VARCHAR) AS json
FROM orders
"""

ORACLE["json_rows_with_defaults"] = f"""
SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, order_count := coalesce(order_count, 0)))
            AS VARCHAR) AS json
FROM ({_CUSTOMER_STATS})
"""

ORACLE["json_documents"] = """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing
FROM events
"""

ORACLE["explode_json_objects_array"] = """
SELECT event_id, 2::BIGINT AS n, 2 * CAST(json_extract(props, '$.k') AS BIGINT) AS sum_k FROM events
"""

ORACLE["explode_json_objects_single"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
"""
