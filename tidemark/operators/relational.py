"""Relational operators: projection, joins, aggregation, windows, sorting and set operations.

SQL holds statements that mean the same in both engines; FRAME holds DataFrame forms with their SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import tables

L = "CAST(l_extendedprice AS DECIMAL(18,2))"
SQL = {
    # projection, filter, subqueries
    "project": "SELECT l_orderkey, l_linenumber, l_partkey + 1 AS next_part, l_quantity * 2 AS twice FROM lineitem",
    "filter_and_or_not": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 400000 OR o_orderpriority LIKE '1%') AND NOT o_orderstatus = 'F'",
    "subquery_alias": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 15",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM c WHERE n >= 3",
    "one_row": "SELECT 1 AS a, 'x' AS b, CAST(NULL AS INT) AS c",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders)",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "between_in": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_type IN ('PROMO', 'SMALL')",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_right": "SELECT n_name, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = 2 * s_suppkey",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "join_anti_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join_theta": "SELECT a.r_name AS lesser, b.r_name AS greater FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "join_theta_left": "SELECT a.n_name AS a, b.r_name AS b FROM nation a LEFT JOIN region b ON a.n_nationkey < b.r_regionkey",
    "join_cross_dimensions": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_residual": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate WHERE o_totalprice > 480000",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_null_safe": "SELECT count(*) AS n FROM (SELECT nullif(p_size % 7, 0) AS k FROM part) a JOIN (SELECT nullif(n_nationkey % 7, 0) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k",
    "join_using": "SELECT n_nationkey, n_name, m FROM nation JOIN (SELECT n_nationkey, n_regionkey AS m FROM nation) x USING (n_nationkey)",
    # aggregation
    "group_by": f"SELECT l_suppkey, count(*) AS n, CAST(sum({L}) AS DOUBLE) AS total, min(l_shipdate) AS first_ship, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey",
    "aggregate_global": f"SELECT count(*) AS n, CAST(sum({L}) AS DOUBLE) AS total, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem",
    "aggregate_empty": "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_tax) AS m FROM lineitem WHERE l_quantity < 0",
    "avg_decimal": f"SELECT l_returnflag, CAST(sum({L}) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY l_returnflag",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 16",
    "count_nulls": "SELECT count(*) AS a, count(nullif(p_size, 10)) AS b FROM part",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sum_distinct": "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_brand",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size < 5 GROUP BY CUBE (p_brand, p_type)",
    "grouping_sets": "SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "filtered_aggregate": "SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_type = 'PROMO') AS promo FROM part GROUP BY p_brand",
    "conditional_aggregate": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(*) AS n FROM events GROUP BY user_id",
    "bool_aggregates": "SELECT p_brand, bool_and(p_size > 1) AS every_one, bool_or(p_size > 49) AS any_one FROM part GROUP BY p_brand",
    "max_by_min_by": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS most, min_by(o_orderkey, o_totalprice) AS least FROM orders GROUP BY o_custkey",
    "bit_aggregates": "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY p_brand",
    "group_by_expression": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    # windows
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "window_ranks": "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "window_cume_percent": "SELECT p_partkey, round(cume_dist() OVER w, 9) AS c, round(percent_rank() OVER w, 9) AS p FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "window_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS q FROM orders",
    "window_lag_lead": "SELECT event_id, lag(event_id, 1) OVER w AS before, lead(event_id, 2, -1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_running_sum": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders",
    "window_rows_frame": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM orders",
    "window_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part",
    "window_default_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, count(*) OVER (PARTITION BY p_brand) AS whole FROM part",
    "window_top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 2",
    # sort, limit, sets
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_nulls_first": "SELECT p_partkey, k FROM (SELECT p_partkey, nullif(p_size, 7) AS k FROM part) x ORDER BY k ASC NULLS FIRST, p_partkey LIMIT 60",
    "limit_offset": "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 10",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "union_distinct": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0",
    "intersect_all": "SELECT p_size AS k FROM part INTERSECT ALL SELECT n_nationkey AS k FROM nation",
    "except_distinct": "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey AS k FROM nation",
    "except_all": "SELECT p_size AS k FROM part EXCEPT ALL SELECT n_nationkey AS k FROM nation",
    "except_keeping_copies": "SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_size)",
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    import re

    from ..session import TABLES

    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = tables(spark, sf_dir, *names) if names else {}
        marked = re.sub(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 {\2}", text) if names else text
        return spark.sql(marked, **used)

    return run


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, name)[name]


def broadcast_join(spark, d):
    """nation has a fixed 25 rows, so that it may always be broadcast."""
    return t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def merge_join(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def hash_join(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def salted_join(spark, d, salts: int = 8):
    """A join whose left keys may be very uneven: left rows are salted by a hash, right rows repeated for each salt.

    Both sides are shuffled: Spark's estimate of the right one does not count the repeats and would let it be broadcast.
    """
    left = t(spark, d, "events").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    right = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), ["user_id", "salt"]).select("event_id", "n")


def as_of_join(spark, d):
    """The last purchase of the user at or before each error: both sides in one window, no pairs."""
    e = t(spark, d, "events").where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "last_purchase")


def range_join(spark, d):
    """Lines shipped in each order's two weeks.

    Lines are counted by day, and a day's lines are added to the 14 order days that they count for, so that an order
    meets one sum. Only these sums, a row a day of the calendar at most, are repeated and broadcast; orders are neither.
    """
    days = t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("ship")).agg(F.count("*").alias("lines"))
    sums = days.select(F.explode(F.sequence(F.date_sub("ship", 13), "ship")).alias("day"), "lines").groupBy("day").agg(F.sum("lines").alias("lines"))
    o = t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(sums), "day").groupBy("o_orderkey").agg(F.sum("lines").alias("n"))


def pivot(spark, d):
    return t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


def unpivot(spark, d):
    return t(spark, d, "part").unpivot("p_partkey", [F.col("p_brand"), F.col("p_type")], "field", "value")


def crosstab(spark, d):
    """A column for each line status there is."""
    x = t(spark, d, "lineitem").stat.crosstab("l_returnflag", "l_linestatus")
    return x.withColumnRenamed("l_returnflag_l_linestatus", "l_returnflag")


def na_drop(spark, d):
    return t(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s")).na.drop(subset=["s"])


def na_fill(spark, d):
    return t(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s")).na.fill({"s": -1})


def na_replace(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_type").na.replace(["PROMO", "SMALL"], ["P", "S"], "p_type")


def explode_arrays(spark, d):
    return t(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


def explode_outer(spark, d):
    return t(spark, d, "part").select("p_partkey", F.explode_outer(F.when(F.col("p_size") > 25, F.split("p_name", " "))).alias("word"))


def collect_sets(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


def stats(spark, d):
    one = lambda c: F.round(c, 6)
    return t(spark, d, "part").agg(one(F.stddev("p_size")).alias("sd"), one(F.var_pop("p_size")).alias("vp"), one(F.corr("p_size", "p_retailprice")).alias("r"), one(F.covar_samp("p_size", "p_retailprice")).alias("c"), F.percentile("p_size", 0.5).alias("median"))


def approx_distinct(spark, d):
    """The exact count, and whether the sketch of all rows is within 5 % of it.

    Counted apart: in one aggregation with an exact distinct count Spark keeps a sketch for each distinct value.
    """
    x = t(spark, d, "lineitem").select("l_partkey")
    sketch = x.agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"))
    exact = x.distinct().agg(F.count("l_partkey").alias("parts"))
    return exact.crossJoin(sketch).select("parts", (F.abs(F.col("a") - F.col("parts")) <= 0.05 * F.col("parts")).alias("near"))


def freq_items(spark, d):
    """Values with at least an eighth of all rows, by partial counts."""
    x = t(spark, d, "events")
    n = x.count()
    return x.groupBy("event_type").count().where(F.col("count") * 8 >= n).select("event_type", F.col("count").alias("n"))


def sort_within(spark, d):
    return t(spark, d, "orders").repartition(8, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))


def with_columns(spark, d):
    return t(spark, d, "nation").withColumn("double_key", F.col("n_nationkey") * 2).withColumnRenamed("n_name", "name").drop("n_regionkey")


def session_windows(spark, d):
    """Runs of a user's events no more than 6 hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"), F.lit(True)).cast("int")
    return t(spark, d, "events").withColumn("new", gap).withColumn("s", F.sum("new").over(w)).groupBy("user_id", "s").agg(F.count("*").alias("n")).select("user_id", F.col("s").cast("long").alias("s"), "n")


def tumbling(spark, d):
    return t(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


FRAME: dict[str, tuple[Callable, str | None]] = {
    "join_broadcast": (broadcast_join, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_sort_merge": (merge_join, "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "join_shuffled_hash": (hash_join, "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_salted": (salted_join, "SELECT event_id, n FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) x USING (user_id)"),
    "join_as_of": (as_of_join, "SELECT e.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'error'"),
    "join_range": (range_join, "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_shipdate::DATE >= o_orderdate::DATE AND l_shipdate::DATE < o_orderdate::DATE + 14 GROUP BY 1"),
    "pivot": (pivot, "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1"),
    "unpivot": (unpivot, "SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part"),
    "stat_crosstab": (crosstab, "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1"),
    "na_drop": (na_drop, "SELECT p_partkey, p_size AS s FROM part WHERE p_size <> 7"),
    "na_fill": (na_fill, "SELECT p_partkey, CASE WHEN p_size = 7 THEN -1 ELSE p_size END AS s FROM part"),
    "na_replace": (na_replace, "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'P' WHEN 'SMALL' THEN 'S' ELSE p_type END AS p_type FROM part"),
    "explode_positions": (explode_arrays, "SELECT p_partkey, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::INT AS pos, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "explode_outer": (explode_outer, "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 25"),
    "collect_set": (collect_sets, "SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) x GROUP BY 1"),
    "statistics": (stats, "SELECT round(stddev(p_size), 6) AS sd, round(var_pop(p_size), 6) AS vp, round(corr(p_size, p_retailprice), 6) AS r, round(covar_samp(p_size, p_retailprice), 6) AS c, quantile_cont(p_size, 0.5) AS median FROM part"),
    "approx_count_distinct": (approx_distinct, "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey) >= 0 AS near FROM lineitem"),
    "frequent_items": (freq_items, "SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) * 8 >= (SELECT count(*) FROM events)"),
    "sort_within_partitions": (sort_within, "SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1"),
    "with_columns": (with_columns, "SELECT n_nationkey, n_name AS name, n_nationkey * 2 AS double_key FROM nation"),
    "session_window": (session_windows, "SELECT user_id, s::BIGINT AS s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY 1, 2"),
    "tumbling_window": (tumbling, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def queries() -> dict:
    return {**{n: _sql(x) for n, x in SQL.items()}, **{n: f for n, (f, _) in FRAME.items()}}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **{n: x for n, (_, x) in FRAME.items() if x}}
