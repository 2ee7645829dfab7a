"""Plans and odd inputs of relational operators that fail on larger tables only."""

import datetime

from tidemark import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def below(lines, name):
    """The lines under each node of this name."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if x.lstrip(" :+-").startswith(name):
            for y in lines[i + 1 :]:
                if depth(y) <= depth(x):
                    break
                yield y


def test_join_range_broadcasts_no_orders(spark, sf):
    sent = list(below(plan(catalog.queries()["join_range"](spark, sf)), "BroadcastExchange"))
    assert sent and not any("o_orderkey" in x for x in sent)


def test_join_range_on_odd_rows(spark, tmp_path, same):
    import duckdb

    day = lambda m, n: datetime.datetime(1996, m, n, 23, 59)
    orders = [(1, day(2, 20)), (1, day(2, 28)), (2, None), (None, day(3, 1)), (3, day(3, 4)), (4, day(2, 19)), (5, day(9, 9))]
    lines = [(1, day(3, 4)), (1, day(3, 4)), (2, None), (3, day(2, 28)), (9, day(3, 17)), (9, day(3, 18))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.execute(f"SET timezone = 'UTC'; CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(catalog.queries()["join_range"](spark, str(tmp_path)), duck, catalog.oracle_sql()["join_range"])


def test_join_salted_broadcasts_nothing(spark, sf):
    assert not list(below(plan(catalog.queries()["join_salted"](spark, sf)), "BroadcastExchange"))


def test_approx_count_distinct_keeps_one_sketch(spark, sf, tmp_path):
    x = catalog.queries()["approx_count_distinct"]
    lines = plan(x(spark, sf))
    assert any("approx_count_distinct" in y for y in lines) and not any("approx_count_distinct" in y and "keys=[l_partkey" in y for y in lines)
    for name, rows in {"odd": [(None,), (1,), (1,), (2,), (None,)], "none": []}.items():
        spark.createDataFrame(rows, "l_partkey long").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    assert [tuple(x(spark, f"{tmp_path}/{name}").first()) for name in ("odd", "none")] == [(2, True), (0, True)]
