"""Graph operators on paths longer than any fixed number of rounds, and the page rank of all orders against brute force."""

import pytest

from tidemark.operators import graphs

PATH = 100


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([(i, i + 1) for i in range(PATH - 1)], "src long, dst long").coalesce(1)


def test_hops_on_a_long_path(path):
    assert {r["v"]: r["hops"] for r in graphs.hops(path, 0).collect()} == {i: i for i in range(PATH)}


def test_components_on_a_long_path(path):
    assert {r["v"]: r["component"] for r in graphs.connected(path).collect()} == dict.fromkeys(range(PATH), 0)


def test_trade_reads_all_orders(spark, tmp_path):
    tables = {
        "customer": ([(1, 0), (2, 1), (3, 9), (4, None)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 2), (2, 4), (3, 1)], "s_suppkey long, s_nationkey int"),
        "orders": ([(501, 1), (2, 2), (3, 3), (4, 3), (5, 4)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(501, 2), (501, 2), (2, 1), (2, 2), (3, 1), (4, 3), (5, 1)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(r) for r in graphs.trade(spark, str(tmp_path)).collect()} == {(0, 4), (1, 4), (9, 2)}


EDGES = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6), (7, 0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_page_rank(small):
    def brute(rounds, start=None):
        nodes = {x for e in EDGES for x in e}
        own = {v: 1.0 if start in (None, v) else 0.0 for v in nodes}
        rank = dict(own)
        for _ in range(rounds):
            rank = {v: 0.15 * own[v] + 0.85 * sum(rank[a] / sum(x == a for x, _ in EDGES) for a, b in EDGES if b == v) for v in nodes}
        return {v: pytest.approx(x, abs=1e-8) for v, x in rank.items()}

    got = lambda df: {r["v"]: r["rank"] for r in df.collect()}
    assert got(graphs.page_rank(small)) == brute(10)
    assert got(graphs.page_rank(small, 4, start=2)) == brute(4, 2)
    assert got(graphs.page_rank(small, close=1e-9)) == brute(200)


def test_strong_components(small):
    assert {r["v"]: r["component"] for r in graphs.strong(small).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_label_propagation(small):
    label = {x: x for e in EDGES for x in e}
    for _ in range(3):
        votes = {v: [label[a] for a, b in EDGES if b == v] + [label[b] for a, b in EDGES if a == v] for v in label}
        label = {v: min(x, key=lambda c, x=x: (-x.count(c), c)) for v, x in votes.items()}
    assert {r["v"]: r["label"] for r in graphs.label_propagation(small).collect()} == label
