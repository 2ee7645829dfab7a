"""Graph operators on edge tables (src, dst). The queries' graph links nations that trade: customer's to supplier's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tables, written

EDGES = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey - 1 OR c_nationkey = s_nationkey + 7"


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nations (customer's, supplier's) in all orders whose keys are apart by more than one upwards, or by seven downwards."""
    x = tables(spark, d, "orders", "customer", "lineitem", "supplier")
    buys = x["orders"].join(x["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    sells = x["lineitem"].join(x["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst")).distinct()
    pairs = buys.join(sells, F.col("o_orderkey") == F.col("l_orderkey")).where("src < dst - 1 OR src = dst + 7")
    return written(pairs.select("src", "dst").distinct(), "edges")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).groupBy("x.v").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def page_rank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, start: int | None = None, close: float | None = None) -> DataFrame:
    """rank = reset + (1 - reset) * sum of rank / out degree over incoming edges, from 1, for a number of rounds.

    start: personalized, only this node gets reset, and starts at 1, others at 0. close: goes on, whatever rounds is,
    until no rank changes by more.
    """
    nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    own = F.lit(1.0) if start is None else F.when(F.col("v") == start, 1.0).otherwise(0.0)
    weighted = written(edges.join(edges.groupBy("src").agg(F.count("*").alias("n")), "src"), "weighted")
    rank = written(nodes.select("v", own.alias("rank"), own.alias("own")), "rank")
    while rounds > 0 or close is not None:
        rounds -= 1
        got = weighted.join(rank, F.col("src") == F.col("v")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        new = written(rank.join(got, F.col("v") == F.col("dst"), "left").select("v", (reset * F.col("own") + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"), "own", F.col("rank").alias("old")), "rank")
        rank = new.drop("old")
        if close is not None and new.where(F.abs(F.col("rank") - F.col("old")) > close).isEmpty():
            break
    return rank.select("v", "rank")


def pregel(nodes: DataFrame, edges: DataFrame, message: Callable, merge: Callable, update: Callable) -> DataFrame:
    """nodes (v, value), edges (src, dst): per round, message(value) goes along edges, merge(column) joins what a node gets, update(value, got) is its new value; ends when none changes, however many rounds that takes."""
    state = written(nodes, "pregel")
    while True:
        got = edges.join(state, F.col("src") == F.col("v")).groupBy("dst").agg(merge(message(F.col("value"))).alias("got"))
        new = state.join(got, F.col("v") == F.col("dst"), "left").select("v", F.col("value").alias("old"), F.coalesce(update(F.col("value"), F.col("got")), "value").alias("value"))
        new = written(new, "pregel")
        state = new.drop("old")
        if new.where("NOT (old <=> value)").isEmpty():
            return state


def connected(edges: DataFrame) -> DataFrame:
    """Each node's component, the least node in it. A round takes the least label of a node's neighbours, then that label's own, so that rounds grow with the logarithm of a path's length."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both-ways")
    state = written(both.select(F.col("src").alias("v")).distinct().withColumn("value", F.col("v")), "labels")
    while True:
        got = both.join(state, F.col("src") == F.col("v")).groupBy("dst").agg(F.min("value").alias("got"))
        new = written(state.join(got, F.col("v") == F.col("dst"), "left").select("v", F.col("value").alias("old"), F.least("value", "got").alias("value")), "labels")
        far = new.select(F.col("v").alias("of"), F.col("value").alias("far"))
        new = written(new.join(far, F.col("value") == F.col("of")).select("v", "old", F.least("value", "far").alias("value")), "labels")
        state = new.drop("old")
        if new.where("old <> value").isEmpty():
            return state.select("v", F.col("value").alias("component"))


def strong(edges: DataFrame) -> DataFrame:
    """Each node's strongly connected component, the least node in it.

    Per pass every node takes the least node that reaches it; the nodes of that colour that reach it back are its
    component and leave. Passes go on until no node is left.
    """
    left = written(edges.select("src", "dst").where("src <> dst").distinct(), "left")
    nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    found = None
    while True:
        colour = pregel(nodes.withColumn("value", F.col("v")), left, lambda x: x, F.min, lambda old, got: F.least(old, got)).select("v", F.col("value").alias("c"))
        inside = left.join(colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        mark = pregel(colour.select("v", (F.col("v") == F.col("c")).cast("int").alias("value")), back, lambda x: x, F.max, lambda old, got: F.greatest(old, got))
        done = written(mark.where("value = 1").join(colour, "v").select("v", F.col("c").alias("component")), "done")
        found = done if found is None else found.unionByName(done)
        nodes = written(nodes.join(done, "v", "left_anti"), "nodes")
        if nodes.isEmpty():
            return found
        left = written(left.join(nodes.select(F.col("v").alias("src")), "src", "left_semi").join(nodes.select(F.col("v").alias("dst")), "dst", "left_semi"), "left")


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Each node's label after a number of rounds: the one that most of its neighbours, both ways, have; of several the least. Labels begin as nodes."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")), "both-ways")
    state = written(both.select(F.col("src").alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    for _ in range(rounds):
        votes = both.join(state, F.col("src") == F.col("v")).groupBy("dst", "label").agg(F.count("*").alias("n"))
        state = written(votes.groupBy(F.col("dst").alias("v")).agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("label")), "labels")
    return state


def hops(edges: DataFrame, start: int) -> DataFrame:
    """Least number of edges from start; nodes that cannot be reached have null."""
    nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().withColumn("value", F.when(F.col("v") == start, 0))
    return pregel(nodes, edges, lambda x: x + 1, F.min, lambda old, got: F.least(old, got)).select("v", F.col("value").alias("hops"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles through each node, directions apart. Edges run from the node of lower degree, so that no node has many."""
    one = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = one.select(F.col("a").alias("v")).union(one.select("b")).groupBy("v").count()
    x = one.join(deg.select(F.col("v").alias("a"), F.col("count").alias("ca")), "a").join(deg.select(F.col("v").alias("b"), F.col("count").alias("cb")), "b")
    first = F.struct("ca", "a") < F.struct("cb", "b")
    x = written(x.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t")), "oriented")
    wedge = x.join(x.select(F.col("s"), F.col("t").alias("u")), "s").where("t < u")
    closed = wedge.join(one, (F.least("t", "u") == F.col("a")) & (F.greatest("t", "u") == F.col("b")))
    return closed.select(F.explode(F.array("s", "t", "u")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))


WITH = f"WITH RECURSIVE e AS ({EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT src AS v FROM b)"


def rank_sql(rounds: int, start: int | None) -> str:
    own = "1.0::DOUBLE" if start is None else f"CASE WHEN v = {start} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    steps = [f"r0 AS (SELECT v, {own} AS rank FROM v)"]
    for i in range(rounds):
        got = f"SELECT dst, sum(rank / n) AS got FROM r{i} JOIN w ON src = v GROUP BY dst"
        steps.append(f"r{i + 1} AS (SELECT v, 0.15::DOUBLE * {own} + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM v LEFT JOIN ({got}) g ON v = dst)")
    return f"{WITH}, w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e), {', '.join(steps)} SELECT v, round(rank, 8) AS rank FROM r{rounds}"


def labels_sql(rounds: int) -> str:
    steps = ["both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)", "l0 AS (SELECT v, v AS label FROM v)"]
    steps += [f"l{i + 1} AS (SELECT dst AS v, label FROM (SELECT dst, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS r FROM both_ways JOIN l{i} ON src = v GROUP BY dst, label) x WHERE r = 1)" for i in range(rounds)]
    return f"{WITH}, {', '.join(steps)} SELECT v, label FROM l{rounds}"


REACH = f"{WITH}, p AS (SELECT v AS a, v AS b FROM v UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b)"
FRAMES: dict[str, tuple[Callable, str | None]] = {
    "graph_degrees": (lambda s, d: degrees(trade(s, d)), f"{WITH} SELECT v, (SELECT count(*) FROM e WHERE src = v) AS out_degree, (SELECT count(*) FROM e WHERE dst = v) AS in_degree FROM v"),
    "graph_page_rank": (lambda s, d: page_rank(trade(s, d)).select("v", F.round("rank", 8).alias("rank")), rank_sql(10, None)),
    "graph_page_rank_personalized": (lambda s, d: page_rank(trade(s, d), 8, start=3).select("v", F.round("rank", 8).alias("rank")), rank_sql(8, 3)),
    "graph_page_rank_dynamic": (lambda s, d: page_rank(trade(s, d), close=1e-9).select("v", F.round("rank", 6).alias("rank")), rank_sql(150, None).replace("round(rank, 8)", "round(rank, 6)")),
    "graph_connected_components": (lambda s, d: connected(trade(s, d)), f"{WITH}, r AS (SELECT v, v AS c FROM v UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.v) SELECT v, min(c) AS component FROM r GROUP BY v"),
    "graph_strong_components": (lambda s, d: strong(trade(s, d)), f"{REACH} SELECT p.a AS v, min(p.b) AS component FROM p JOIN p AS q ON p.a = q.b AND p.b = q.a GROUP BY p.a"),
    "graph_label_propagation": (lambda s, d: label_propagation(trade(s, d)), labels_sql(3)),
    "graph_shortest_paths": (lambda s, d: hops(trade(s, d), 1), f"{WITH}, r AS (SELECT 1 AS v, 0 AS h UNION SELECT e.dst, h + 1 FROM r JOIN e ON e.src = r.v WHERE h < 25) SELECT v.v, min(h) AS hops FROM v LEFT JOIN r ON r.v = v.v GROUP BY v.v"),
    "graph_triangles": (lambda s, d: triangles(trade(s, d)), f"{WITH} SELECT x.src AS v, (count(*) // 2)::BIGINT AS triangles FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src GROUP BY 1"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: x for n, (_, x) in FRAMES.items() if x}
