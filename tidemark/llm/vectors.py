"""Embedding near-duplicates: a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table, written
from .components import components
from .jaccard import grouped

COSINE = 0.95
#: The clusters are fitted on so many vectors at most.
SAMPLE = 8192
CLUSTERS = 1024
#: Clusters a vector belongs to, and those that its search visits at first.
OVERLAP, PROBES = 2, 6
#: Vectors of a shard; a larger cluster is dealt into several. Searches of one task.
SHARD, SEARCHES = 512, 1024
DEGREE, ALPHA, BEAM, SLACK = 16, 1.2, 8, 0.08
AUDIT, RECALL = 256, 0.99
#: Pairs of vectors whose similarities are computed at once.
PAIRS = 1 << 15
NEAR = "array<struct<node: bigint, of: array<int>>>"
NODE = "node long, dim int, vector binary, times long"


def nodes(rows: DataFrame) -> DataFrame:
    """(id, vector array<double>) to distinct usable vectors: the least id of its copies, bytes of the unit vector, copies."""
    usable = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    # equal numbers have equal keys: -0.0 + 0.0 is 0.0
    return usable.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))


def unit(v):
    import numpy as np

    x = np.asarray(v, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def centres(found: DataFrame, n: int, dim: int):
    """Unit vectors in the middle of clusters: a few rounds of spherical k-means over a bounded sample."""
    import numpy as np

    share = min(1.0, SAMPLE / max(1, n))
    # at most twice the bound, should the hash draw more
    sample = found.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share * (1 << 20))).select("node", "vector").limit(2 * SAMPLE).toArrow().sort_by("node")
    x = np.frombuffer(b"".join(sample.column("vector").to_pylist()), np.float64).reshape(-1, dim)
    if not len(x):
        return np.zeros((0, dim))
    k = int(min(CLUSTERS, max(1, n // 256), len(x)))
    c = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
    for _ in range(5):
        own = (x @ c.T).argmax(axis=1)
        c = np.zeros((k, dim))
        np.add.at(c, own, x)
        norm = np.sqrt((c * c).sum(axis=1))
        c[norm == 0] = x[np.random.default_rng(6).choice(len(x), int((norm == 0).sum()))]
        c /= np.sqrt((c * c).sum(axis=1))[:, None]
    return c


def graph(x):
    """Neighbours of each vector of a shard, both ways: from the nearest on, one that is nearer to a kept one, by ALPHA, is pruned."""
    import numpy as np

    n = len(x)
    sims = x @ x.T
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    near = np.argsort(-sims, axis=1, kind="stable")
    out: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        left = near[i][near[i] != i]
        kept = 0
        while len(left) and kept < DEGREE:
            j = int(left[0])
            out[i].add(j)
            out[j].add(i)
            kept += 1
            left = left[1:]
            left = left[ALPHA * far[j, left] > far[i, left]]
    return out


def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (cluster, shard, node, dim, vector) in order of the first two: each vector's neighbours in the shard."""
    import numpy as np

    for shard in grouped(batches, 2):
        node = shard.column("node").to_numpy()
        x = np.frombuffer(b"".join(shard.column("vector").to_pylist()), np.float64).reshape(len(node), -1)
        links = graph(x)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([node[sorted(s)].tolist() for s in links], pa.list_(pa.int64()))], ["node", "near"])


def search(cosine: float):
    """For mapInArrow over a shard's vectors (seeks false) and those that search it: found counts, connecting links, ways on.

    A search starts at the medoid and at each of a few far vectors, goes on from the best it has seen while that may
    get better, and from all it has seen within SLACK of the range. Similarities are those of vectors it has reached.
    A vector that is in two shards of a search counts in its first cluster's. Neighbours of what is within SLACK that
    are in no cluster that the search visits are ways on, for walk().
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for group in grouped(batches, 3):
            seeks = group.column("seeks").to_numpy(zero_copy_only=False)
            if seeks.all() or not seeks.any():
                continue
            raw, ids, times = group.column("vector").to_pylist(), group.column("node").to_numpy(), group.column("times").to_numpy()
            clusters, near = group.column("clusters").to_pylist(), group.column("near")
            cluster = group.column("cluster")[0].as_py()
            m, q = np.flatnonzero(~seeks), np.flatnonzero(seeks)
            x = np.frombuffer(b"".join(raw[i] for i in m), np.float64).reshape(len(m), -1)
            y = np.frombuffer(b"".join(raw[i] for i in q), np.float64).reshape(len(q), -1)
            # (place, neighbour) pairs, and the neighbour's place where it is in this shard
            near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
            listed = pc.list_flatten(near)
            beside = listed.field("node").to_numpy()
            own = np.searchsorted(m, pc.list_parent_indices(near).to_numpy())
            order = np.argsort(ids[m], kind="stable")
            at = order[np.minimum(np.searchsorted(ids[m], beside, sorter=order), len(m) - 1)]
            inside = ids[m][at] == beside
            # neighbours as rows of places, the own place where there are fewer
            degree = np.bincount(own[inside], minlength=len(m))
            adjacent = np.repeat(np.arange(len(m))[:, None], max(1, degree.max()), axis=1)
            adjacent[own[inside], np.arange(inside.sum()) - np.repeat(np.cumsum(degree) - degree, degree)] = at[inside]
            medoid = int((x @ x.sum(axis=0)).argmax())
            starts, nearest = [medoid], x @ x[medoid]
            for _ in range(min(7, len(m) - 1)):
                starts.append(int(nearest.argmin()))
                nearest = np.maximum(nearest, x @ x[starts[-1]])
            sims = np.full((len(q), len(m)), -2.0)
            sims[:, starts] = y @ x[starts].T
            done = np.zeros(sims.shape, bool)
            while True:
                beam = np.partition(sims, -min(BEAM, len(m)), axis=1)[:, -min(BEAM, len(m))]
                go = (sims > -2) & ~done & ((sims >= beam[:, None]) | (sims >= cosine - SLACK))
                if not go.any():
                    break
                done |= go
                r, c = np.nonzero(go)
                reach = np.zeros(sims.shape, bool)
                reach[r[:, None], adjacent[c]] = True
                r, c = np.nonzero(reach & (sims == -2))
                for k in range(0, len(r), PAIRS):
                    sims[r[k : k + PAIRS], c[k : k + PAIRS]] = np.einsum("ij,ij->i", y[r[k : k + PAIRS]], x[c[k : k + PAIRS]])
            hit = (sims >= cosine) & (ids[q][:, None] != ids[m][None])
            first = np.array([clusters[i][0] for i in m])
            # (search, vector) pairs that this cluster counts: the vector's first cluster, or one whose first is not visited
            visited = [set(clusters[i]) for i in q]
            count = np.zeros(len(q), np.int64)
            a, b = [], []
            label = {}

            def top(k, label=label):
                while label.get(k, k) != k:
                    label[k] = label.get(label[k], label[k])
                    k = label[k]
                return k

            for r in np.flatnonzero(hit.any(axis=1)):
                js = np.flatnonzero(hit[r])
                mine = [j for j in js if first[j] == cluster or first[j] not in visited[r]]
                count[r] = times[m[mine]].sum() if mine else 0
                for j in js:
                    s, t = top(int(ids[q[r]])), top(int(ids[m[j]]))
                    if s != t:
                        label[max(s, t)] = min(s, t)
                        a.append(int(ids[q[r]]))
                        b.append(int(ids[m[j]]))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([*ids[q[some]].tolist(), *a], pa.int64()), pa.array([None] * len(some) + b, pa.int64()), pa.array([*count[some].tolist(), *[None] * len(a)], pa.int64())], ["a", "b", "found"])
            # neighbours that are in other shards, and whether a search visits one of their clusters
            if inside.all():
                continue
            leaf, other = own[~inside], beside[~inside]
            of = listed.field("of").filter(pa.array(~inside)).to_pylist()
            ends = np.array([[c[0], c[-1]] for c in of])
            ways = []
            for r in np.flatnonzero((sims >= cosine - SLACK).any(axis=1)):
                been = np.zeros(CLUSTERS, bool)
                been[clusters[q[r]]] = True
                ways += [(int(ids[q[r]]), int(o)) for o in np.unique(other[(sims[r, leaf] >= cosine - SLACK) & ~been[ends].any(axis=1)])]
                if len(ways) > PAIRS:
                    yield onward(ways)
                    ways = []
            if ways:
                yield onward(ways)

    return run


def onward(ways: list) -> pa.RecordBatch:
    """(search, node) pairs as rows with found -1."""
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ways], pa.int64()), pa.array([b for _, b in ways], pa.int64()), pa.array([-1] * len(ways), pa.int64())], ["a", "b", "found"])


def walk(spark: SparkSession, found: DataFrame, placed: DataFrame, near: DataFrame, cosine: float) -> DataFrame:
    """Goes on in the united graph, across shards, from the ways on in found, round by round until no search reaches a new vector.

    A round joins the pairs reached with the vectors and adjacency lists of both ends; of what is within SLACK of the
    range, neighbours in clusters that the search has not visited are the next round's. Returns all rows but ways.
    """

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(batch.num_rows, -1) for c in ("vector", "other"))
            sims = np.einsum("ij,ij->i", x, y)
            a, b, times = (batch.column(c).to_numpy() for c in ("a", "b", "times"))
            hit = np.flatnonzero(sims >= cosine)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[hit], a[hit]])), pa.array([None] * len(hit) + b[hit].tolist(), pa.int64()), pa.array([*times[hit].tolist(), *[None] * len(hit)], pa.int64())], ["a", "b", "found"])
            next_to, visited = batch.column("near"), batch.column("visited")
            ways = set()
            for i in np.flatnonzero(sims >= cosine - SLACK):
                seen = set(visited[i].as_py())
                ways |= {(int(a[i]), o["node"]) for o in next_to[i].as_py() or () if o["node"] != a[i] and seen.isdisjoint(o["of"])}
            if ways:
                yield onward(sorted(ways))

    out, seen = found.where("found IS NULL OR found >= 0"), None
    fresh = written(found.where("found = -1").select("a", "b").distinct(), "ways")
    while not fresh.isEmpty():
        seen = fresh if seen is None else seen.unionByName(fresh)
        ends = fresh.join(placed.select(F.col("node").alias("b"), "vector", "times"), "b").join(near.withColumnRenamed("node", "b"), "b")
        both = ends.join(placed.select(F.col("node").alias("a"), F.col("vector").alias("other"), F.col("clusters").alias("visited")), "a")
        more = written(both.select("a", "b", "vector", "times", "near", "other", "visited").mapInArrow(step, "a long, b long, found long"), "walked")
        out = out.unionByName(more.where("found IS NULL OR found >= 0"))
        fresh = written(more.where("found = -1").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"), "ways")
    return out


def linked(found: DataFrame, n: int, dim: int, cosine: float, probes: int) -> DataFrame:
    """Distinct vectors of one dimension to rows (a, b null, found) with counts and (a, b, found null) with connecting links."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(centres(found, n, dim))  # CLUSTERS x dim numbers at most

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = shared.value
        k = min(max(OVERLAP, probes), len(c))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            sims = x @ c.T
            at = np.argsort(-sims, axis=1, kind="stable")[:, :k] if len(x) else np.zeros((0, k), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "clusters"])

    placed = written(found.where(F.col("dim") == dim).select("node", "vector", "times").mapInArrow(visit, "node long, vector binary, times long, clusters array<int>"), "placed")
    member = placed.select("node", "vector", "times", "clusters", F.explode(F.slice("clusters", 1, OVERLAP)).alias("cluster"))
    sizes = member.groupBy("cluster").agg(F.count("*").alias("n"))
    seekers = placed.select(F.explode("clusters").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("s"))
    dealt = written(sizes.join(seekers, "cluster").select("cluster", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("s") / SEARCHES).cast("int").alias("sets")), "shards")
    some = lambda by, n: F.pmod(F.xxhash64("node", F.lit(by)), F.col(n)).cast("int")
    member = member.join(F.broadcast(dealt), "cluster").withColumn("shard", some(1, "shards"))  # a row for each cluster
    near = member.select("cluster", "shard", "node", "vector").repartition(parts(spark), "cluster", "shard").sortWithinPartitions("cluster", "shard", "node").mapInArrow(build, "node long, near array<long>")
    # lists of a vector's shards united, OVERLAP of them at most; a neighbour's clusters tell whether a search visits it
    pairs = near.select("node", F.explode("near").alias("o")).distinct().join(placed.select(F.col("node").alias("o"), F.slice("clusters", 1, OVERLAP).alias("of")), "o")
    union = written(pairs.groupBy("node").agg(F.collect_list(F.struct(F.col("o").alias("node"), "of")).alias("near")), "adjacency")
    columns = ["cluster", "shard", "part", "seeks", "node", "vector", "times", "clusters", "near"]
    held = member.join(union, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).withColumn("seeks", F.lit(False)).select(columns)
    seek = placed.select("node", "vector", "times", "clusters", F.explode("clusters").alias("cluster")).join(F.broadcast(dealt), "cluster").withColumn("part", some(2, "sets"))
    seek = seek.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("seeks", F.lit(True)).withColumn("near", F.lit(None).cast(NEAR)).select(columns)
    both = held.unionByName(seek).repartition(parts(spark), "cluster", "shard", "part").sortWithinPartitions("cluster", "shard", "part")
    return walk(spark, written(both.mapInArrow(search(cosine), "a long, b long, found long"), "found"), placed, union, cosine)


def audit(found: DataFrame, counts: DataFrame, dim: int, cosine: float, most: int = AUDIT) -> float | None:
    """Recall of a bounded sample of searches, against brute force over all vectors in blocks; None if they have no link.

    The lesser of the share of links found and the mean share of a vector's, so that small groups count as much as large.
    """
    import numpy as np

    sample = found.where(F.col("dim") == dim).orderBy(F.xxhash64("node")).limit(most).join(counts, "node", "left").select("node", "vector", F.coalesce("found", F.lit(0)).alias("found")).collect()
    if not sample:
        return None
    shared = found.sparkSession.sparkContext.broadcast((np.array([np.frombuffer(r["vector"]) for r in sample]), np.array([r["node"] for r in sample])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, ids = shared.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
            hit = (y @ v.T >= cosine) & (ids[:, None] != batch.column(0).to_numpy()[None])
            n += (hit * batch.column(2).to_numpy()[None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["node", "n"])

    rows = found.where(F.col("dim") == dim).select("node", "vector", "times").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    true = {r["node"]: r["n"] for r in rows if r["n"]}
    got = {r["node"]: min(r["found"], true[r["node"]]) for r in sample if r["node"] in true}
    return min(sum(got.values()) / sum(true.values()), sum(got[k] / n for k, n in true.items()) / len(true)) if true else None


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per vector: id, n_links, component_id, kept, recall (the audited one, null where no audited vector has links).

    Copies of a vector are one node with a count. A null or zero vector, or one with a null, NaN or infinite component,
    or a null id, is linked with nothing; vectors of different dimensions are not compared. If the audited recall is
    under RECALL, searches visit twice as many clusters, until they visit all. Rows that share an id and a vector are copies; where rows
    share an id only, each gets the most links and least component of them. Extra columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = nodes(plain)
    copies = written(keyed.select("id", "key"), "vector-keys")
    which = copies.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("times"))

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [unit(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)], ["node", "dim", "vector", "times"])

    found = written(keyed.join(which.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("node"))).dropDuplicates(["node"]).select("node", "v", "times").mapInArrow(units, NODE), "vectors")
    recalls: list[float] = []
    all_links = spark.createDataFrame([], "a long, b long, found long")
    for row in found.groupBy("dim").agg(F.count("*").alias("n")).collect():
        probes = PROBES
        while True:
            links = linked(found, row["n"], row["dim"], cosine, probes)
            counts = links.where("found IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("found"))
            recall = audit(found, counts, row["dim"], cosine)
            if probes >= CLUSTERS or recall is None or recall >= RECALL:
                break
            probes *= 2
        recalls += [] if recall is None else [recall]
        all_links = all_links.unionByName(links)
    label = components(all_links.where("b IS NOT NULL").select("a", "b"), "vector-links")
    counts = all_links.where("found IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("found"))
    per_node = which.join(counts, "node", "left").join(label, "node", "left").select("key", F.coalesce("found", F.lit(0)).alias("found"), "times", F.coalesce("component", "node").alias("component_id"))
    good = copies.join(per_node, "key").select(F.col("id").alias("k"), (F.col("found") + F.col("times") - 1).alias("n_links"), F.col("component_id").alias("c")).groupBy("k").agg(F.max("n_links").alias("n_links"), F.min("c").alias("c"))
    return plain.select("id").join(good, F.col("id") == F.col("k"), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"), F.lit(min(recalls, default=None)).cast("double").alias("recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
