"""N-gram Jaccard join: shingle sets as count vectors, an R-tree over them bounds overlaps, survivors are verified."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, parts, table, written
from .components import components
from .packing import forget_words

WORDS = 4
PERCENT = 85
#: Groups of the smallest sets; larger sets have more, so that a group holds DENSE tokens at most on average.
GROUPS = 64
DENSE = 12
#: A count that is larger is kept as this and bounds nothing.
MANY = 255
LEAF = 32
#: Children of an inner node of the tree.
FAN = 8
#: Tokens of more sets than this come last in the order that prefixes are taken in, the MOST most frequent ones at most.
FREQUENT, MOST = 1024, 1 << 20
#: Tokens that are counted at once.
RUN = 1 << 20
#: Members of a block that are compared in one task; of a larger block each split is compared with itself and PIVOTS.
SPLIT = 96
PIVOTS = 32
#: Bytes of count vectors that a cell may hold; a larger one is dealt into splits, which meet pair by pair.
CELL = 1 << 19
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
SET = "doc long, row long, n int, same long, counts binary, prefix array<long>"
LINK = "a long, b long"


def shingle_sets(k: int) -> Callable:
    """A function from text to the sorted distinct hashes of its k-word shingles; A-Z are lower-cased."""
    import numpy as np

    from .windows import STRETCH, hashes, mixed, sums, word_hashes

    lower = bytes.maketrans(UPPER, LOWER)

    def of(text: str):
        units = word_hashes(text.encode().translate(lower))
        if not len(units):
            return units
        # mixed, as the hash of a shingle is a sum over its words
        units, size = mixed(units), min(k, len(units))
        found = []
        for at in range(0, len(units) - size + 1, STRETCH):
            total = sums(units[at : at + STRETCH + size - 1])
            first = np.arange(len(total) - size)
            found.append(hashes(total, first, first + size))
        h = np.sort(np.concatenate(found) + np.uint64(size))
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    return of


def counts_of(tokens):
    """How many tokens fall in each group: the point that stands for a set. The groups use other bits than the order does."""
    import numpy as np

    n = max(GROUPS, 1 << max(0, (len(tokens) - 1) // DENSE).bit_length())
    return np.minimum(np.bincount((tokens & np.uint64(n - 1)).astype(np.int64), minlength=n), MANY).astype(np.uint8)


def points_of(counts: list[bytes]):
    """Counts as written, as rows of numbers. Points with more groups than the fewest have them folded together."""
    import numpy as np

    length = np.array([len(x) for x in counts])
    least = length.min()
    out = np.empty((len(counts), least), np.int32)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        points = np.frombuffer(b"".join(counts[i] for i in at), np.uint8).reshape(len(at), n // least, least)
        out[at] = np.where(points == MANY, 1 << 20, points).sum(axis=1)
    return out


class CountTree:
    """An R-tree of count vectors: leaves of LEAF points in order of set size, inner nodes of FAN nodes, up to one root.

    Each node holds the largest count per group and the least size below it. Sum over groups of the smaller count
    bounds an overlap from above; with boxes, of the smaller of the largest counts.
    """

    def __init__(self, points, sizes):
        import numpy as np

        heavy = points.argmax(axis=1) if len(points) else sizes
        self.order = np.lexsort((heavy, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order].astype(np.int64)
        self.begin = np.arange(0, len(self.order), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, self.begin, axis=0), self.sizes[self.begin])]
        while len(self.levels[-1][1]) > 1:
            top, low = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), low[at]))

    def reach(self, leaf: int, percent: int):
        """Leaves from this one on that may hold a set similar to one of its own, found from the root down."""
        import numpy as np

        box, least = self.levels[0][0][leaf], self.levels[0][1][leaf]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            bound = np.minimum(box, top[nodes]).sum(axis=1, dtype=np.int64)
            nodes = nodes[((100 + percent) * bound >= percent * (least + low[nodes])) & ((nodes + 1) * FAN**depth > leaf)]
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return nodes

    def join(self, linked: Callable, percent: int, labels) -> None:
        """Calls linked(i, js) for every point i and the points js after it that may be similar enough and have another label."""
        import numpy as np

        order, n = self.order, len(self.order)
        for leaf, a in enumerate(self.begin):
            z = min(a + LEAF, n)
            open_ = self.reach(leaf, percent)
            step = max(1, 4096 // self.points.shape[1])
            for some in range(0, len(open_), step):
                js = np.concatenate([np.arange(self.begin[x], min(self.begin[x] + LEAF, n)) for x in open_[some : some + step]])
                own = labels[order[a:z]]
                if (labels[order[js]] == own[0]).all() and (own == own[0]).all():
                    continue
                over = np.minimum(self.points[a:z, None], self.points[None, js]).sum(axis=2, dtype=np.int64)
                may = ((100 + percent) * over >= percent * (self.sizes[a:z, None] + self.sizes[None, js])) & (js[None] > np.arange(a, z)[:, None])
                for row in np.flatnonzero(may.any(axis=1)):
                    i = order[a + row]
                    found = order[js[may[row]]]
                    found = found[labels[found] != labels[i]]
                    if len(found):
                        linked(i, found)


def forest(points, sizes, percent: int, verify: Callable | None = None) -> list[tuple[int, int]]:
    """Links that connect what the tree (and verify, where given) finds similar: no link inside a component so far."""
    import numpy as np

    labels, out = np.arange(len(sizes)), []

    def linked(i, js):
        for j in js:
            if labels[j] != labels[i] and (verify is None or verify(i, j)):
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]

    CountTree(points, sizes).join(linked, percent, labels)
    return out


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key, columns) of each run of equal first keys columns, of rows in that order. Holds one run and one batch."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        if held:
            new[0] = any(held[-1].column(c)[0].as_py() != k[0] for c, k in enumerate(key))
        edges = [0, *np.flatnonzero(new[1:]) + 1, batch.num_rows]
        if held and new[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, z - a))
            if z < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def frequent(docs: DataFrame, k: int):
    """Sorted tokens that more than FREQUENT sets have, the MOST most frequent ones at most.

    Counted over all texts: those that come up in three sets of a run of texts, which a token of that many sets does
    where it matters, are added up over all runs. Results do not depend on it: any order of tokens finds all links.
    """
    import numpy as np

    def counted(tokens: list) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_counts=True)
        token, n = token[n > 2], n[n > 2]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingle_sets(k)
        for batch in batches:
            seen, held, size = set(), [], 0
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                mark = (len(tokens), int(tokens.sum())) if len(tokens) else None
                if mark in seen or mark is None:
                    continue
                seen.add(mark)
                held.append(tokens)
                size += len(tokens)
                if size > RUN:
                    yield counted(held)
                    held, size = [], 0
            yield counted(held)

    counts = written(docs.select("text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT), "frequent")
    least, held = FREQUENT, 0
    for row in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.col("power").desc()).collect():
        held += row["count"]
        if held > MOST:
            least = 2 ** (row["power"] + 1)
            break
    return np.sort(counts.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, row, text) to SET rows. Of equal sets in an Arrow batch only the first has its counts and prefix.

    A prefix is the first tokens in order of hash, frequent ones last.
    """
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))  # MOST numbers at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        forget_words()
        shingles, late = shingle_sets(k), last.value
        for batch in batches:
            seen, out = set(), ([], [], [], [])
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                n = len(tokens)
                same = xxhash.xxh3_64_intdigest(tokens.tobytes(), n & 0xFFFF) - (1 << 63)
                fresh = n > 0 and same not in seen
                seen.add(same)
                # below 7 in the union, two different sets cannot reach 85 %, nor does any size with prefix 1 need more
                prefix = None
                if fresh:
                    size = n - -(-percent * n // 100) + 1
                    if len(late):
                        common = late[np.minimum(np.searchsorted(late, tokens), len(late) - 1)] == tokens
                        prefix = np.concatenate([tokens[~common][:size], tokens[common][: max(0, size - n + int(common.sum()))]]).view(np.int64)
                    else:
                        prefix = tokens[:size].view(np.int64)
                for column, x in zip(out, (n, same, counts_of(tokens).tobytes() if fresh else None, prefix), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True))], ["doc", "row", "n", "same", "counts", "prefix"])

    return docs.mapInArrow(lean(run), SET)


def candidates(percent: int) -> Callable:
    """For mapInArrow over (token, band, pair, same, n, home, counts) in order of the first three: links that connect each cell's survivors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tested: set[tuple[int, int]] = set()

        def cells(batch: pa.RecordBatch, edges) -> pa.RecordBatch:
            same, n, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("same", "n", "home"))
            counts, out = batch.column("counts"), []
            for a, z in edges:
                if z - a == 2:
                    x, y = int(same[a]), int(same[a + 1])
                    if x == y or not (home[a] or home[a + 1]) or 100 * min(n[a], n[a + 1]) < percent * max(n[a], n[a + 1]) or (x, y) in tested:
                        continue
                    if len(tested) > 50_000:
                        tested.clear()
                    tested.update(((x, y), (y, x)))
                    points = points_of([counts[a].as_py(), counts[a + 1].as_py()])
                    if (100 + percent) * int(points.min(axis=0).sum()) >= percent * int(n[a] + n[a + 1]):
                        out.append((x, y))
                elif z - a > 2:
                    own, at = np.unique(same[a:z], return_index=True)
                    if len(own) > 1 and home[a:z].any():
                        at += a
                        out += [(int(own[i]), int(own[j])) for i, j in forest(points_of([counts[i].as_py() for i in at]), n[at], percent)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.concat_batches([held, batch]) if held is not None else batch
            token, band, pair = (batch.column(c).to_numpy() for c in ("token", "band", "pair"))
            edge = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(band) != 0) | (np.diff(pair) != 0)) + 1])
            if len(edge) > 1:
                yield cells(batch, zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            held = batch.slice(edge[-1])  # the last cell may go on
        if held is not None:
            yield cells(held, [(0, held.num_rows)])

    return run


def links_in(percent: int, every: bool) -> Callable:
    """For mapInArrow over (block, split, part, node, ask, tokens) in order of the first three: verified links.

    every: all pairs of a group. Otherwise pairs of an asking node with any.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in grouped(batches, 3):
            node, at = np.unique(group.column("node").to_numpy(zero_copy_only=False), return_index=True)
            if len(node) < 2:
                continue
            raw = group.column("tokens").to_pylist()
            tokens = [np.frombuffer(raw[i], np.uint64) for i in at]
            sizes = np.array([len(x) for x in tokens])
            ask = group.column("ask").to_numpy(zero_copy_only=False)
            asking = set(node[[*{int(np.searchsorted(node, x)) for x in group.column("node").to_numpy()[ask]}]].tolist()) if not every else ()

            def verify(i, j, node=node, tokens=tokens, asking=asking):
                if not every and node[i] not in asking and node[j] not in asking:
                    return False
                a, b = (tokens[i], tokens[j]) if len(tokens[i]) <= len(tokens[j]) else (tokens[j], tokens[i])
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                return (100 + percent) * int((b[place] == a).sum()) >= percent * (len(a) + len(b))

            if links := forest(points_of([counts_of(x).tobytes() for x in tokens]), sizes, percent, verify):
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def compared(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    rows = rows.select("block", "split", "part", "node", "ask", "tokens").repartition(parts(rows.sparkSession), "block", "split", "part").sortWithinPartitions("block", "split", "part")
    return rows.mapInArrow(lean(links_in(percent, every)), LINK)


def in_cells(found: DataFrame, percent: int) -> DataFrame:
    """SET rows to (token, band, pair, same, n, home, counts): any two sets of a token and band are together in a pair.

    pair is 0, but where a cell's count vectors are larger than CELL: there each set goes to one of as many splits as
    are needed, and each two splits are a pair, as is each by itself. Such a cell has each set once.
    """
    full = found.where("prefix IS NOT NULL AND n > 0")
    each = full.select("same", "n", F.explode("prefix").alias("token"))
    # at most the bytes of its counts
    size = F.greatest(F.lit(GROUPS), F.ceil(2 * F.col("n") / DENSE))
    # tokens of two different sets at least; of just two rows, the sizes must be near as well
    shared = each.groupBy("token").agg(F.min("same").alias("x"), F.max("same").alias("y"), F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum(size).alias("bytes"))
    shared = shared.where((F.col("x") != F.col("y")) & ((F.col("c") > 2) | (100 * F.col("low") >= percent * F.col("high")))).select("token", (F.col("bytes") > CELL).alias("large"))
    shared = written(shared, "shared-tokens")
    # sizes in bands that grow by 1 / 0.85: similar sets are in the same band or the next
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    bands = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("p")
    counts = full.groupBy("same").agg(F.first("counts").alias("counts"))
    usual = each.join(shared.where("NOT large").select("token"), "token").join(counts, "same").select("token", bands, "same", "n", "counts").select("token", "p.band", F.lit(0).cast("long").alias("pair"), "same", "n", "p.home", "counts")
    # a large token has thousands of rows, so that such tokens are few
    tokens = shared.where("large").select("token")
    if tokens.isEmpty():
        return usual
    large = written(each.join(tokens, "token").select("token", "same", "n").distinct(), "large-cells")
    large = large.select("token", bands, "same", "n").select("token", "p.band", "same", "n", "p.home")
    splits = large.groupBy("token", "band").agg(F.ceil(F.sum(size) / CELL).cast("long").alias("splits"))
    own, other = F.pmod(F.xxhash64("same"), F.col("splits")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("other")
    large = large.join(splits, ["token", "band"]).select("*", own.alias("own"), other).withColumn("pair", F.least("own", "other") * F.col("splits") + F.greatest("own", "other"))
    return usual.unionByName(large.join(counts, "same").select(usual.columns))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n_shingles, component_id, the least id that links lead to; row, the text's digest, and class, the component's own number.

    Equal sets are one node. Sets that can be similar share a token among the first of theirs (prefix filter, tokens
    that many sets have coming last); sets that share one and whose sizes are near meet in a cell, where the tree drops
    pairs whose counts cannot give the overlap. What is connected by the rest is a block, whose members' whole sets are
    compared. A block of more than SPLIT members is dealt into splits, each compared with itself and some pivots; what
    is then outside its largest component is compared with all of it. Pairs that are connected already are not compared.

    A null or blank text has an empty set and is linked with nothing; a null id is not linked and stays null; both have
    no class. Rows that share an id and differ are documents of their own, in classes of their own unless linked.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = written(sets(plain, k, percent), "sets")
    linkable = found.where("n > 0 AND doc IS NOT NULL")
    cells = in_cells(linkable, percent)
    cells = cells.repartition(parts(spark), "token", "band", "pair").sortWithinPartitions("token", "band", "pair")
    blocks = components(cells.mapInArrow(lean(candidates(percent)), LINK), "candidates")
    # a set's node is its digest; the least document that has it lends its text
    nodes = linkable.groupBy("same").agg(F.min(F.struct("doc", "row")).alias("first"))
    in_block = blocks.select(F.col("node").alias("same"), F.col("component").alias("block"))
    sized = in_block.groupBy("block").agg(F.count("*").alias("size"))
    members = nodes.join(in_block, "same").join(sized, "block").select("first.doc", "first.row", "block", "size", F.col("same").alias("node"))
    ask = plain.join(members.hint("shuffle_hash"), ["doc", "row"])
    whole = written(with_tokens(ask, k), "members")
    splits = F.ceil(F.col("size") / SPLIT).cast("int")
    chance = F.pmod(F.xxhash64("node"), F.col("size"))
    split = F.when(F.col("size") <= SPLIT + PIVOTS, F.array(F.lit(0))).when(chance < PIVOTS, F.sequence(F.lit(0), splits - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), splits).cast("int")))
    first = written(compared(whole.select("block", F.explode(split).alias("split"), F.lit(0).alias("part"), "node", F.lit(True).alias("ask"), "tokens"), percent, True), "near")
    large = whole.where(F.col("size") > SPLIT + PIVOTS)
    if not large.isEmpty():
        so_far = components(first, "near-so-far")
        of = large.select("block", "size", "node").join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
        most = of.groupBy("block", "component").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
        of = written(of.join(most, "block").withColumn("out", F.col("component") != F.col("largest")).select("node", "out").distinct(), "outside")
        rest = large.join(of, "node")
        chunks = rest.where("out").groupBy("block").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("chunks"))
        rest = rest.join(chunks, "block")
        sides = F.array(F.struct(F.array(F.pmod(F.xxhash64("node", F.lit(1)), splits).cast("int")).alias("s"), F.sequence(F.lit(0), F.col("chunks") - 1).alias("p"), F.lit(False).alias("ask")))
        asks = F.array(F.struct(F.sequence(F.lit(0), splits - 1).alias("s"), F.array(F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")).alias("p"), F.lit(True).alias("ask")))
        rest = rest.select("block", "node", "tokens", F.explode(F.when(F.col("out"), F.concat(sides, asks)).otherwise(sides)).alias("x"))
        rest = rest.select("block", "node", "tokens", F.explode("x.s").alias("split"), "x.p", "x.ask").select("block", "split", F.explode("p").alias("part"), "node", "ask", "tokens")
        first = first.unionByName(compared(rest, percent, False))
    linked = components(first, "near")
    label = nodes.join(linked, nodes["same"] == linked["node"], "left").select("same", "first.doc", F.coalesce("component", "same").alias("class"))
    least = label.groupBy("class").agg(F.min("doc").alias("component_id"))
    label = label.select("same", "class").join(least, "class")
    some = linkable.join(label, "same").select(F.col("doc").alias("id"), F.col("n").cast("long").alias("n_shingles"), "component_id", "row", "class")
    rest = found.where("n = 0 OR doc IS NULL").select(F.col("doc").alias("id"), F.col("n").cast("long").alias("n_shingles"), F.col("doc").alias("component_id"), "row", F.lit(None).cast("long").alias("class"))
    return some.unionByName(rest)


def with_tokens(rows: DataFrame, k: int) -> DataFrame:
    """(text, block, size, node) to (block, size, node, tokens)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingle_sets(k)
        for batch in batches:
            tokens = pa.array([shingles(x.as_py()).tobytes() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("size"), batch.column("node"), tokens], ["block", "size", "node", "tokens"])

    return rows.select("text", "block", "size", "node").mapInArrow(lean(run), "block long, size long, node long, tokens binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
