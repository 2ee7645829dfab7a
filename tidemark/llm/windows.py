"""Repeated windows of a fixed number of units (words or bytes) across all documents.

Every window is filed under one of its grams, the one with the least Rabin-Karp hash: equal windows have the same
gram at the same place. Neighbouring windows with the same gram form a segment, so that a table of segments, several
times smaller than that of windows, is what gets shuffled. Segments with equal contents settle each other; windows of
segments that share a gram but differ somewhere are compared one by one in a second step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, carrying, lean, parts, slices, written

#: Units hashed at once; a longer document is taken in overlapping stretches.
STRETCH = 1 << 19
PLACE = (1 << 20) - 1
NO_ID = -(1 << 63)
#: row tells documents apart that share an id; such documents are neither earlier nor later than each other.
SEGMENT = "h1 long, h2 long, doc long, row long, at long"
#: last >= 0: units [first, last) of doc go. Otherwise a segment to be looked into, with its gram.
SETTLED = "h1 long, doc long, row long, first long, last long, lead int, n int"
INTERVAL = "doc long, row long, first long, last long"


@cache
def powers() -> tuple:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    import numpy as np

    base = 0x9E3779B97F4A7C15 | 1
    n = 2 * STRETCH + 1024
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return tuple(out)


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sums(units):
    import numpy as np

    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers()[0][: len(units)], out=out[1:])
    return out


def hashes(total, first, last):
    """Rabin-Karp hashes of the units first..last-1, from sums()."""
    return mixed((total[last] - total[first]) * powers()[1][first])


@cache
def byte_values() -> tuple:
    """A number for each byte, and which bytes are white space."""
    import numpy as np

    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64, endpoint=False), space


def word_hashes(data: bytes):
    """64-bit hashes of the words of UTF-8 text, what the six ASCII white spaces part: each the Rabin-Karp hash of its bytes.

    A long text is taken in parts between words. Words of more than 64 KiB are hashed one by one.
    """
    import numpy as np
    import xxhash

    values, space = byte_values()
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = len(data) if len(data) - at <= STRETCH else data.rfind(b" ", at, at + STRETCH) + 1
        if end <= at:
            end = data.find(b" ", at + STRETCH) + 1 or len(data)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(space[raw], prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        long = np.flatnonzero(last - first > 1 << 16)
        if len(raw) <= STRETCH:
            found = hashes(sums(values[raw]), first, last)
        else:  # hardly any space: word by word
            found = np.zeros(len(first), np.uint64)
            for i in np.flatnonzero(last - first <= 1 << 16):
                found[i] = hashes(sums(values[raw[first[i] : last[i]]]), np.zeros(1, np.int64), last[i : i + 1] - first[i])[0]
        for i in long:
            found[i] = xxhash.xxh3_64_intdigest(data[at + first[i] : at + last[i]])
        out.append(found)
        at = end
    return np.concatenate(out)


def segments(units, owner, window: int, gram: int) -> tuple:
    """(h1, h2, first window, number of windows, place of the gram in the first) of each segment; owner: each unit's document."""
    import numpy as np

    n = len(units)
    if n < window:
        return (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)
    total = sums(units)
    g = mixed((total[gram:] - total[:-gram]) * powers()[1][: n - gram + 1])
    least, size, wide = (g & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64), 1, window - gram + 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(at):
        return segments(units[:0], owner[:0], window, gram)
    q = (least[at] & np.uint64(PLACE)).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(q) != 0)])
    first = at[new]
    last = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
    q = q[new]
    count, lead = last - first + 1, q - first
    h2 = mixed(hashes(total, first, last + window) + (lead * 128 + count).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return g[q], h2, first, count, lead


def stretches(documents: Iterable[tuple[int, object]], window: int) -> Iterator[tuple]:
    """(units, owner, ids, starts): documents put together, long ones in stretches that overlap by window - 1 units."""
    import numpy as np

    units, ids, starts, held = [], [], [], 0

    def full():
        return np.concatenate(units), np.repeat(np.arange(len(units)), [len(x) for x in units]), np.array(ids, np.int64), np.array(starts, np.int64)

    for key, x in documents:
        for start in range(0, max(1, len(x) - window + 1), STRETCH):
            part = x[start : start + STRETCH + window - 1]
            if units and held + len(part) > STRETCH:
                yield full()
                units, ids, starts, held = [], [], [], 0
            units.append(part)
            ids.append(key)
            starts.append(start)
            held += len(part)
    if units:
        yield full()


def joined(doc, row, first, last) -> tuple:
    """Overlapping or touching intervals of the same document made one; given in order of document and start."""
    import numpy as np

    if not len(doc):
        return doc, row, first, last
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(row) != 0) | (first[1:] > last[:-1])])
    return doc[new], row[new], first[new], last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])]


def table_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x.view("int64") if x.dtype == "uint64" else x.astype(kinds[t].to_pandas_dtype()), kinds[t]) for x, t in zip(columns, types, strict=True)], names)


def later(kind, doc, row, start, within: bool):
    """Which of rows in order of (kind, doc, row, start) go: an equal kind is in a document with a smaller id or, within, starts earlier in the same one."""
    import numpy as np

    if not len(kind):
        return np.zeros(0, bool)
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    gone = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if within:
        new = new | np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(row) != 0)])
        gone |= start > start[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return gone


def dealt(rows: list[tuple], window: int, within: bool) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, row, start, windows, place of the gram) in order of (doc, row, start) to SEGMENT rows. at holds the last three.

    What repeats among them is settled here: such rows hold an interval, -1 - start in at and its length in h2, so that
    a segment with many copies crosses the shuffle about once for each Arrow batch.
    """
    import numpy as np

    h1, h2, doc, row, start, count, lead = (np.concatenate(x) for x in zip(*rows, strict=True))
    both = h1 * np.uint64(3) + h2
    order = np.argsort(both, kind="stable")
    gone = np.zeros(len(h1), bool)
    gone[order] = later(both[order], doc[order], row[order], start[order], within)
    d, r, a, z = joined(doc[gone], row[gone], start[gone], (start + count - 1 + window)[gone])
    keep = ~gone
    yield table_of(SEGMENT, h1[keep], h2[keep], doc[keep], row[keep], (start << 14 | lead << 7 | count)[keep])
    yield table_of(SEGMENT, mixed((d + a).astype(np.uint64)), z - a, d, r, -1 - a)


def segment_rows(units_of: Callable, window: int, gram: int, within: bool) -> Callable:
    """For mapInArrow over (doc, row, text): SEGMENT rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        units_from = units_of()
        for batch in batches:
            docs, ids = (batch.column(c).to_numpy() for c in ("doc", "row"))
            order, text, rows, held = np.lexsort((ids, docs)), batch.column("text"), [], 0
            for units, owner, own, starts in stretches(((k, units_from(text[k].as_py() or "")) for k in order.tolist()), window):
                h1, h2, first, count, lead = segments(units, owner, window, gram)
                at = owner[first] if len(first) else first
                rows.append((h1, h2, docs[own[at]], ids[own[at]], first - np.searchsorted(owner, at) + starts[at], count, lead))
                held += len(h1)
                if held > STRETCH // 2:
                    yield from dealt(rows, window, within)
                    rows, held = [], 0
            if rows:
                yield from dealt(rows, window, within)

    return run


def settle(window: int, within: bool) -> Callable:
    """For mapInArrow over SEGMENT rows in order of (h1, h2, doc, row, at): SETTLED rows. Holds one Arrow batch and the open gram's first rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        none = [np.zeros(0, np.int64)] * 5
        held, classes = none, 0  # rows of the open gram that wait for a second kind of segment; kinds so far
        ahead = none  # the open kind's first row, and the first one of the document that it is at
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            easy = columns[4] < 0
            if easy.any():
                h1, length, doc, row, a = (x[easy] for x in columns)
                a = -1 - a
                yield table_of(SETTLED, h1, doc, row, a, a + length, a * 0, a * 0)
                columns = [x[~easy] for x in columns]
            if not len(columns[0]):
                continue
            known = len(ahead[0])
            h1, h2, doc, row, at = columns = [np.concatenate(x) for x in zip(ahead, columns, strict=True)]
            fresh = np.arange(len(h1)) >= known
            new_gram = np.concatenate([[True], np.diff(h1) != 0])
            new_kind = new_gram | np.concatenate([[True], np.diff(h2) != 0])
            gone = later(np.cumsum(new_kind), doc, row, at >> 14, within) & fresh
            group = np.cumsum(new_gram) - 1
            kinds = np.bincount(group, new_kind).astype(int)
            if known:
                kinds[0] += classes - 1
            a = at[gone] >> 14
            yield table_of(SETTLED, h1[gone], doc[gone], row[gone], a, a + (at[gone] & 127) - 1 + window, a * 0, a * 0)
            left = ~gone & fresh
            ask = left & (kinds[group] > 1)
            asked = [x[ask] for x in (h1, doc, row, at)]
            if known and kinds[0] > 1 and len(held[0]):
                asked = [np.concatenate([x, held[c]]) for x, c in zip(asked, (0, 2, 3, 4), strict=True)]
                held = none
            elif known and group[-1] > 0:
                held = none
            if len(asked[0]):
                yield table_of(SETTLED, *asked[:3], asked[3] >> 14, np.full(len(asked[0]), -1), asked[3] >> 7 & 127, asked[3] & 127)
            wait = left & (group == group[-1]) & (kinds[group] == 1)
            held = [np.concatenate([x, y[wait]]) for x, y in zip(held, columns, strict=True)]
            classes = kinds[-1]
            first = np.flatnonzero(new_kind)[-1]
            here = np.flatnonzero(new_kind | np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(row) != 0)]))[-1]
            ahead = [x[[first, here]] for x in columns]

    return run


def in_order(rows: DataFrame) -> DataFrame:
    """SEGMENT rows as settle() takes them."""
    return rows.repartition(parts(rows.sparkSession), "h1").sortWithinPartitions("h1", "h2", "doc", "row", "at")


def settled(docs: DataFrame, units_of: Callable, window: int, gram: int, within: bool, name: str) -> DataFrame:
    """docs (doc, row, text) to SETTLED rows, written. within: an earlier start in the same document counts as well.

    The shuffle of segments is larger than the texts and goes before the texts are shuffled.
    """
    rows = docs.select("doc", "row", "text").mapInArrow(lean(segment_rows(units_of, window, gram, within)), SEGMENT)
    return written(in_order(rows).mapInArrow(lean(settle(window, within)), SETTLED), name, tidy=True)


def asked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with the segments of theirs that are to be looked into: the columns of docs, ask.

    No column is left out, so that the shuffle of docs is the one of removals() too and texts are stored once.
    """
    ask = rows.where("last < 0").groupBy("doc", "row").agg(F.collect_list(F.struct("h1", "first", "lead", "n")).alias("ask"))
    return docs.join(ask.hint("shuffle_hash"), ["doc", "row"])


def removals(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with their intervals (INTERVAL rows) as an array, null where there are none."""
    each = rows.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    return docs.join(each.hint("shuffle_hash"), ["doc", "row"], "left")


def runs(gone: list | None, n: int) -> list[tuple[int, int]]:
    """Intervals as maximal runs inside 0..n."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((x["first"], min(n, x["last"])) for x in gone or ()):
        if a >= z:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def plain(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc, row, text) with a least id for null; with carry, also the other columns as a struct.

    row is 0 where ids are unique, as they should be. Where any id repeats, it is the text's digest, so that rows that
    share an id are documents of their own, but for equal ones, which share their result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), *([beside(docs, text_col)] if carry else []))
    unique = own.groupBy("doc").count().where("count > 1").isEmpty()
    return own.withColumn("row", F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit(""))))


def own_id(doc) -> int | None:
    return None if doc == NO_ID else doc


def cut(docs: DataFrame, intervals: DataFrame, split: Callable, join: Callable, out: str) -> DataFrame:
    """plain() rows to (id, units, removed units, removed intervals, kept text), named and typed by out, and the row if it was carried."""
    found = removals(docs, intervals)
    carry = ["carried"] if "carried" in docs.columns else []
    schema = carrying(out, docs)
    kept_kind = pa.binary() if out.endswith("binary") else pa.string()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), kept_kind)
        for batch in slices(batches):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                units = split(text.as_py() or "")
                taken = runs(gone, len(units))
                kept, at = [], 0
                for a, z in taken:
                    kept.append(units[at:a])
                    at = z
                kept.append(units[at:])
                n = sum(z - a for a, z in taken)
                for column, x in zip(columns, (own_id(doc), len(units), n, [{"first": a, "last": z} for a, z in taken], join(kept)), strict=True):
                    column.append(x)
            row = [batch.column(1), batch.column(3)] if carry else []
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), *row], schema.names)

    return found.select("doc", "text", "gone", *carry).mapInArrow(lean(run), schema)
