"""Suffix-array deduplication of byte strings: suffixes that share a gram are sorted together, deep-shallow."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as win
from .common import parts, table

WINDOW = 100
GRAM = 32
#: Bytes that multikey quicksort looks at before blind tries take over; a multiple of 8.
SHALLOW = 24
#: Bytes of segments sorted at once.
BLOCK = 1 << 20
TEXT_ROW = "key long, doc long, row long, first long, n int, body binary"
OUT = "id long, n_bytes long, n_removed long, removed array<struct<first:long,last:long>>, kept binary"


def byte_units() -> Callable:
    import numpy as np

    values, _ = win.byte_values()
    return lambda text: values[np.frombuffer(text.encode(), np.uint8)]


class Trie:
    """A blind trie of strings of one length: inner nodes hold the place where their strings first differ.

    A string goes down by its bytes at those places alone, is compared once with what it arrives at, and branches off
    at the place where the two differ.
    """

    def __init__(self, first: bytes, item: int):
        self.root: list = [len(first), first, [item]]  # a leaf: length, string, items; inner: place, some string, children by byte

    def add(self, s: bytes, item: int) -> None:
        node = self.root
        while isinstance(node[2], dict):
            node = node[2].get(s[node[0]]) or [len(s), node[1], []]
        other = node[1]
        if other == s:
            node[2].append(item)
            return
        x = int.from_bytes(s) ^ int.from_bytes(other)
        place = len(s) - (x.bit_length() + 7) // 8
        node = self.root
        while isinstance(node[2], dict) and node[0] < place:
            node = node[2][s[node[0]]]
        if isinstance(node[2], dict) and node[0] == place:
            node[2][s[place]] = [len(s), s, [item]]
        else:
            node[:] = [place, node[1], {node[1][place]: node[:], s[place]: [len(s), s, [item]]}]

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[2], dict):
                stack += [node[2][b] for b in sorted(node[2], reverse=True)]
            else:
                yield node[2]


def sort_suffixes(data: bytes, starts, length: int) -> tuple:
    """Order of the length-byte strings of data at starts, and which of them equal the one before.

    Ties are in the order of starts' positions in the given array.
    """
    import numpy as np

    raw = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    shallow = min(SHALLOW, length - length % 8)
    order = np.arange(len(starts))
    # multikey quicksort of all groups at once: each parts three ways by a pivot's next 8 bytes, and the middle goes on
    # to the 8 bytes after; group: first place of each string's group, depth: bytes that its strings have in common
    group, depth = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts) if len(starts) > 1 and shallow else 0)
    while len(open_):
        word = np.ascontiguousarray(eight[starts[order[open_]] + depth[open_]]).view(">u8").ravel()
        new = np.concatenate([[True], group[open_][1:] != group[open_][:-1]])
        edge = np.flatnonzero(new)
        size = np.diff(np.concatenate([edge, [len(open_)]]))
        pivot = np.repeat(word[edge + size // 2], size)
        side = (word > pivot).astype(np.int8) - (word < pivot)
        by = np.lexsort((side, group[open_]))
        order[open_], side = order[open_][by], side[by]
        depth[open_] += 8 * (side == 0)
        new[1:] |= side[1:] != side[:-1]
        edge = np.flatnonzero(new)
        size = np.diff(np.concatenate([edge, [len(open_)]]))
        group[open_] = np.repeat(open_[edge], size)
        open_ = open_[(np.repeat(size, size) > 1) & (depth[open_] < shallow)]
    same = np.zeros(len(order), bool)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(order)]])
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if z - a < 2:
            continue
        deep = shallow
        trie = None
        for i in np.sort(order[a:z]).tolist():
            s = data[starts[i] + deep : starts[i] + length]
            if trie is None:
                trie = Trie(s, i)
            else:
                trie.add(s, i)
        at = a
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            same[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    return order, same


def segment_texts(window: int, gram: int) -> Callable:
    """For mapInArrow over (doc, row, text, ask): each segment's bytes, filed by its gram and the bytes beside it.

    Windows with more room before the gram than after it are filed with the bytes before, the others with those after.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        side = (window - gram) // 2
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, row, text, ask in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "ask")), strict=True):
                data = (text or "").encode()
                for x in ask:
                    first, n, q = x["first"], x["n"], x["first"] + x["lead"]
                    if first + n - 1 + window > len(data):
                        continue
                    cut = min(max(q - side - first + 1, 0), n)  # windows from first on that start at q - side or before
                    for a, k, beside in ((first, cut, data[q - side : q]), (first + cut, n - cut, data[q + gram : q + gram + side])):
                        if k:
                            for column, v in zip(out, (xxhash.xxh3_64_intdigest(beside, x["h1"] & (1 << 64) - 1) - (1 << 63), doc, row, a, k, data[a : a + k - 1 + window]), strict=True):
                                column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "doc", "row", "first", "n", "body"])

    return run


def earlier(window: int) -> Callable:
    """For mapInArrow over TEXT_ROW rows in order of (key, doc, row, first): intervals of windows that an earlier one equals.

    Sorts blocks of whole keys. Of a key with more than a block, the rows that brought a new window go on to the next.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def settle(rows: list[tuple]) -> tuple:
            data = b"".join(r[5] for r in rows)
            n = np.array([r[4] for r in rows], np.int64)
            size = np.array([len(r[5]) for r in rows], np.int64)
            at = np.repeat(np.arange(len(rows)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(np.cumsum(size) - size, n) + within
            doc, row = (np.array([r[c] for r in rows], np.int64)[at] for c in (1, 2))
            first = np.array([r[3] for r in rows], np.int64)[at] + within
            # in order of document and start, so that ties come out earliest first
            by = np.lexsort((first, row, doc))
            order, same = sort_suffixes(data, starts[by], window)
            order = by[order]
            # a place told twice is no later than itself
            gone = order[win.later(np.cumsum(~same), doc[order], row[order], first[order], True)]
            gone = gone[np.lexsort((first[gone], row[gone], doc[gone]))]
            new = np.ones(len(order), bool)
            new[gone] = False
            return win.joined(doc[gone], row[gone], first[gone], first[gone] + window), np.unique(at[new])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and (r[0] != held[-1][0] or size > 4 * BLOCK):
                    found, new = settle(held)
                    yield win.table_of(win.INTERVAL, *found)
                    held = [held[i] for i in new if held[i][0] == r[0]]
                    size = sum(len(x[5]) for x in held) if len(held) < 3 else BLOCK // 2
                held.append(r)
                size += len(r[5])
        if held:
            yield win.table_of(win.INTERVAL, *settle(held)[0])

    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc, row, text) to intervals (win.INTERVAL) of bytes that go."""
    rows = win.settled(docs, byte_units, window, gram, True, "byte-windows")
    texts = win.asked(docs, rows).mapInArrow(segment_texts(window, gram), TEXT_ROW)
    texts = texts.repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "doc", "row", "first")
    more = texts.mapInArrow(earlier(window), win.INTERVAL)
    return rows.where("last >= 0").select("doc", "row", "first", "last").unionByName(more)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, removed byte intervals and the kept bytes.

    A byte goes if a window that covers it also starts earlier: in a document with a smaller id, or before it in the
    same one; judged on the input. A null text is empty; a null id counts as smaller than all; rows that share an id
    are documents that leave each other alone, but for those with the same text, which are one. carry: the row comes
    along, its text and the other columns as a struct.
    """
    docs = win.plain(docs, id_col, text_col, carry)
    return win.cut(docs, repeated(docs, window, gram), str.encode, b"".join, OUT)


def kept_sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
