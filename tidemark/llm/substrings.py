"""Substring deduplication: windows of words that a document with a smaller id has as well go."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as win
from .common import lean, table

WINDOW = 13
GRAM = 5
OUT = "id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


def word_units() -> Callable:
    """A function from text to the 64-bit hashes of its words."""
    return lambda text: win.word_hashes(text.encode())


def window_rows(window: int) -> Callable:
    """For mapInArrow over (doc, row, text, ask): the Rabin-Karp hash of every window in the segments asked for, as SEGMENT rows of one window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        units_from = word_units()
        for batch in batches:
            docs, ids = (batch.column(c).to_numpy() for c in ("doc", "row"))
            text, ask, rows, held = batch.column("text"), batch.column("ask"), [], 0
            for k in np.lexsort((ids, docs)).tolist():
                units, some = units_from(text[k].as_py() or ""), ask[k].as_py()
                first = np.array([x["first"] for x in some], np.int64)
                n = np.array([x["n"] for x in some], np.int64)
                each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                each = np.unique(each[each + window <= len(units)])
                for start in range(0, len(units), win.STRETCH):
                    here = each[(each >= start) & (each < start + win.STRETCH)] - start
                    if len(here):
                        total = win.sums(units[start : start + win.STRETCH + window])
                        same, zero = np.ones(len(here), np.int64), np.zeros(len(here), np.int64)
                        rows.append((win.hashes(total, here, here + window), zero.astype(np.uint64), same * docs[k], same * ids[k], here + start, same, zero))
                        held += len(here)
                if held > win.STRETCH // 2:
                    yield from win.dealt(rows, window, False)
                    rows, held = [], 0
            if rows:
                yield from win.dealt(rows, window, False)

    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc, row, text) to intervals (win.INTERVAL) of words that go."""
    rows = win.settled(docs, word_units, window, gram, False, "word-windows")
    each = win.asked(docs, rows).mapInArrow(lean(window_rows(window)), win.SEGMENT)
    more = win.in_order(each).mapInArrow(lean(win.settle(window, False)), win.SETTLED)
    return rows.unionByName(more).where("last >= 0").select("doc", "row", "first", "last")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """Per document: id, n_words, n_removed, removed word intervals, and the kept words joined by one space.

    A word goes if a window that covers it is also in a document with a smaller id, judged on the input. A null text
    has no words; a null id counts as smaller than all; rows that share an id are documents that leave each other
    alone; a text with fewer words than a window stays as it is. carry: the row comes along, its text and the other columns as a struct.
    """
    docs = win.plain(docs, id_col, text_col, carry)
    return win.cut(docs, repeated(docs, window, gram), lambda text: text.encode().split(), lambda kept: b" ".join([w for part in kept for w in part]).decode(), OUT)


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
