"""Training-order materialisation: a keyed permutation places every sequence; range partitions write it to shards at a fixed stride."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table
from .packing import END_ID, tokenizer_path, word_ids

#: Ids of a sequence, each two bytes, and the id that fills up a document's last one.
LENGTH = 512
PAD = 0xFFFF
#: What a record says of its sequence before the ids: document id, start, length, whether the id is null, checksum.
HEADER = ">qIHHI"
HEAD = 20
#: A record ends in one byte that is no part of the ids: the text sink's line end.
STRIDE = HEAD + 2 * LENGTH + 1
#: Bytes of text that a shard is made of, on average.
SHARD = 32 << 20
#: Shards beyond so many are written several to a task, in order.
TASKS = 100_000
ROUNDS = 6
RECORD = "shard int, place long, record binary"


def permute(index, n: int, key: int):
    """Places of indexes 0..n-1: a Feistel network over the least even number of bits that holds n, walked on until inside."""
    import numpy as np

    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}:{r}").bytes[:8], "big")) for r in range(ROUNDS)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Space:
    """The numbers that sequences have before they are permuted.

    A document has the numbers from ((id - low) * contents + its text's digest mod contents) * longest on. They depend on
    its id and text alone, so that neither splits nor tasks change the order, and nothing is counted before tokenising.
    """

    low: int
    span: int
    contents: int
    longest: int
    shards: int

    @property
    def size(self) -> int:
        return self.span * self.contents * self.longest


def space(own: DataFrame) -> Space:
    """From one pass over (id, text): the ids' range, the longest text, all texts' bytes."""
    size = F.octet_length("text")
    found = own.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(size).alias("longest"), F.sum(size).alias("bytes")).first()
    low = found["low"] or 0
    # a null id counts as one above all; ranges over 2 ** 40 ids are folded
    span = min((found["high"] or 0) - low + 2, 1 << 40)
    longest = (found["longest"] or 0) // LENGTH + 1
    contents = max(1, min(1 << 20, (1 << 62) // (span * longest)))
    return Space(low, span, contents, longest, max(1, -(-(found["bytes"] or 0) // SHARD)))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, key: int = 1) -> tuple[DataFrame, int]:
    """Every document's ids and the end id in sequences of LENGTH, the last filled up: RECORD rows, and the number of shards.

    A null text is the end id alone. Rows of the same id have sequences of their own. An empty table gives no rows. Ids
    that do not fit two bytes are an error.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found, path = space(own), path or tokenizer_path()
    width = -(-found.size // found.shards)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        import numpy as np

        words, end = word_ids(path), end_id.to_bytes(4, "little")

        def rows(index, out) -> pa.RecordBatch:
            place = permute(np.concatenate(index), found.size, key)
            return pa.RecordBatch.from_arrays([pa.array((place // width).astype(np.int32)), pa.array(place), pa.array(out, pa.binary())], ["shard", "place", "record"])

        for batch in batches:
            index, out = [], []
            ids = batch.column("id")
            offset = np.where(ids.is_null(), found.span - 1, (ids.fill_null(found.low).to_numpy() - found.low) % found.span).astype(np.uint64)
            digest = (batch.column("digest").to_numpy() % found.contents).astype(np.uint64)
            base = (offset * np.uint64(found.contents) + digest) * np.uint64(found.longest)
            for doc, first, text in zip(ids.to_pylist(), base, batch.column("text"), strict=True):
                wide = np.frombuffer(words.of(text.as_py()) + end, "<u4")
                if wide.max() >= PAD:
                    raise ValueError(f"token id {wide.max()} does not fit a record of two bytes an id")
                data = wide.astype("<u2").tobytes()
                for start in range(0, len(data), 2 * LENGTH):
                    part = data[start : start + 2 * LENGTH]
                    n = len(part) // 2
                    out.append(struct.pack(HEADER, doc or 0, start // 2, n, doc is None, zlib.crc32(part)) + part + PAD.to_bytes(2, "little") * (LENGTH - n))
                count = -(-len(wide) // LENGTH)
                index.append((first + np.arange(count, dtype=np.uint64)) % np.uint64(found.size))
                if len(out) > 8_000:
                    yield rows(index, out)
                    index, out = [], []
            if out:
                yield rows(index, out)

    return own.select("id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, RECORD), found.shards


def write_shards(rows: DataFrame, shards: int, path: str) -> None:
    """A folder shard=K for each range of places, with one file of records in order of place; the folders in order hold all slots."""
    tasks = min(shards, TASKS)
    dealt = rows.repartitionById(tasks, F.expr(f"cast(cast(shard as bigint) * {tasks} div {shards} as int)")).sortWithinPartitions("shard", "place", "record")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first, n): the first slot of each shard and its number of slots, from the files' sizes; a row for each file."""
    sizes = shard_files(spark, path).select("shard", F.expr(f"length div {STRIDE}").alias("n"))
    return sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"), "n")


def read_shards(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, id, start, length, ids_crc32, ids) in the shards, from a slot on: shards before it are not opened."""
    first = manifest(spark, path).where(F.col("first") + F.col("n") > slot).select(F.col("shard").alias("of"), "first")
    if first.count() < 1_000_000:  # rows of 16 bytes; else files meet their first slots by key
        first = F.broadcast(first)
    at = F.explode(F.sequence(F.lit(0), F.expr(f"cast(length div {STRIDE} as int)") - 1)).alias("i")
    # a file is a shard: its size is bounded, as places are spread evenly
    cut = shard_files(spark, path).join(first, F.col("shard") == F.col("of")).select("shard", "first", "content", at).select("shard", (F.col("first") + F.col("i")).alias("slot"), (F.col("i").cast("long") * STRIDE).alias("byte_offset"), F.substring("content", F.col("i") * STRIDE + 1, F.lit(STRIDE - 1)).alias("r"))

    def number(begin: int, size: int):
        return F.conv(F.hex(F.substring("r", begin + 1, size)), 16, -10).cast("long")

    length = number(12, 2)
    found = cut.select("slot", "shard", "byte_offset", F.when(number(14, 2) == 0, number(0, 8)).alias("id"), number(8, 4).alias("start"), length.alias("length"), number(16, 4).alias("ids_crc32"), F.substring("r", F.lit(HEAD + 1), (length * 2).cast("int")).alias("ids"))
    return found.where(F.col("slot") >= slot)


def materialise(docs: DataFrame, path: str | None = None, **kw) -> str:
    """Writes the shards of docs and returns their folder.

    Texts are turned into ids once, and ids are shuffled once, to the range of places that they belong to: no table is
    written in between, and no range is sampled, as the permutation spreads places evenly. A sequence's slot is its rank
    among all places: its shard's first slot and its place there. Equal places, which only rows with the same id and
    the same text's digest have, are in order of what the records hold. An empty table gives no shard.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/tidemark/shards-{uuid.uuid4().hex}"
    rows, shards = records(docs, **kw)
    write_shards(rows, shards, path)
    return path


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_shards(spark, materialise(table(spark, sf_dir, "documents")))
    return back.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "slot", "shard", "byte_offset", F.crc32("ids").alias("record_crc32"))
