"""Packing documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, slices, table, written

CAPACITY = 2048
END_ID = 1
SALTS = 256
PIECE = "id long, start long, length int, ids_crc32 long, doc_tokens long"


#: Letters as they are after lower-casing, in texts of no characters but these two blocks; normalising leaves those texts as they are.
LETTER = "a-zªµºß-öø-ſ"
OTHERS = re.compile("[^\x00-įı-ſ]")
#: What is looked up: runs of letters, and of what is neither a letter nor a space.
RUN = re.compile(f"[{LETTER}]+|[^{LETTER} ]+")
WORD = re.compile(f"[{LETTER}]+")
#: Characters of a text that are turned into ids at once.
BLOCK = 1 << 20


class Known(dict):
    """Ids of strings that came up, the new ones before the ones that were new earlier; long strings are not kept.

    When there are half as many as may be, they become the earlier ones, and those that were go.
    """

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 24):
        self.make, self.half, self.longest, self.earlier = make, most // 2, longest, {}

    def __missing__(self, x: str) -> bytes:
        found = self.earlier.get(x)
        if found is None:
            found = self.make(x)
        if len(x) <= self.longest:
            if len(self) >= self.half:
                self.earlier = dict(self)
                self.clear()
            self[x] = found
        return found


#: Writers of few ids, by their number.
FEW = [struct.Struct(f"<{n}I").pack for n in range(32)]


def bytes_of(ids: list[int]) -> bytes:
    return FEW[len(ids)](*ids) if len(ids) < len(FEW) else struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, from a vocabulary of lower-cased words whose tokens never span a space.

    What stands between spaces always has the same ids. So has a run of letters, and a run of other characters, unless
    an apostrophe comes between them. Each is given to the tokenizer once and then looked up.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the letters of LETTER, as the vocabulary writes their bytes
        letters = [c for c in map(chr, range(0x180)) if WORD.fullmatch(c)]
        self.written = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters if not c.isascii()})
        self.runs, self.chunks = Known(self.run, most), Known(self.whole, most // 4)

    def run(self, text: str) -> bytes:
        """Ids of a run of letters, past the steps that would find it to be one, or of other characters."""
        if not WORD.match(text):
            return self.whole(text)
        return bytes_of([x.id for x in self.model.tokenize(text if text.isascii() else text.translate(self.written))])

    def whole(self, text: str) -> bytes:
        """Ids of any text; without offsets, which nobody reads."""
        return bytes_of(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        # An added token's string is matched in the raw text, which splitting could hide.
        if "<|" in text:
            return self.whole(text)
        latin, out, start = "'" not in text and not OTHERS.search(text), [], 0
        while start < len(text):
            end = text.find(" ", start + BLOCK)
            end = len(text) if end < 0 else end
            part = text[start:end].replace("\n", " ")
            out.append(b"".join(map(self.runs.__getitem__, RUN.findall(part.lower())) if latin else map(self.chunks.__getitem__, part.split(" "))))
            start = end
        return b"".join(out)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def forget_words() -> None:
    """Gives the tables back, in a worker that goes on to another operator."""
    word_ids.cache_clear()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids and the end id, cut after each capacity ids: PIECE rows."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(words.of(text.as_py()) + end)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for column, x in zip(out, (key, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(cut), PIECE)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (times used, lengths), from how often each length occurs.

    Lengths are placed longest first. All packs with the same lengths are one pattern with a count; a length goes to
    the pattern with most room, and only as many of its packs as there are pieces of that length are changed.
    """
    room: dict[int, list[list]] = {capacity: []}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fits = sorted((r for r in room if r >= length and room[r]), reverse=True)
        while left and fits:
            r = fits[0]
            here, now = room[r].pop(), 0
            now = min(left, here[0])
            if here[0] > now:
                room[r].append([here[0] - now, here[1]])
            if not room[r]:
                fits.pop(0)
            room.setdefault(r - length, []).append([now, [*here[1], length]])
            left -= now
            if r - length >= length and r - length not in fits:
                fits = sorted((*fits, r - length), reverse=True)
        if left:
            # no open pack fits: new packs, each with as many of this length as it holds
            each = capacity // length
            full, last = divmod(left, each)
            for n, k in ((full, each), (1, last)):
                if n and k:
                    room.setdefault(capacity - k * length, []).append([n, [length] * k])
    return [(n, lengths) for r in sorted(room) for n, lengths in room[r]]


def slots(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): which ranks of a length go where."""
    out, used, sequence = [], {}, 0
    for n, lengths in found:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return out


def ranked(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows with each one's rank from 0 among those of its length; a frequent length is counted in many parts."""
    salt = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    rows = rows.withColumn("salt", salt)
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    here = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    return rows.withColumn("place", F.row_number().over(here) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place")).drop("salt", "base", "place")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. The driver holds the histogram only, at most capacity counts, and the
    patterns made of it. Repeated rows are packed each by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, id_col, text_col, path or tokenizer_path(), capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(patterns(counts, capacity))
    dealt = spark.createDataFrame(places or [], "length int, first long, n long, sequence long, offset long")
    if len(places) < 200_000:  # rows of 40 bytes; a histogram of capacity lengths gives a few thousand
        dealt = F.broadcast(dealt)
    return ranked(rows).join(dealt, "length").where("rank >= first AND rank < first + n").select("id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
