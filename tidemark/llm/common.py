"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, for every operator that counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one will do on one machine only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy", tidy: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends there, and losing an executor loses nothing.

    tidy: the shuffle files of the writing go when it is done, not when the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    if tidy:
        conf.set(TIDY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None:
            conf.set(TIDY, before)
        elif tidy:
            conf.unset(TIDY)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def beside(df: DataFrame, text_col: str):
    """All columns of df but the text as one struct, to take a row through an operator next to its text."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("carried")


def carrying(out: str, rows: DataFrame) -> StructType:
    """The columns of out and, where rows have them, those that make up the row: its text and the struct of beside()."""
    schema = StructType.fromDDL(out)
    return schema.add("text", "string").add("carried", rows.schema["carried"].dataType) if "carried" in rows.columns else schema


def restored(df: DataFrame, columns: list[str], text_col: str = "text", **changed) -> DataFrame:
    """The rows that an operator took along, with their columns as they were, or as changed says."""
    own = {text_col: F.col("text")} | changed
    return df.select(*[own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in columns])


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that what is made of a batch's texts at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with what earlier work left in a reused Python worker given back to the system before and after."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
