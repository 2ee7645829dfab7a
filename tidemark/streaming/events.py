"""Structured streams over the events table, run until all of it is read; results must equal those of a batch query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def source(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files. The reader needs a folder: the table's own, filtered by name.

    The setting tidemark.stream.filesPerBatch says how many files a batch has at most; without it a batch has all.
    """
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    files = spark.conf.get("tidemark.stream.filesPerBatch", None)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{d}/events.parquet*")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has written once everything there is has been read."""
    base = f"{shared_dir(stream.sparkSession)}/tidemark/stream-{uuid.uuid4().hex}"
    write = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        write.format("parquet").option("path", f"{base}/out").outputMode("append").start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out")

    write.outputMode("complete").foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def mapped(spark, d):
    return finished(source(spark, d).where("event_type = 'purchase'").select("event_id", "user_id"))


def counted(spark, d):
    return finished(source(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "complete")


def tumbling(spark, d):
    x = source(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    x = x.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    return finished(x, "complete")


def sliding(spark, d):
    x = source(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    x = x.groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "n")
    return finished(x, "complete")


def joined_static(spark, d):
    dim = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return finished(source(spark, d).where("event_type = 'error'").join(dim, "user_id").select("event_id", "first_event"))


def deduplicated(spark, d):
    return finished(source(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def keyed_state(spark, d):
    """Running totals kept by user: the state is (events, purchases), and each batch emits where users stand."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, bought = state.get if state.exists else (0, 0)
        for f in frames:
            n, bought = n + len(f), bought + int((f["event_type"] == "purchase").sum())
        state.update((n, bought))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "bought": [bought]})

    x = source(spark, d).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, bought long", "n long, bought long", "append", "NoTimeout")
    return finished(x).groupBy("user_id").agg(F.max("n").alias("n"), F.max("bought").alias("bought"))


def merged_state(spark, d, base: str | None = None):
    """The partial sums of an incremental query, merged batch by batch in foreachBatch.

    Each batch's state is kept under its number and made of the one before, so that a batch that is run again, or a
    stream that is started again on the same folder, gives the same sums.
    """
    base = base or f"{shared_dir(spark)}/tidemark/merge-{uuid.uuid4().hex}"

    def merge(rows: DataFrame, batch: int) -> None:
        new = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).cast("decimal(34,6)").alias("s"))
        if batch:
            new = new.unionByName(spark.read.parquet(f"{base}/state/{batch - 1}")).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(34,6)").alias("s"))
        new.write.mode("overwrite").parquet(f"{base}/state/{batch}")

    query = source(spark, d).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    while last and not spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state/{last}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state/{last}")):
        last -= 1  # a started stream without new files reports a batch that was not run
    return spark.read.parquet(f"{base}/state/{last}").select("event_type", "n", F.round(F.col("s").cast("double"), 4).alias("s"))


def united(spark, d):
    """Two streams as one."""
    x = source(spark, d)
    return finished(x.where("event_type = 'error'").select("event_id", "event_type").union(x.where("event_type = 'view'").select("event_id", "event_type")))


def flat_mapped(spark, d):
    """Several rows for each event."""
    return finished(source(spark, d).select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.pmod("event_id", F.lit(3)) + 1)).alias("i")))


def reduced_windows(spark, d):
    """The sum of values by type over sliding windows; Spark adds what enters a window's slides up, nothing is subtracted."""
    x = source(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    x = x.groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.sum(F.col("value").cast("decimal(24,6)")).alias("s"))
    return finished(x.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", F.round(F.col("s").cast("double"), 4).alias("s")), "complete")


def joined_streams(spark, d):
    """Two streams joined on the user and the hour after an error; watermarks bound what is kept of each."""
    x = source(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    errors = x.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("ts").alias("at")).withWatermark("at", "3650 days")
    bought = x.where("event_type = 'purchase'").select("event_id", "user_id", "ts").withWatermark("ts", "3650 days")
    return finished(errors.join(bought, F.expr("u = user_id AND ts >= at AND ts < at + INTERVAL 1 HOUR")).select("error_id", "event_id"))


FRAMES: dict[str, tuple[Callable, str]] = {
    "stream_filter_map": (mapped, "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'"),
    "stream_count_by_key": (counted, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_tumbling_window": (tumbling, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sliding_window": (sliding, "SELECT begin, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS begin FROM events UNION ALL SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY FROM events) x GROUP BY 1"),
    "stream_static_join": (joined_static, "SELECT event_id, first_event FROM events JOIN (SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1) x USING (user_id) WHERE event_type = 'error'"),
    "stream_deduplicate": (deduplicated, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_keyed_state": (keyed_state, "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY 1"),
    "stream_union": (united, "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view')"),
    "stream_flat_map": (flat_mapped, "SELECT event_id, unnest(range(1, event_id % 3 + 2)) AS i FROM events"),
    "stream_window_sum": (reduced_windows, "SELECT begin, event_type, round(sum(CAST(value AS DECIMAL(24,6)))::DOUBLE, 4) AS s FROM (SELECT event_type, value, date_trunc('day', ts)::TIMESTAMP AS begin FROM events UNION ALL SELECT event_type, value, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY FROM events) x GROUP BY 1, 2"),
    "stream_stream_join": (joined_streams, "SELECT a.event_id AS error_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase'"),
    "stream_merge_state": (merged_state, "SELECT event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(24,6)))::DOUBLE, 4) AS s FROM events GROUP BY 1"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: x for n, (_, x) in FRAMES.items()}
