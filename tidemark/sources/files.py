"""Sources and sinks: each query writes rows in a format, reads them back and returns them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, tables

PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "part")["part"].select("p_partkey", "p_name", "p_size", "p_retailprice")


def round_trip(kind: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, path = _part(spark, d), place(spark, kind)
        rows.write.options(**options).format(kind).save(path)
        return spark.read.schema(rows.schema).options(**options).format(kind).load(path)

    return run


def delimited(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-delimited text, as the order tables are often delivered, with a seed column in front."""
    path = place(spark, "tbl")
    rows = _part(spark, d).select(F.crc32(F.col("p_partkey").cast("string").cast("binary")).alias("__seed__"), "*")
    rows.write.option("sep", "|").csv(path)
    return spark.read.schema(rows.schema).option("sep", "|").csv(path).drop("__seed__")


def json_inferred(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "json")
    _part(spark, d).write.json(path)
    return spark.read.json(path).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


def json_corrupt(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no JSON come up in a column of their own."""
    path = place(spark, "text")
    tables(spark, d, "nation")["nation"].select(F.when(F.col("n_nationkey") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("n_nationkey"))).alias("value")).write.text(path)
    rows = spark.read.schema("n_nationkey INT, bad STRING").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.select("n_nationkey", "bad")


def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """key=value folders: the filter on the key prunes folders, the type is found from their names."""
    path = place(spark, "partitioned")
    tables(spark, d, "orders")["orders"].withColumn("y", F.year("o_orderdate")).select("o_orderkey", "o_totalprice", "y").write.partitionBy("y").parquet(path)
    return spark.read.parquet(path).where("y = 1997 AND o_totalprice > 300000").select("o_orderkey", F.col("y").cast("long").alias("y"))


def dynamic_overwrite(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "dynamic")
    rows = tables(spark, d, "nation")["nation"].select("n_nationkey", "n_regionkey")
    rows.write.partitionBy("n_regionkey").parquet(path)
    rows.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).select("n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def merged_schema(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "merged")
    n = tables(spark, d, "nation")["nation"]
    n.where("n_nationkey < 10").select("n_nationkey").write.parquet(f"{path}/a")
    n.where("n_nationkey >= 10").select("n_nationkey", "n_name").write.parquet(f"{path}/b")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/a", f"{path}/b").select("n_nationkey", "n_name")


def binary_files(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "bin")
    tables(spark, d, "region")["region"].select("r_name").coalesce(1).write.text(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).agg(F.sum("length").cast("long").alias("n_bytes"))


def saved_table(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS and INSERT INTO, in the session's catalog."""
    name = f"t_{uuid.uuid4().hex}"
    n = tables(spark, d, "nation")["nation"].select("n_nationkey", "n_name")
    n.where("n_nationkey < 10").write.saveAsTable(name)
    n.where("n_nationkey >= 20").write.insertInto(name)
    return spark.table(name)


def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables in the same buckets are joined without a shuffle."""
    x = tables(spark, d, "orders", "customer")
    a, b = f"o_{uuid.uuid4().hex}", f"c_{uuid.uuid4().hex}"
    x["orders"].select("o_custkey", "o_orderkey").write.bucketBy(8, "o_custkey").sortBy("o_custkey").saveAsTable(a)
    x["customer"].select("c_custkey", "c_name").write.bucketBy(8, "c_custkey").sortBy("c_custkey").saveAsTable(b)
    return spark.table(a).join(spark.table(b).hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


FRAMES: dict[str, tuple[Callable, str]] = {
    "source_parquet": (round_trip("parquet"), PART),
    "source_orc": (round_trip("orc"), PART),
    "source_json": (round_trip("json"), PART),
    "source_csv": (round_trip("csv", header="true"), PART),
    "source_delimited": (delimited, PART),
    "source_json_inferred": (json_inferred, PART),
    "source_json_corrupt": (json_corrupt, "SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '{broken' END AS bad FROM nation"),
    "source_partitioned": (partitioned, "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 300000"),
    "sink_dynamic_overwrite": (dynamic_overwrite, "SELECT CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, n_regionkey FROM nation"),
    "source_merged_schema": (merged_schema, "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS n_name FROM nation"),
    "source_binary_files": (binary_files, "SELECT sum(strlen(r_name) + 1)::BIGINT AS n_bytes FROM region"),
    "sink_table": (saved_table, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 OR n_nationkey >= 20"),
    "join_bucketed": (bucketed_join, "SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: x for n, (_, x) in FRAMES.items()}
