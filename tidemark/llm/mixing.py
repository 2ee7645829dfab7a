"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source (source, source_size) with its target.

    All targets sum to share times all sizes, dealt by weight, none above most times its source's size.
    Sources are put in the order in which they reach that bound; the level at which the first one stays below it
    is the level of all that do. The table has one row per source, so the windows hold aggregates only.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rising = Window.orderBy("bound", "rank")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.col("total").cast("double") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(rest).cast("double")
    own = F.col("weight").cast("double")
    cap = most * F.col("source_size").cast("double")
    return (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", w)
        .withColumn("bound", cap / own)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", level)
        .withColumn("flat", F.max(F.when(F.col("level") * own <= cap, F.col("level"))).over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.coalesce("flat", F.lit(0.0)) * own, cap).alias("target"))
    )


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def rated(rows: DataFrame, sized: DataFrame, id_col: str, source_col: str, weights, share: float, most: float, seed: str) -> DataFrame:
    """rows with __size, __target (their source's) and __copies. sized: (source, size) of all documents."""
    # Written, the sources' table has a known size: Spark broadcasts it below its threshold and joins by key, splitting hot keys, above.
    aims = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    aims = aims.select(F.col("source").alias("__of"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col(f"`{id_col}`"), seed) < rate - F.floor(rate)).cast("long")
    return rows.join(aims, F.col(f"`{source_col}`").eqNullSafe(F.col("__of"))).withColumn("__copies", copies.cast("long")).drop("__of")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Per document: id, size, source_size, target, copies.

    A source's rate is its target over its size; a document is taken floor(rate) times, and once more where its own
    hashed draw lies below the fraction. A null text has size 0, a null source is a source of its own, a source
    without words has target 0, equal ids draw alike, and an empty table gives no rows.
    """
    sized = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size")), "sizes")
    return rated(sized, sized, "id", "source", weights, share, most, seed).select("id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The documents, each as often as plan() says; columns stay as they are.

    Copies are made of the row itself: rows that share an id, or have none, are taken each by itself.
    """
    sized = docs.select(F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size"))
    taken = rated(docs, sized, id_col, source_col, weights, share, most, seed).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, sum(source_size) OVER () AS total FROM sources),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
flat AS (SELECT *, max(CASE WHEN level * weight::DOUBLE <= 2.0::DOUBLE * source_size::DOUBLE THEN level END) OVER () AS flat FROM levels),
aims AS (SELECT source, source_size, least(coalesce(flat, 0) * weight::DOUBLE, 2.0::DOUBLE * source_size::DOUBLE) AS target FROM flat),
rates AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size::DOUBLE ELSE 0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""
