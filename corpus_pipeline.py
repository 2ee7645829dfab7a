"""A corpus from raw documents: language, near duplicates, repeated passages, source mix, packed sequences.

Counts as part of the subpackage for training data and goes with it. Every stage takes rows as they are: null and empty
texts, rows that share an id, rows without one, and columns of any name. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, language, mixing, packing, substrings

#: A document's language must be predicted with this score at least. Text in one language scores close to 1.
LEAST_SCORE = 0.5
#: Near duplicates: documents whose sets of shingles of so many words have at least this percentage in common.
SHINGLE = 5
ALIKE = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those whose language is unclear. Nothing else is held against a document."""
    said = language.predict(docs, language.fit(docs), carry=True)
    return common.restored(said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least id stays; of rows with the least id and different texts, the one with the least digest.

    Equal rows are one document. Documents without an id or without words are linked with nothing and stay.
    """
    found = common.written(jaccard.join(docs, k=SHINGLE, percent=ALIKE), "near-classes")
    kept = found.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "row")).alias("x")).select(F.col("x.id").alias("__id"), F.col("x.row").alias("__of"))
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    alone = F.col("doc_id").isNull() | (mixing.words_in(F.col("text")) == 0)
    stay = keyed.where(~alone).join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__of")), "left_semi")
    if not found.where("class IS NOT NULL").groupBy("id", "row").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "__row"])
    return stay.unionByName(keyed.where(alone)).drop("__row")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of texts; a text that none is taken from stays as it is, one with nothing left goes."""
    cut = substrings.dedup(docs, carry=True).where("n_removed = 0 OR kept <> ''")
    less = F.col("n_removed") > 0
    changed = {"text": F.when(less, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(less, F.length("kept")).otherwise(F.col("carried.n_chars")).cast(docs.schema["n_chars"].dataType)
    return common.restored(cut, docs.columns, **changed)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of tokens; a document's copies are packed each by itself."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", by_language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("source mix", source_mix), ("packing", packed)]

#: The stages learn, compare and tokenise in ways that SQL has no words for; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
