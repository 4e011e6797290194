"""A training corpus from ``documents``: rules, exact and near duplicates, mixing and packing, each stage on what the one before kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, fertility, mixing, packing, simhash
from tidemark.session import materialise

#: Near duplicates and tokens have no plain SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


# Every stage takes the columns of ``documents`` and any others, under any names, and hands them on as they are (the last one has columns
# of its own). An empty table gives an empty table. Very long texts are single values: no stage cuts them before the last.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and very short texts go; null languages are judged by script; repeats are judged alike."""
    return fertility.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, null being smaller than any; of rows with the same id and text one.

    Null texts equal empty ones.
    """
    keyed, key = _keyed(docs)
    found = exact_dedup.exact_duplicates(keyed, carry=(key,)).where("kept").select("doc_id", key)
    return _keep(keyed, found, key).dropDuplicates(["doc_id", key]).drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id, null being larger than any; of ties the smallest text hash.

    Null, empty and wordless texts are near duplicates of each other. Rows with the same id and text stay or go together.
    """
    keyed, key = _keyed(docs)
    found = simhash.near_duplicates(keyed, carry=(key,))
    first = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", key)).alias("first")).select("first.doc_id", f"first.{key}")
    return _keep(keyed, first, key).drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the source schedule; a null source is one of its own, null and empty texts have one character."""
    return mixing.in_mixed_order(docs, mixing.TICKETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in the sequences; null texts are empty, repeated rows and null ids have pieces of their own.

    The sequences follow the order in which the documents are stored, which is the one that the stage before has given them.
    """
    return packing.pack(spark, docs, order=packing.stored_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mix sources", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again as the next stage's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the text, which with doc_id names a document even where ids are null or used twice, and its name, free in ``docs``."""
    key = "__text_hash"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, F.xxhash64("text")), key


def _keep(keyed: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    chosen = kept.select(F.col("doc_id").alias("__id"), F.col(key).alias("__hash"))
    return keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed[key] == chosen["__hash"]), "left_semi")
