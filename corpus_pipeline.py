"""From raw documents to packed training sequences, in five stages over the operators of loam.llm.

Each stage works on all that the one before it kept and is written to the
cluster's shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from loam.llm.common import materialize
from loam.llm.queries import tokenizer_path


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars, where there is one, that of the text as it is now."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select([F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null text has no words and is rejected."""
    flagged = quality_rules.assess(docs.select("text", F.struct("*").alias("__row")))
    return flagged.where("kept").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    index = line_dedup.LineIndex(spark, threshold=10).insert(docs)
    return _counted(index.strip(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, and of its ids' repeats the first by content.

    Documents are told apart by id and content, so those without an id, or with
    one that others have, are chosen and kept like all; ids come before none.
    """
    content = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    prints = simhash.fingerprints(docs.select(key.alias("id"), "text"), drop=("text",))
    chosen = simhash.classes(materialize(prints)).select(F.col("component_id").alias("__key")).distinct()
    # Rows that repeat each other are cut to one before they are dealt out, once, by the key of the join behind.
    # That is an inner one, of distinct keys: a semi-join would be moved before the window and deal the texts out again, as
    # would a key that is not of the very type of theirs.
    first = F.row_number().over(Window.partitionBy("__key").orderBy("__key.a"))
    single = docs.select("*", key.cast(chosen.schema["__key"].dataType).alias("__key")).withColumn("__n", first).where("__n = 1")
    return single.join(chosen.hint("merge"), "__key").select([F.col(f"`{c}`") for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", sequences),
]

#: SQL can say neither the fingerprints nor the tokens; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
