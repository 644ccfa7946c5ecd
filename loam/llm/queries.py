"""The registered queries of this package, and their SQL where SQL can say the same."""

# ruff: noqa: F401

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, packing, quality_rules, secrets, simhash, substring_dedup, token_files, toxicity
from .common import new_folder
from .oracles import oracle_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _crc(divisor: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex(spark, threshold=10).insert(docs)
    return index.strip(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scorer = language_id.train(docs.where(F.coalesce(_crc(3) != 1, F.lit(False))))
    out = language_id.identify(docs.select("doc_id", "text"), scorer, drop=("text",))
    return out.select("doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read(spark, path, with_ids=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Limits of ``decontaminated_texts``: words of a span that may stay, and share of a document's words that may be hit.
MAX_SPAN, MAX_COVERAGE = 12, 0.5


def decontaminated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within the coverage limit, without the hit spans that exceed the length limit."""
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), max_span=MAX_SPAN, max_coverage=MAX_COVERAGE)
    return out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.cluster(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    learned = labels.where(_crc(4) != 2).select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled(docs, learned))
    out = model.score(docs, drop=("text",))
    return out.select("doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_best_fit_packing, op2_line_dedup, op3_language_id, op4_token_files, op5_substring_dedup, op6_decontamination, decontaminated_texts, op7_secret_scan, op8_quality_rules, op9_simhash, op10_toxicity, pipeline]
    return {f.__name__: f for f in made}
