"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, dedup_blocks, jaccard, langid, mixing, packing, pii, sharding, token_files, url_templates
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_blocks.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its path ends with."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), labels)


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op7_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan,
        op2_rank_order_langid,
        op3_pareto_mix,
        op4_block_naming,
        op5_url_templates,
        op6_kd_shards,
        op7_spf_packing,
        op8_size_aware_jaccard,
        op9_crf_pii,
        op10_token_files,
        pipeline,
    )
}
ORACLES = {"op3_pareto_mix": mixing.ORACLE, "op4_block_naming": dedup_blocks.ORACLE}
