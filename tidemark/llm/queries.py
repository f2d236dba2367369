"""The ten operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, media, minhash, mixing, quality, sharding, style_tree, token_counts, warc
from .common import scratch, table, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), mixing.SHARES)
    return out.select("doc_id", "source", F.col("__block").alias("block"), F.col("__row").alias("row_in_block"), F.col("__slot").alias("slot"), F.col("__release").alias("release"), F.col("__deadline").alias("deadline"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "doc_id",
        sharding.byte_size().alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.catalog_of(warc.read_archives(spark, path))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encoded(table(spark, sf_dir, "documents")), "media")
    return media.digest(media.decoded(stored))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_key")


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer file: spark.tidemark.tokenizer, or the installed public one."""
    import public_tokenizers

    return spark.conf.get("spark.tidemark.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_sharding, op3_warc, op4_licenses, op5_media, op6_decontamination, op7_quality, op8_minhash, op9_style_tree, op10_tokens)}


def oracle_sql() -> dict[str, str]:
    return {}
