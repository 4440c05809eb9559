"""The queries that apply the operators of this subpackage to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvale.llm import audio, contain, langid, lattice, near, packing, sharding, store, suffixes, wrapper

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"), length=50)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), window=2048, end_id=1)


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, num=4, den=5)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40, row_bytes=16)


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary file on offer has ranks and no probabilities, so the unigram scores of its pieces are counted in the training documents."""
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), folds=7, fold=2)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_round_trip(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1)


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op9_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.describe(audio.store(table(spark, sf_dir, "documents")), coded=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_benchmark_containment, op4_minhash_near_dedup, op5_sharding, op6_lattice_likelihood, op7_token_store, op8_wrapper_extraction, op9_audio_columns, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_containment": contain.containment_sql(width=5, num=4, den=5)}
