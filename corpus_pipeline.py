"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns that ``documents`` has. A stage's result is written
before the next one reads it (by ``run`` as by any other caller), and each
stage works on all rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvale.llm import contain, langid, near, packing, suffixes
from corvale.llm.common import clean_up, materialize, written_paths
from corvale.llm.registry import tokenizer_file

#: No SQL can train a recurrent network; tests compare the stages with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told apart; the others (no letters, too little to tell) go.

    With no label to learn from, all that have a letter stay.
    """
    return langid.keep_identified(docs, least=0.4)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return near.keep_one(docs, width=5, num=80, den=100)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take from each document the 50-byte strings that a document with a smaller id has; documents left empty by it go."""
    return suffixes.deduplicated(docs, length=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return contain.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, num=4, den=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_file(), window=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself is deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(written_paths(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clean_up(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
