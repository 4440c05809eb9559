"""Keyword search: Okapi BM25 over postings of search tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvale.functions.text import with_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_KEYWORDS, CONTENT_KEYWORDS = 15, 50
#: Scores are ranked and compared with this many decimals, so that the order of summation doesn't show.
DECIMALS = 6


def weight(tf: Column, idf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def idf(n: Column, df: Column) -> Column:
    """May be negative for terms of more than half of the texts; see ``floored``."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def floored(raw: Column, mean: Column) -> Column:
    """A negative value becomes a share of the mean over all terms."""
    return F.when(raw < 0, EPSILON * mean).otherwise(raw)


@dataclass
class Index:
    """Postings (id, term, tf, length), terms (term, idf) and one row of statistics."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def unpersist(self) -> None:
        self.postings.unpersist()

    def save(self, path: str, buckets: int = 64) -> Index:
        """Write the index under ``path``, postings in a folder for each bucket of terms, and give it as read from there."""
        files = self.postings.where("term is not null").withColumn("bucket", _bucket(F.col("term"), buckets))
        files.repartition("bucket", _bucket(F.col("term"), 1 << 20) % 8).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.terms.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/terms")
        self.stats.write.parquet(f"{path}/stats")
        return load(self.postings.sparkSession, path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str) -> Index:
    """An index that ``save`` wrote."""
    postings, terms, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))
    return Index(postings, terms, stats)


def tokens_to_postings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, length) of rows with ``tokens``; a token's frequency is counted in its row, without a shuffle."""
    sized = rows.select(*keys, "tokens", F.array_distinct("tokens").alias("own"), F.size("tokens").alias("length"))
    counts = F.when(F.size("own") == F.col("length"), F.transform("own", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf")))).otherwise(
        F.transform("own", lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).alias("tf")))
    )
    return sized.select(*keys, "length", counts.alias("c")).select(*keys, "length", F.explode_outer("c").alias("c")).select(*keys, "length", "c.term", "c.tf")


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "content", extra: list[str] | None = None) -> Index:
    """Index all ``chunks``; postings are kept (they are used for statistics, frequencies and scores)."""
    keys = [key, *(extra or [])]
    postings = tokens_to_postings(with_tokens(chunks.select(*keys, text), text, "tokens", CONTENT_KEYWORDS, corpus=True), keys).persist(StorageLevel.MEMORY_AND_DISK)
    stats = postings.select(key, "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    raw = postings.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", floored(F.col("raw"), F.col("mean_idf")).alias("idf"))
    return Index(postings, terms, stats.crossJoin(mean))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """(key, term, times): a repeated token counts each time."""
    tokens = with_tokens(queries.select(key, text), text, "tokens", QUERY_KEYWORDS)
    return tokens_to_postings(tokens, [key]).where("term is not null").select(key, "term", F.col("tf").alias("times"))


def scores(index: Index, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, keyword_score) of positive scores, rounded."""
    asked = query_terms(queries)
    postings = index.postings
    if "bucket" in postings.columns:  # a stored index: only the folders of the terms asked for are read
        asked = asked.join(index.terms.select("term", "idf", "buckets"), "term").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")).drop("buckets")
        met = postings.join(asked, ["bucket", "term"]).drop("bucket")
    else:
        met = postings.join(asked.join(index.terms.select("term", "idf"), "term"), "term")
    met = met.crossJoin(F.broadcast(index.stats.select("mean_length")))
    part = weight(F.col("tf"), F.col("idf"), F.col("length"), F.col("mean_length")) * F.col("times")
    return met.groupBy("query_id", key).agg(F.round(F.sum(part), DECIMALS).alias("keyword_score")).where("keyword_score > 0")


def top(rows: DataFrame, score: str, k: int, key: str, by: str = "query_id") -> DataFrame:
    """The ``k`` rows of highest score for each ``by``, ties by key; adds ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_search(index: Index, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    return top(scores(index, queries, key), "keyword_score", k, key)
