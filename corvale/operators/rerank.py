"""Reranking of candidates (query_id, query_text, chunk_id, content, combined_score, rank)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.text import coverage, quality, search_terms, split_words, with_keywords, with_tokens
from corvale.operators.bm25 import CONTENT_KEYWORDS, DECIMALS, QUERY_KEYWORDS, floored, idf, tokens_to_postings, weight
from corvale.operators.search import min_max


def candidate_bm25(candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25) over each query's own candidates as the corpus; all candidates appear.

    ``candidates`` has q_tokens and tokens. Candidates are a few for each query, so windows over a query are small.
    """
    own = Window.partitionBy("query_id")
    lengths = candidates.select("query_id", "chunk_id", F.size("tokens").alias("length"), F.count(F.lit(1)).over(own).alias("n"), F.avg(F.size("tokens")).over(own).alias("mean_length"))
    postings = tokens_to_postings(candidates, ["query_id", "chunk_id"]).where("term is not null").drop("length").join(lengths, ["query_id", "chunk_id"])
    per_term = Window.partitionBy("query_id", "term")
    postings = postings.withColumn("df", F.count(F.lit(1)).over(per_term)).withColumn("raw", idf(F.col("n"), F.col("df")))
    mean = postings.select("query_id", "term", "raw").distinct().groupBy("query_id").agg(F.avg("raw").alias("mean_idf"))
    asked = candidates.select("query_id", "q_tokens").dropDuplicates(["query_id"])
    asked = tokens_to_postings(asked.withColumnRenamed("q_tokens", "tokens"), ["query_id"]).select("query_id", "term", F.col("tf").alias("times"))
    part = weight(F.col("tf"), floored(F.col("raw"), F.col("mean_idf")), F.col("length"), F.col("mean_length")) * F.col("times")
    found = postings.join(mean, "query_id").join(asked, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), DECIMALS).alias("bm25"))
    return candidates.select("query_id", "chunk_id").join(found, ["query_id", "chunk_id"], "left").fillna(0.0, ["bm25"])


def blend(strategy: str, original: Column, bm25: Column, covered: Column, good: Column) -> Column:
    if strategy == "bm25":
        return bm25
    if strategy == "quality":
        return original * 0.4 + covered * 0.3 + good * 0.3
    return original * 0.4 + bm25 * 0.3 + covered * 0.2 + good * 0.1


def rerank(candidates: DataFrame, strategy: str = "hybrid", k: int = 10) -> DataFrame:
    """query_id, chunk_id, coverage, quality, bm25, final_score and new rank of the best ``k`` candidates; ties keep their order.

    ``hybrid`` is also what unknown names mean. A query of which no keyword is left asks for its words.
    """
    c = with_tokens(candidates, "query_text", "q_tokens", QUERY_KEYWORDS)
    c = with_tokens(c, "content", "tokens", CONTENT_KEYWORDS, corpus=True).persist(StorageLevel.MEMORY_AND_DISK)  # a few rows for each query, read several times below
    scored = c.select("query_id", "chunk_id", "combined_score", F.col("rank").alias("before"), coverage(F.col("q_tokens"), F.col("tokens")).alias("coverage"), quality(F.col("content")).alias("quality"))
    if strategy == "quality":
        scored = scored.withColumn("bm25", F.lit(0.5))
    else:
        own = Window.partitionBy("query_id")
        bm = candidate_bm25(c.select("query_id", "chunk_id", "q_tokens", "tokens")).withColumn("bm25", min_max(F.col("bm25"), own, F.lit(1.0)))
        scored = scored.join(bm, ["query_id", "chunk_id"])
    final = F.round(blend(strategy, F.col("combined_score"), F.col("bm25"), F.col("coverage"), F.col("quality")), DECIMALS)
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "before")
    ranked = scored.withColumn("final_score", final).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", F.round("coverage", DECIMALS).alias("coverage"), F.round("quality", DECIMALS).alias("quality"), F.round("bm25", DECIMALS).alias("bm25"), "final_score", "rank")


def expanded_queries(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, query_text): the query's terms and frequent longer words of its three best candidates, in alphabetical order.

    Words of more than 3 characters that a candidate has twice or more are
    added in order of candidate and first place while there are fewer than
    ``limit`` times the query's words (at least one is looked at in each candidate).
    """
    q = with_keywords(candidates.select("query_id", "query_text").dropDuplicates(["query_id"]), "query_text", "kw", 10)
    q = q.select("query_id", "query_text", search_terms(F.col("kw")).alias("terms"), (F.size(split_words(F.col("query_text"))) * limit).alias("most"))
    words = candidates.where("rank <= 3").select("query_id", "rank", F.posexplode(split_words(F.lower(F.col("content")))).alias("at", "w")).where(F.length("w") > 3)
    often = words.groupBy("query_id", "rank", "w").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n >= 2")
    lists = often.groupBy("query_id", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("ws"))
    by_query = lists.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ws"))), lambda x: x["ws"]).alias("ls"))
    met = q.join(by_query, "query_id", "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<array<string>>")))

    def one(acc: Column, w: Column) -> Column:
        grows = ~acc["full"] & ~F.array_contains(acc["t"], w)
        t = F.when(grows, F.concat(acc["t"], F.array(w))).otherwise(acc["t"])
        return F.struct(t.alias("t"), (acc["full"] | grows & (F.size(t) >= F.col("most"))).alias("full"))

    grown = F.aggregate("ls", F.col("terms"), lambda terms, ws: F.aggregate(ws, F.struct(terms.alias("t"), F.lit(False).alias("full")), one)["t"])
    return met.select("query_id", F.array_join(F.array_sort(grown), " ").alias("query_text"))


def rerank_expanded(candidates: DataFrame, k: int = 10) -> DataFrame:
    return rerank(candidates.drop("query_text").join(expanded_queries(candidates), "query_id"), "hybrid", k)
