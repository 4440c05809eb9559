"""Vector search and the fusion of vector and keyword results.

Many queries run in one plan: queries are rows (query_id, query_vec). Vectors
are scanned exactly; the side of the queries is broadcast if it is counted to
be small, else the scan is a nested loop over both sides' partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions import vector
from corvale.operators.bm25 import DECIMALS, top

#: Queries of so many values in all may be broadcast.
QUERY_VALUES = 4_000_000


def _pairs(vectors: DataFrame, queries: DataFrame, dimension: int = 2048) -> DataFrame:
    small = queries.limit(QUERY_VALUES // dimension + 1).count() <= QUERY_VALUES // dimension
    return vectors.crossJoin(F.broadcast(queries) if small else queries)


def similarities(vectors: DataFrame, queries: DataFrame, metric: str = "ip", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, key, other columns, similarity): cosine for ``ip``, squared distance for ``l2``; zero vectors have none.

    Vectors are normalised once per row and query, not once per pair.
    """
    if metric == "ip":
        v = vectors.select("*", vector.unit(F.col(embedding)).alias("__v")).where("__v is not null").drop(embedding)
        q = queries.select("query_id", vector.unit(F.col("query_vec")).alias("__q")).where("__q is not null")
        return _pairs(v, q).withColumn("similarity", F.round(vector.dot(F.col("__v"), F.col("__q")), DECIMALS)).drop("__v", "__q")
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    v = vectors.withColumnRenamed(embedding, "__v")
    return _pairs(v, queries.select("query_id", F.col("query_vec").alias("__q"))).withColumn("similarity", F.round(vector.squared_distance(F.col("__v"), F.col("__q")), DECIMALS)).drop("__v", "__q")


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", threshold: float | None = None, overfetch: int = 1, allowed: DataFrame | None = None, index_name: str | None = None, key: str = "chunk_id"
) -> DataFrame:
    """The ``k`` best of the live vectors for each query.

    ``overfetch`` times ``k`` are taken before the ``threshold`` is applied.
    ``allowed`` (key) and ``index_name`` restrict the vectors before the choice.
    """
    if "deleted" in vectors.columns:
        vectors = vectors.where(~F.col("deleted"))
    if index_name is not None:
        vectors = vectors.where(F.col("index_name") == index_name)
    if allowed is not None:
        vectors = vectors.join(allowed.select(key).distinct(), key, "left_semi")
    met = similarities(vectors, queries, metric, key)
    sign = F.col("similarity") if metric == "ip" else -F.col("similarity")
    best = top(met.withColumn("__s", sign), "__s", k * overfetch, key)
    if threshold is not None:
        best = best.where(F.col("similarity") >= threshold if metric == "ip" else F.col("similarity") <= threshold)
    return best.where(F.col("rank") <= k).drop("__s") if overfetch == 1 else top(best.drop("rank"), "__s", k, key).drop("__s")


def search_all_indexes(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Twice ``k`` of each index, put together, and the best ``k`` of those."""
    met = similarities(vectors.where(~F.col("deleted")) if "deleted" in vectors.columns else vectors, queries, "ip", key)
    order = Window.partitionBy("query_id", "index_name").orderBy(F.desc("similarity"), key)
    each = met.withColumn("index_rank", F.row_number().over(order)).where(F.col("index_rank") <= 2 * k)
    return top(each, "similarity", k, key)


def similarity_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, similarity) of all pairs of two sets (id, embedding); ``a`` is broadcast if it is counted to be small."""
    x = a.select(F.col("id").alias("a_id"), vector.unit(F.col("embedding")).alias("x"))
    y = b.select(F.col("id").alias("b_id"), vector.unit(F.col("embedding")).alias("y"))
    return _pairs(y, x).select("a_id", "b_id", F.round(vector.dot(F.col("x"), F.col("y")), DECIMALS).alias("similarity"))


def min_max(score: Column, over: Window, constant: Column) -> Column:
    """Score as a share of its range over the window; ``constant`` where the range is empty."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high > low, (score - low) / (high - low)).otherwise(constant)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float = 0.7, keyword_weight: float = 0.3, key: str = "chunk_id") -> DataFrame:
    """Full outer merge of both lists by min-max normalised scores: combined_score, ranked.

    Ties keep the vector list's order, then that of keyword results alone. A list of equal scores is all ones if they are positive, else zeros.
    """
    own = Window.partitionBy("query_id")

    def normalised(hits: DataFrame, score: str, name: str, rank: str) -> DataFrame:
        flat = F.when(F.max(score).over(own) > 0, 1.0).otherwise(0.0)
        return hits.select("query_id", key, score, F.col("rank").alias(rank), min_max(F.col(score), own, flat).alias(name))

    v = normalised(vector_hits, "similarity", "v_norm", "v_rank")
    w = normalised(keyword_hits, "keyword_score", "k_norm", "k_rank")
    both = v.join(w, ["query_id", key], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.select(
        "query_id", key, zero("similarity").alias("similarity"), zero("keyword_score").alias("keyword_score"), "v_rank", "k_rank",
        F.round(zero("v_norm") * vector_weight + zero("k_norm") * keyword_weight, DECIMALS).alias("combined_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("k_rank"))
    return both.withColumn("rank", F.row_number().over(order)).drop("v_rank", "k_rank")


def checked_weights(vector_weight: float, keyword_weight: float) -> None:
    if not (0 <= vector_weight <= 1 and 0 <= keyword_weight <= 1) or abs(vector_weight + keyword_weight - 1) > 0.01:
        raise ValueError("weights must lie between 0 and 1 and sum to 1")


def hybrid_search(vectors: DataFrame, index, queries: DataFrame, k: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, threshold: float = 0.0, key: str = "chunk_id", index_name: str | None = None) -> DataFrame:
    """Both sides are asked for twice ``k`` (the vector scan for twice that again before its threshold), fused and cut to ``k``."""
    from corvale.operators.bm25 import keyword_search

    checked_weights(vector_weight, keyword_weight)
    v = vector_search(vectors, queries, 2 * k, threshold=threshold, overfetch=2, index_name=index_name, key=key)
    return fuse(v, keyword_search(index, queries, 2 * k, key), vector_weight, keyword_weight, key).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document; hits without are dropped. Title and type default if empty, content is a snippet."""
    from corvale.functions.text import or_default, snippet

    own = hits.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id").join(documents.select(F.col("id").alias("document_id"), "url", "title", "crawl_type"), "document_id")
    return own.select(
        F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), or_default(F.col("title"), "Untitled").alias("title"), "url",
        snippet(F.col("content")).alias("content"), or_default(F.col("crawl_type"), "unknown").alias("source_type"), *(c for c in hits.columns if c != "chunk_id"),
    )


def kmeans_cells(vectors: DataFrame, cells: int = 100, fit_rows: int = 50_000, seed: int = 1, embedding: str = "embedding", key: str = "chunk_id"):
    """Assign each vector a cell of a k-means model fitted on at most ``fit_rows`` rows chosen by a hash of the key: (rows with ``cell``, model)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    as_vector = vectors.withColumn("__f", array_to_vector(vector.unit(F.col(embedding)))).where("__f is not null")
    model = KMeans(k=cells, seed=seed, featuresCol="__f", predictionCol="cell", maxIter=10).fit(as_vector.orderBy(F.xxhash64(key)).limit(fit_rows))
    return model.transform(as_vector).drop("__f"), model


def approximate_search(cells: DataFrame, model, queries: DataFrame, k: int = 10, probes: int = 8, key: str = "chunk_id") -> DataFrame:
    """Exact search within the ``probes`` cells nearest to each query."""
    spark = queries.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>")
    q = queries.select("query_id", vector.unit(F.col("query_vec")).alias("__q"))
    near = q.crossJoin(F.broadcast(centers)).withColumn("d", vector.squared_distance(F.col("__q"), F.col("center")))
    order = Window.partitionBy("query_id").orderBy("d", "cell")
    probed = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= probes).select("query_id", "__q", "cell")
    met = cells.withColumn("__v", vector.unit(F.col("embedding"))).drop("embedding").join(probed, "cell")
    return top(met.withColumn("similarity", F.round(vector.dot(F.col("__v"), F.col("__q")), DECIMALS)).drop("__v", "__q"), "similarity", k, key)
