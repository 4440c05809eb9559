"""Filters, listings, counts and statistics over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")


def _like(text: str):
    """A pattern where ``%`` and ``_`` of the text stay wildcards, case ignored."""
    return lambda c: F.col(c).ilike(f"%{text}%")


def by_id(rows: DataFrame, value, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def by_source(documents: DataFrame, source_id: str, limit: int = 100) -> DataFrame:
    """A source's documents, newest first."""
    return documents.where(F.col("source_id") == source_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def search_documents(documents: DataFrame, text: str | None = None, source_id: str | None = None, crawl_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Text in title, content or url, and equal source and type, newest first."""
    if text:
        has = _like(text)
        documents = documents.where(has("title") | has("content") | has("url"))
    if source_id:
        documents = documents.where(F.col("source_id") == source_id)
    if crawl_type:
        documents = documents.where(F.col("crawl_type") == crawl_type)
    return documents.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def by_url(documents: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    checked("limit", limit, 1, 200)
    return documents.where(_like(pattern)("url")).orderBy("id").limit(limit)


def page(rows: DataFrame, limit: int, offset: int = 0, newest: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(newest), F.desc("id")).offset(offset).limit(limit)


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [t.select(F.lit(name).alias("t")) for name, t in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.agg(*(F.count_if(F.col("t") == name).alias(name) for name in tables))


def count_by(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_by_count(rows: DataFrame, column, k: int = 10, name: str = "value") -> DataFrame:
    """The ``k`` most frequent values; null and empty ones take a place, then go."""
    c = F.col(column) if isinstance(column, str) else column
    best = rows.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(name)).limit(k)
    return best.where(F.coalesce(F.col(name), F.lit("")) != "")


def url_suffix(url: str = "url"):
    """The url without its scheme."""
    return F.expr(f"substr({url}, instr({url}, '://') + 3)")


def distinct_types(documents: DataFrame) -> DataFrame:
    return documents.select("crawl_type").where(F.coalesce("crawl_type", F.lit("")) != "").distinct()


def chunk_rollup(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with chunk_count and content_length of their chunks; zero without. Chunks are summed before the join."""
    sums = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content")).alias("content_length"))
    met = documents.join(sums, F.col("id") == F.col("document_id"), "left").drop("document_id")
    return met.fillna(0, ["chunk_count", "content_length"])


def _sources(documents: DataFrame, url_pattern: str | None, source_type: str | None, index_id: int | None) -> DataFrame:
    if url_pattern:
        documents = documents.where(_like(url_pattern)("url"))
    if source_type:
        documents = documents.where(F.col("crawl_type") == source_type)
    if index_id is not None:
        documents = documents.where(F.col("vector_index_id") == index_id)
    return documents


def sources(documents: DataFrame, chunks: DataFrame, limit: int = 50, url_pattern: str | None = None, source_type: str | None = None, index_id: int | None = None) -> DataFrame:
    """A page of documents with their rollup; predicates and the limit go below the aggregation."""
    return sources_page(documents, chunks, limit, url_pattern, source_type, index_id)[1]


def sources_page(
    documents: DataFrame, chunks: DataFrame, limit: int = 50, url_pattern: str | None = None, source_type: str | None = None, index_id: int | None = None
) -> tuple[int, DataFrame]:
    """How many documents match, and a page of them with their rollup."""
    checked("limit", limit, 1, 200)
    own = _sources(documents, url_pattern, source_type, index_id)
    return own.count(), _rolled(own.orderBy("id").limit(limit), chunks).orderBy("id")


def document_page(
    documents: DataFrame, chunks: DataFrame, limit: int = 50, offset: int = 0, source_id: str | None = None, crawl_type: str | None = None, newest: str = "created_at"
) -> tuple[int, DataFrame]:
    """How many documents match, and a page of them with their rollup, newest first."""
    for name, value in (("source_id", source_id), ("crawl_type", crawl_type)):
        documents = documents.where(F.col(name) == value) if value else documents
    return documents.count(), _rolled(page(documents, limit, offset, newest), chunks).orderBy(F.desc(newest), F.desc("id"))


def _rolled(own: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rollup of a page of documents, made of their own chunks alone."""
    return chunk_rollup(own, chunks.join(F.broadcast(own.select(F.col("id").alias("document_id"))), "document_id", "left_semi"))


def index_rollup(documents: DataFrame, k: int = 10) -> DataFrame:
    """(index_name, kind, value, n): for each index its types, and its ``k`` most frequent domains."""
    types = documents.where(F.coalesce("crawl_type", F.lit("")) != "").groupBy("index_name", F.col("crawl_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    domains = documents.groupBy("index_name", F.col("domain").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("index_name").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    domains = domains.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r").where(F.coalesce("value", F.lit("")) != "")
    return types.select("index_name", F.lit("type").alias("kind"), "value", "n").unionByName(domains.select("index_name", F.lit("domain").alias("kind"), "value", "n"))


def index_statistics(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per index (``index_name`` in documents and vectors): documents, chunks, live and deleted vectors."""
    d = documents.groupBy("index_name").agg(F.count(F.lit(1)).alias("total_documents"))
    c = chunks.join(documents.select("id", "index_name"), F.col("document_id") == F.col("id")).groupBy("index_name").agg(F.count(F.lit(1)).alias("total_chunks"))
    v = vector_statistics(vectors)
    return d.join(c, "index_name", "full_outer").join(v, "index_name", "full_outer").fillna(0, ["total_documents", "total_chunks", "total_vectors", "active_vectors", "deleted_vectors"])


def vector_statistics(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("index_name").agg(F.count(F.lit(1)).alias("total_vectors"), F.count_if(~F.col("deleted")).alias("active_vectors"), F.count_if("deleted").alias("deleted_vectors"))


def throughput(batches: DataFrame) -> DataFrame:
    """Totals and rate of (n_texts, seconds), and the rate of the last batch if there is a ``batch`` number."""
    rate = lambda n, s: F.when(s > 0, n / s).otherwise(0.0)
    own = [F.sum("n_texts").alias("total"), F.sum("seconds").alias("seconds"), rate(F.sum("n_texts"), F.sum("seconds")).alias("rate")]
    if "batch" in batches.columns:
        own.append(F.max_by(rate(F.col("n_texts"), F.col("seconds")), "batch").alias("last_rate"))
    return batches.agg(*own)
