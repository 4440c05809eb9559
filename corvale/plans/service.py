"""The search service: one object over a store, with the calls of an API as methods that give DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.functions.text import snippet
from corvale.operators import bm25, catalog, rerank, search
from corvale.plans.indexes import METRICS, Indexes
from corvale.plans.ingest import Embedder, embed, process_documents, store_documents
from corvale.sources.store import Store

SEARCH_TYPES = ("vector", "keyword", "hybrid")
STRATEGIES = ("hybrid", "bm25", "quality")


class Service:
    def __init__(self, store: Store, load: Callable[[], Embedder], dimension: int):
        self.store, self.load, self.dimension, self.indexes = store, load, dimension, Indexes(store)
        self._index: bm25.Index | None = None
        self._version: str | None = None

    def ingest(self, incoming: DataFrame, index_name: str = "default", strategy: str = "original") -> DataFrame:
        store_documents(self.store, incoming, index_name)
        return process_documents(self.store, self.load, self.dimension, strategy, index_name=index_name)

    def keyword_index(self) -> bm25.Index:
        """The index over all chunks, built again when chunks were added or replaced."""
        chunks = self.store.read("document_chunks")
        version = f"{self.store._version('document_chunks')}/{chunks.count()}"
        if self._index is None or version != self._version:
            if self._index is not None:
                self._index.unpersist()
            self._index, self._version = bm25.build(chunks.select(F.col("id").alias("chunk_id"), "content")), version
        return self._index

    def _queries(self, texts: list[str]) -> DataFrame:
        for t in texts:
            if not 1 <= len(t) <= 1000:
                raise ValueError("a query has 1 to 1000 characters")
        rows = self.store.spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
        return rows.join(embed(rows, "query_id", "query_text", self.load, self.dimension).withColumnRenamed("embedding", "query_vec"), "query_id")

    def _vectors(self, index_name: str | None) -> DataFrame:
        own = self.store.read("embeddings").where(~F.col("deleted") & (F.col("kind") == "chunk"))
        return (own.where(F.col("index_name") == index_name) if index_name else own).select("chunk_id", "embedding", "index_name")

    def search(self, texts: list[str], k: int = 10, search_type: str = "hybrid", index_name: str | None = None, use_reranking: bool = False, strategy: str = "hybrid", threshold: float = 0.0, vector_weight: float = 0.7, keyword_weight: float = 0.3, index_scoped: bool = False) -> DataFrame:
        """Hits of each text by a search type (any unknown one is hybrid), hydrated, reranked on request.

        Keyword results come from all indexes unless ``index_scoped``.
        """
        catalog.checked("k", k, 1, 50)
        catalog.checked("threshold", threshold, 0, 1)
        queries = self._queries(texts)
        metric = METRICS[(self.indexes.get(index_name) or {}).get("index_type") or "IndexFlatIP"] if index_name else "ip"
        want = 3 * k if use_reranking else k
        chunks = self.store.read("document_chunks").withColumnRenamed("id", "chunk_id")
        words = self.keyword_index()
        if index_name and index_scoped:
            words = bm25.Index(words.postings.join(self._vectors(index_name).select("chunk_id"), "chunk_id", "left_semi"), words.terms, words.stats)
        if search_type == "vector":
            hits = search.vector_search(self._vectors(index_name), queries, want, metric, threshold, 2).withColumn("combined_score", F.col("similarity")).withColumn("keyword_score", F.lit(0.0))
        elif search_type == "keyword":
            hits = bm25.keyword_search(words, queries, want).withColumn("combined_score", F.col("keyword_score")).withColumn("similarity", F.lit(0.0))
        else:
            hits = search.hybrid_search(self._vectors(index_name), words, queries, want, vector_weight, keyword_weight, threshold)
        hits = hits.select("query_id", "chunk_id", "similarity", "keyword_score", "combined_score", "rank")
        if use_reranking:
            texts_of = search.hydrate(hits, chunks, self.store.read("documents")).select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "content", "combined_score", "rank")
            best = rerank.rerank(texts_of.join(queries.select("query_id", "query_text"), "query_id"), strategy, k)
            hits = hits.drop("rank").join(best.select("query_id", "chunk_id", "final_score", "rank"), ["query_id", "chunk_id"])
        return search.hydrate(hits, chunks, self.store.read("documents")).orderBy("query_id", "rank")

    def search_in_document(self, text: str, document_id: int, most: int = 5) -> DataFrame:
        """The best chunks of one document."""
        catalog.checked("most", most, 1, 20)
        inside = self.store.read("document_chunks").where(F.col("document_id") == document_id).select(F.col("id").alias("chunk_id"))
        return search.vector_search(self._vectors(None), self._queries([text]), most, allowed=inside)

    def search_all_indexes(self, text: str, k: int = 10, use_reranking: bool = False, strategy: str = "hybrid") -> DataFrame:
        """The best of all active indexes: twice ``k`` of each by vectors, put together with the keyword hits, reranked on request."""
        catalog.checked("k", k, 1, 50)
        queries = self._queries([text])
        active = self.store.read("vector_indexes").where("is_active").select(F.col("name").alias("index_name"))
        own = self._vectors(None).join(F.broadcast(active), "index_name", "left_semi")
        found = search.search_all_indexes(own, queries, 3 * k if use_reranking else k).select("query_id", "chunk_id", "similarity", "rank")
        words = bm25.keyword_search(self.keyword_index(), queries, 2 * k).join(own.select("chunk_id").distinct(), "chunk_id", "left_semi")
        hits = search.fuse(found, words).where(F.col("rank") <= (3 * k if use_reranking else k))
        if use_reranking:
            texts = hits.join(self.store.read("document_chunks").select(F.col("id").alias("chunk_id"), snippet(F.col("content")).alias("content")), "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
            best = rerank.rerank(texts, strategy, k)
            hits = hits.drop("rank").join(best.select("query_id", "chunk_id", "final_score", "rank"), ["query_id", "chunk_id"])
        return hits.join(own.select("chunk_id", "index_name").distinct(), "chunk_id").orderBy("rank")

    def sources(self, **params) -> DataFrame:
        return catalog.sources(self.store.read("documents"), self.store.read("document_chunks"), **params)

    def keyword_statistics(self) -> DataFrame:
        """One row: chunks indexed, terms, and the mean length, with the number of rows of each table."""
        own = self.keyword_index()
        return self.statistics().crossJoin(own.stats).crossJoin(own.terms.agg(F.count(F.lit(1)).alias("n_terms")))

    def statistics(self) -> DataFrame:
        names = {"documents": "documents", "chunks": "document_chunks", "embeddings": "embeddings", "code_examples": "code_examples"}
        return catalog.counts(**{n: self.store.read(t) for n, t in names.items()})
