"""Operators over DataFrames: chunking, search, fusion, reranking, catalog, deduplication, crawling."""
