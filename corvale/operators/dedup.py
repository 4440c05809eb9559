"""Deduplication by url and content hash, of documents and of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_documents(batch: DataFrame, stored: DataFrame, order: str = "id") -> DataFrame:
    """Rows of ``batch`` (url, content_hash) of which neither url nor hash is stored, and of equal ones in the batch the first.

    Two anti-joins, one for each key, as a join on either could only be a nested
    loop. ``order`` is unique; null urls, and null hashes, are like each other.
    """
    fresh = batch.join(stored.select("url"), "url", "left_anti").join(stored.select("content_hash"), "content_hash", "left_anti")
    return first_of(first_of(fresh, "url", order), "content_hash", order).select(*batch.columns)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the first by ``order``, found by an aggregate that combines map-side (so one key may have any number of rows).

    The firsts are joined by ``order``, which is unique, so a frequent key isn't a frequent join key.
    """
    best = rows.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return rows.join(best, order, "left_semi")


def stored_chunks(chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Chunks that get stored: a hash that an earlier document has is left out, repeats within one document stay.

    First (hash, document) pairs are made once, then joined by both, so the
    chunks of a frequent hash don't meet in a task.
    """
    if stored is not None:
        known = stored.select("content_hash").distinct()
        chunks = chunks.join(known, "content_hash", "left_anti")
    first = chunks.groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
    return chunks.join(first, ["content_hash", "document_id"], "left_semi")


def without_visited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    return urls.join(visited, "url", "left_anti")
