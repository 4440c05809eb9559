"""Ingest: documents in, chunks and vectors out, with deduplication against what is stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions import url as U
from corvale.functions.text import strip, title, word_count
from corvale.operators.chunking import chunk
from corvale.operators.dedup import new_documents, stored_chunks
from corvale.session import shared_folder
from corvale.sources.store import Store

LEAST_CONTENT = 10
Embedder = Callable[[list[str]], "np.ndarray"]


def hash_embedder(dimension: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed counts of hashed words, of length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % dimension] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out

    return embed


def embed(rows: DataFrame, key: str, text: str, load: Callable[[], Embedder], dimension: int, batch: int = 100, prompt: str = "") -> DataFrame:
    """(key, embedding) of all rows; an error of the model is raised. ``prompt`` is put before each text, as models ask it for queries."""
    got = tried(rows, key, text, load, dimension, batch, prompt)
    return got.select(key, F.when(F.col("error").isNull(), F.col("embedding")).otherwise(F.raise_error(F.col("error")).cast("array<float>")).alias("embedding"))


def tried(rows: DataFrame, key: str, text: str, load: Callable[[], Embedder], dimension: int, batch: int = 100, prompt: str = "") -> DataFrame:
    """(key, embedding, error): ``load`` gives the model once in each task, which embeds ``batch`` texts at a time.

    The texts of a batch that fails are tried one by one, so that an error is that of its own text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None

        def vectors(texts: list[str]) -> list[np.ndarray]:
            got = np.asarray(model(texts), np.float32)
            if got.shape != (len(texts), dimension):
                raise ValueError(f"the model gives {got.shape[-1]} dimensions, not {dimension}")
            return list(got)

        for b in batches:
            model = model or load()
            texts = [prompt + (t or "") for t in b.column(1).to_pylist()]
            out: list[np.ndarray | None] = []
            errors: list[str | None] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    own: list[tuple] = [(v, None) for v in vectors(part)]
                except Exception:  # noqa: BLE001 - whatever a model raises belongs to a text
                    own = []
                    for t in part:
                        try:
                            own.append((vectors([t])[0], None))
                        except Exception as e:  # noqa: BLE001
                            own.append((None, f"{type(e).__name__}: {e}"))
                out += [v for v, _ in own]
                errors += [e for _, e in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32())), pa.array(errors, pa.string())], [key, "embedding", "error"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>, error string")


class Model:
    """A model that is loaded when first asked: its dimension by a probe, what is known of it, a warm-up, and letting go."""

    def __init__(self, load: Callable[[], Embedder], name: str = "hash"):
        self.load, self.name, self._own = load, name, None

    def __call__(self) -> Embedder:
        if self._own is None:
            self._own = self.load()
        return self._own

    @property
    def dimension(self) -> int:
        return int(np.asarray(self()(["probe"])).shape[1])

    def warm_up(self) -> None:
        self()(["warm-up"])

    def info(self) -> dict:
        return {"name": self.name, "loaded": self._own is not None, "dimension": self.dimension if self._own is not None else None}

    def clear(self) -> None:
        self._own = None

    def __getstate__(self) -> dict:  # workers load their own
        return {"load": self.load, "name": self.name, "_own": None}


def enrich(incoming: DataFrame) -> DataFrame:
    """Documents from (url, content, optional title, source_id, crawl_type, doc_metadata), those of too little content left out."""
    has = set(incoming.columns)
    kept = incoming.where(F.length(strip(F.col("content"))) >= LEAST_CONTENT)
    given = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default) if c in has else default
    own = F.create_map(F.lit("title"), title(F.col("content")), F.lit("domain"), U.netloc(F.col("url")))
    return kept.select(
        "url", given("title", title(F.col("content"))).alias("title"), "content", F.md5("content").alias("content_hash"), given("source_id", U.source_id(F.col("url"))).alias("source_id"),
        U.netloc(F.col("url")).alias("domain"), word_count(F.col("content")).alias("word_count"), F.length("content").alias("char_count"), given("crawl_type", F.lit("webpage")).alias("crawl_type"),
        (F.coalesce(F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key("doc_metadata", k)), F.col("doc_metadata")), own) if "doc_metadata" in has else own).alias("doc_metadata"),
    )


def numbered(rows: DataFrame, first: int, order: list[str], name: str = "id") -> DataFrame:
    """Consecutive ids from ``first`` on in the given order: rows are ranged and counted by partition, not gathered in one."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    ranged = ranged.checkpoint()  # a lost executor must not range and number anew
    totals = sorted((r["__p"], r["n"]) for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    starts, at = [], first
    for p, n in totals:
        starts.append((p, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "__p int, __from long")
    within = F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)
    return ranged.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__from") + within).drop("__p", "__i", "__from")


def _last_id(rows: DataFrame, column: str = "id") -> int:
    return rows.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def store_documents(store: Store, incoming: DataFrame, index_name: str = "default") -> DataFrame:
    """Store the new documents of ``incoming`` for an index that must exist; gives the rows stored."""
    found = store.read("vector_indexes").where(F.col("name") == index_name).select("id").first()
    if found is None:
        raise ValueError(f"index {index_name} does not exist")
    with store.lock("documents"):
        return _store_documents(store, incoming, found["id"])


def _store_documents(store: Store, incoming: DataFrame, index_id: int) -> DataFrame:
    stored = store.read("documents")
    # of rows with one url the first by content counts; the key is unique, as first_of asks
    own = enrich(incoming).withColumn("__order", F.concat_ws("\n", "url", "content_hash")).dropDuplicates(["__order"])
    fresh = new_documents(own, stored, "__order").drop("__order")
    last = _last_id(stored)
    rows = numbered(fresh, last + 1, ["url"]).withColumns({"vector_index_id": F.lit(index_id), "is_processed": F.lit(False), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    store.append("documents", rows)
    return store.read("documents").where(F.col("id") > last)


def process_documents(store: Store, load: Callable[[], Embedder], dimension: int, strategy: str = "original", model_name: str = "hash", index_name: str = "default", **params) -> DataFrame:
    """Chunk, deduplicate and embed all documents that wait, and mark them; gives the chunks stored.

    A document with a chunk that the model fails on keeps waiting, with that
    error as its ``processing_error`` and none of its chunks.
    """
    with store.lock("document_chunks"):
        documents, before = store.read("documents"), store.read("document_chunks")
        waiting = documents.where(~F.col("is_processed"))
        pieces = chunk(waiting, strategy, key="id", text="content", **params).withColumnRenamed("id", "document_id")
        last, place = _last_id(before), _last_id(before, "faiss_index") if before.limit(1).count() else -1
        kept = numbered(stored_chunks(pieces, before), last + 1, ["document_id", "chunk_index"])
        vectors = tried(kept, "id", "content", load, dimension).checkpoint()
        failed = kept.select("id", "document_id").join(vectors.where("error IS NOT NULL"), "id").groupBy("document_id").agg(F.min("error").alias("__error")).checkpoint()
        kept = kept.join(failed, "document_id", "left_anti").withColumn("faiss_index", F.col("id") - last + place).withColumn("created_at", F.current_timestamp())
        store.append("document_chunks", kept)
        chunks = store.read("document_chunks").where(F.col("id") > last)
        own = vectors.join(chunks.select("id"), "id", "left_semi")
        store.append("embeddings", own.select(F.col("id"), F.col("id").alias("chunk_id"), F.lit("chunk").alias("kind"), F.lit(model_name).alias("model_name"), F.lit(dimension).alias("embedding_dimension"), "embedding", F.lit(index_name).alias("index_name"), F.lit(False).alias("deleted"), F.current_timestamp().alias("created_at")))
        waits = ~F.col("is_processed")
        marked = documents.join(failed, F.col("id") == F.col("document_id"), "left").withColumns({
            "processing_error": F.when(waits, F.col("__error")).otherwise(F.col("processing_error")),
            "updated_at": F.when(waits, F.current_timestamp()).otherwise(F.col("updated_at")),
            "is_processed": F.col("is_processed") | F.col("__error").isNull(),
        })
        store.replace("documents", marked.drop("document_id", "__error"))
        return chunks


def store_code_examples(store: Store, examples: DataFrame, load: Callable[[], Embedder], dimension: int, index_name: str = "default") -> None:
    """Code (document_id, code, language, summary) with vectors of summary and code; their kind keeps them apart from chunks."""
    last = _last_id(store.read("code_examples"))
    rows = numbered(examples.withColumn("created_at", F.current_timestamp()), last + 1, ["document_id", "code"])
    store.append("code_examples", rows)
    own = store.read("code_examples").where(F.col("id") > last).select("id", F.concat_ws("\n", "summary", "code").alias("t"))
    vectors = embed(own, "id", "t", load, dimension)
    store.append("embeddings", vectors.select(F.col("id").alias("chunk_id"), F.lit("code").alias("kind"), F.lit(dimension).alias("embedding_dimension"), "embedding", F.lit(index_name).alias("index_name"), F.lit(False).alias("deleted")))


def rebuilt_positions(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, position, embedding) of all chunks that have a vector, by chunk id from 0."""
    met = embeddings.where(F.col("embedding").isNotNull()).join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id")
    return numbered(met, 0, ["chunk_id"], "position").select("chunk_id", "position", "embedding")


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(time))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
