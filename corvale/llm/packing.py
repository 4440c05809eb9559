"""Packing token streams into fixed windows: concatenate and cut.

Every text is encoded once; a partition writes its rows with the number of ids
before each of them in the partition. The partitions' totals (one row each)
become offsets by a prefix sum, so each row's place in the one long stream is
its partition's offset plus its own, and no row is moved. The stream is cut
every ``window`` ids: a row that lies across a cut gives several pieces.

Null texts are empty and give the end id alone. Repeated rows are packed once
each. An empty table gives no rows. Other columns of the input are ignored. A
text of any length is encoded in one go, with those that share its batch of at
most 8 MB or of itself alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import materialize, repeatable, small_batches, tidied
from corvale.llm.tokens import CACHE, encoder, gathered

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def id_batches(tokenizer: str, end_id: int, cache: int = CACHE):
    """A function from batches of (doc_id, text) to batches of (doc_id, part, part_start, n_tokens, ids)."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer, cache)
        wide = own.tokenizer.get_vocab_size() > 1 << 16
        for batch in gathered(batches):
            ids, counts = own.encode(batch.column(1), end_id)
            raw, size = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
            upto = np.cumsum(counts)
            cuts = [0, *(upto * size).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), part)), pa.array(before + upto - counts), pa.array(counts), pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(upto[-1])

    return rows


def id_texts(docs: DataFrame) -> DataFrame:
    return small_batches(repeatable(docs, "texts")).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document: ids (unsigned 16-bit or, for larger vocabularies, 32-bit, little-endian), with place in its partition."""
    return id_texts(docs).mapInArrow(id_batches(tokenizer, end_id), "doc_id long, part long, part_start long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all rows before: the partitions' totals, summed up, plus the place in the partition.

    The totals are one row per partition of the encoding job, a number of
    tasks, so they are summed and joined as a broadcast table.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    offsets, at = [], 0
    for part, n in sorted(map(tuple, totals)):
        offsets.append((part, at))
        at += n
    table = spark.createDataFrame(offsets, "part long, part_offset long")
    return rows.join(F.broadcast(table), "part").withColumn("start", F.col("part_offset") + F.col("part_start")).drop("part_offset", "part_start", "part")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack the ids of all ``docs`` (doc_id, text) into sequences of ``window`` ids; a row per piece, with its ids if asked for."""
    placed = with_starts(materialize(encoded(docs, tokenizer, end_id), "tokens"))
    schema = PIECES + (", ids binary" if with_ids else "")

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            out: list[tuple] = []
            kept: list[bytes] = []
            for doc_id, n, raw, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                at = 0
                while at < n:
                    offset = (start + at) % window
                    length = min(n - at, window - offset)
                    piece = ids[at : at + length].tobytes()
                    out.append((doc_id, at, length, zlib.crc32(piece), n, (start + at) // window, offset))
                    if with_ids:
                        kept.append(piece)
                    at += length
            if out:
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] + ([pa.array(kept, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return placed.select("doc_id", "n_tokens", "ids", "start").mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The padded sequences (sequence_id, ids) of pieces that carry their ids.

    Sequences have ``window`` ids; the last is padded to it unless its own
    length is a power of two already.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                n = len(ids)
                out.append(ids.tolist() if n & (n - 1) == 0 else np.pad(ids, (0, window - n), constant_values=pad_id).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    # a sequence has at most `window` pieces, so its list is bounded
    lists = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return lists.mapInArrow(build, "sequence_id long, ids array<long>")
