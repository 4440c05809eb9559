"""Texts in compressed chunks, and messages between chunks and buckets.

``packed`` writes a table once with about ``size`` bytes of text in each row
(chunk). An operator then sends, from each chunk, one compact message to each
bucket it has something for; a bucket's messages meet in one task, which
answers each chunk; a chunk's answers meet its texts again. So millions of
small facts travel as sorted arrays in a few large rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import grouped, materialize, repeatable, small_batches, text_bytes, tidied

CHUNK_BYTES = 4 << 20
#: Texts a bucket stands for, so that what meets in a task stays a few MB at any size of the input.
BUCKET_BYTES = 24 << 20
MESSAGE = "chunk long, bucket long, message binary"


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of any integer type as one compressed value."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        kind = a.dtype.str.encode().ljust(4)
        out += [kind, np.array([len(a)], "<u8").tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def expand(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    heads = [(data[4 + 12 * i : 8 + 12 * i].decode().strip(), int(np.frombuffer(data, "<u8", 1, 8 + 12 * i)[0])) for i in range(n)]
    at, out = 4 + 12 * n, []
    for kind, size in heads:
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def chunk_of(ids: list[int | None], texts: list[bytes]) -> bytes:
    return squeeze(np.array([x or 0 for x in ids], "<i8"), np.array([x is None for x in ids], np.uint8), np.array([len(t) for t in texts], "<u4"), np.frombuffer(b"".join(texts), np.uint8), level=3)


def texts_of(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    ids, null, lens, raw = expand(blob)
    ends = np.cumsum(lens.astype(np.int64)).tolist()
    return [None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)], [raw[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(batches).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def rest_of(raw: bytes) -> pa.Table:
    """The columns that were carried along: whether the text was null, then the others."""
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def packed(docs: DataFrame, size: int = CHUNK_BYTES, carry: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as rows (chunk, n_bytes, blob); null texts are empty.

    With ``carry`` there is a column ``rest`` of the other columns (see ``rest_of``).
    """

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        others: list[pa.RecordBatch] = []
        held = 0

        def full() -> pa.RecordBatch:
            cols = [pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([chunk_of(ids, texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols + ([pa.array([_ipc(others)], pa.binary())] if carry else []), ["chunk", "n_bytes", "blob", "rest"][: 3 + carry])

        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[2:], [f"c{i}" for i in range(batch.num_columns - 2)]) if carry else None
            taken = 0
            for at, (i, t) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True), 1):
                ids.append(i)
                texts.append(t)
                held += len(t) + 1
                if held >= size:
                    if carry:
                        others.append(rest.slice(taken, at - taken))
                    taken = at
                    yield full()
                    number += 1
                    ids, texts, others, held = [], [], [], 0
            if carry and taken < batch.num_rows:
                others.append(rest.slice(taken))
        if ids:
            yield full()

    source = small_batches(repeatable(docs, "texts"))
    extra = [F.col("text").isNull(), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))] if carry else []
    extra = [c.alias(f"c{i}") for i, c in enumerate(extra)]
    out = materialize(source.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra).mapInArrow(rows, "chunk long, n_bytes long, blob binary" + ", rest binary" * carry), "chunks")
    return small_batches(out, 1)  # a row is a whole chunk


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def messages(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table.column("chunk").to_pylist(), table.column("message").to_pylist(), strict=True))


def message_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["chunk", "bucket", "message"])


def send(chunks: DataFrame, say: Callable[[list[int | None], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The messages (bucket, bytes) that ``say`` gives for the ids and texts of each chunk."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield message_batch([(chunk, b, m) for b, m in say(*texts_of(blob))])

    return chunks.select("chunk", "blob").mapInArrow(rows, MESSAGE)


def meet(sent: DataFrame, buckets: int) -> DataFrame:
    """Deal messages to their buckets, in order of the chunks.

    A partition may hold several buckets, one after the other, so the number of
    partitions is bounded by the cluster's setting, whatever that of buckets.
    """
    most = 4 * int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(max(1, min(buckets, most)), "bucket").sortWithinPartitions("bucket", "chunk")


def answer(sent: DataFrame, buckets: int, reply: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The answers (chunk, bytes) that ``reply`` gives for all (chunk, bytes) of each bucket."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped(batches, ["bucket"]):
            bucket = own.column("bucket")[0].as_py()
            yield message_batch([(c, bucket, m) for c, m in reply(bucket, messages(own))])

    return meet(sent, buckets).mapInArrow(rows, MESSAGE)


def receive(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with its answers by bucket; their number is bounded by that of the buckets."""
    own = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "message"))).alias("answers"))
    return chunks.drop("n_bytes").join(own, "chunk", "left")
