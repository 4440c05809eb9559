"""Content-addressed store of token ids.

Texts become id streams; a rolling hash over the ids cuts each stream into
chunks; a chunk is stored once under the digest of its bytes. Files:

``chunks/``    digest, ids: each distinct chunk once (unsigned 16- or 32-bit little-endian ids)
``recipes/``   one row per document in ascending doc_id order: the digests and lengths of its chunks
``manifest/``  per recipe file its rows, ids and Merkle root

Reading back recomputes every chunk's digest and every file's Merkle root and
fails if one differs. Null texts are empty (the end id alone), repeated rows
have a recipe each, rows without a doc_id come first. An empty table gives
empty files. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import checkpoint_dir, join_spread, materialize, ship
from corvale.llm.packing import id_batches, id_texts, with_starts

#: A cut follows an id where the hash of the last WINDOW ids is below 1 / MEAN of its range; chunks have LEAST to MOST ids.
WINDOW, MEAN, LEAST, MOST = 4, 512, 64, 4096
DIGEST = 16
CHUNKS, RECIPES = "digest binary, ids binary", "doc_id long, part long, part_start long, n_tokens long, digests binary, lengths binary"
MANIFEST = "part long, n_docs long, n_tokens long, root binary"


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream; they depend on nearby ids only, so equal passages give equal chunks."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    rolled = np.zeros(n - WINDOW + 1, np.uint32)
    for j in range(WINDOW):
        rolled *= np.uint32(0x01000193)
        rolled += ids[j : n - WINDOW + 1 + j]
    rolled *= np.uint32(0x9E3779B1)
    marks = np.flatnonzero(rolled < np.uint32((1 << 32) // MEAN)) + WINDOW
    ends, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST or m == n and m > at:
            at = m
            ends.append(at)
    return ends


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:DIGEST]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over hashed leaves, pairs hashed upwards, an odd last one carried."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded rows to rows with digests and lengths of their chunks."""
    for batch in batches:
        doc_ids, counts, raws = (batch.column(name).to_pylist() for name in ("doc_id", "n_tokens", "ids"))
        digests, lengths = [], []
        for n, raw in zip(counts, raws, strict=True):
            size = len(raw) // n
            ends = cut_points(np.frombuffer(raw, f"<u{size}").astype(np.uint32))
            starts = [0, *ends[:-1]]
            digests.append(b"".join(_digest(raw[a * size : b * size]) for a, b in zip(starts, ends, strict=True)))
            lengths.append(np.diff([0, *ends]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(raws, pa.binary()), pa.array(digests, pa.binary()), pa.array(lengths, pa.binary())], ["doc_id", "n_tokens", "ids", "digests", "lengths"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ids) for each chunk; what this task gave lately isn't given again."""
    seen: set[bytes] = set()
    for batch in batches:
        names, parts = [], []
        for n, raw, digests, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size, at = len(raw) // n, 0
            for k, length in enumerate(np.frombuffer(lengths, "<u4").tolist()):
                d = digests[k * DIGEST : (k + 1) * DIGEST]
                if d not in seen:
                    seen.add(d)
                    names.append(d)
                    parts.append(raw[at * size : (at + length) * size])
                at += length
        if len(seen) > 500_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parts, pa.binary())], ["digest", "ids"])


def _recipe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column(1).to_numpy()
        upto = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), part, np.int64)), pa.array((before + upto - counts).astype(np.int64)), batch.column(1), batch.column(2), batch.column(3)], ["doc_id", "part", "part_start", "n_tokens", "digests", "lengths"])
        before += int(upto[-1]) if len(upto) else 0


def _leaf(doc_id, start: int, n: int, digests: bytes, lengths: bytes) -> bytes:
    return b"%s|%d|%d|%s%s" % (str(doc_id).encode(), start, n, digests, lengths)


def _manifest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of the recipe rows of each part that a task reads, in order of their starts."""
    leaves: dict[int, list[tuple[int, int, bytes]]] = {}
    for batch in batches:
        for doc_id, part, start, n, digests, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            leaves.setdefault(part, []).append((start, n, hashlib.sha256(_leaf(doc_id, start, n, digests, lengths)).digest()))
    rows = [(part, len(own), sum(x[1] for x in own), merkle_root([x[2] for x in sorted(own)])) for part, own in sorted(leaves.items())]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "n_docs", "n_tokens", "root"])


def _manifest(recipes: DataFrame) -> DataFrame:
    """A part is one task's rows, so its leaves fit the task that hashes them."""
    return recipes.repartition("part").mapInArrow(_manifest_rows, MANIFEST)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, cache: int = 800_000) -> None:
    """Encode ``docs`` (doc_id, text) and write the store's files under ``path``; a worker keeps the ids of ``cache`` words."""
    spark = docs.sparkSession
    ids_of = id_batches(tokenizer, end_id, cache)
    split = materialize(id_texts(docs).mapInArrow(lambda batches: _split(ids_of(batches)), "doc_id long, n_tokens long, ids binary, digests binary, lengths binary"), "split")
    (
        split.select("n_tokens", "ids", "digests", "lengths").mapInArrow(_chunk_rows, CHUNKS)
        .groupBy("digest").agg(F.first("ids").alias("ids"))
        .write.option("compression", "zstd").parquet(f"{path}/chunks")
    )
    recipes = split.select("doc_id", "n_tokens", "digests", "lengths")
    (
        recipes.repartitionByRange(F.col("doc_id"), F.col("digests")).sortWithinPartitions("doc_id", "digests", "lengths")
        .mapInArrow(_recipe_rows, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    )
    _manifest(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``, the ids of all documents before, after each file's Merkle root was compared."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    written = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    again = _manifest(recipes)
    if written.exceptAll(again).limit(1).count() or again.exceptAll(written).limit(1).count():
        raise ValueError(f"recipes under {path} differ from their manifest")
    return with_starts(recipes)


def _read_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Digest, number of ids and CRC of the ids as unsigned 32-bit; fails on a damaged chunk."""
    for batch in batches:
        digests, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for d, raw in zip(digests, raws, strict=True):
            if _digest(raw) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
        crcs = [zlib.crc32(np.frombuffer(raw, f"<u{size}").astype("<u4").tobytes()) for raw in raws]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // size for r in raws], pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])


def _zero_byte_table() -> np.ndarray:
    """What one appended zero byte makes of each bit of a CRC-32 register (reflected polynomial 0xEDB88320)."""
    out = np.zeros(32, np.uint32)
    for bit in range(32):
        r = 1 << bit
        for _ in range(8):
            r = (r >> 1) ^ (0xEDB88320 if r & 1 else 0)
        out[bit] = r
    return out


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(32):
        out ^= np.where(v >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """A CRC's share of the whole when ``zeros`` bytes follow: shares of all pieces, xor-ed, are the CRC of the pieces joined."""
    out, rest, matrix = crc.astype(np.uint32), zeros.copy(), _zero_byte_table()
    while rest.any():
        out = np.where(rest & 1, _apply(matrix, out), out)
        rest >>= 1
        matrix = _apply(matrix, matrix)
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, starts, names, lengths, tails = [], [], [], [], []
        for doc_id, n, digests, raw, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(raw, "<u4").astype(np.int64)
            docs += [doc_id] * len(own)
            starts += [start] * len(own)
            names += [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            lengths += own.tolist()
            tails += (n - np.cumsum(own)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(names, pa.binary()), pa.array(lengths, pa.int64()), pa.array(tails, pa.int64())], ["doc_id", "start", "digest", "length", "tail"])


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = shifted_crc(batch.column(2).to_numpy().astype(np.uint32), batch.column(3).to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share.astype(np.int64)), batch.column(4)], ["doc_id", "start", "share", "length"])


def read_digests(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32.

    Chunks are read, checked and reduced to CRCs where they lie; only those
    travel to the recipes; those that very many documents share are dealt over
    parts. CRC shares of a document's chunks combine by xor.
    """
    ship(spark)
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(lambda b: _read_chunks(b, size), "digest binary, n_ids long, crc long")
    chunks = materialize(chunks, "crcs")
    rows = verified_recipes(spark, path).select("doc_id", "n_tokens", "digests", "lengths", "start").mapInArrow(_explode, "doc_id long, start long, digest binary, length long, tail long")
    met = join_spread(rows, chunks, ["digest"], "start", 96).select("doc_id", "start", F.expr("if(n_ids = length, crc, raise_error('a recipe names a chunk that is not there'))").cast("long").alias("crc"), "tail", "length")
    return met.mapInArrow(_share, "doc_id long, start long, share long, length long").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Rebuild each document's ids: doc_id, start, ids (unsigned ``size``-byte)."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    rows = verified_recipes(spark, path).select("doc_id", "n_tokens", "digests", "lengths", "start").mapInArrow(_explode, "doc_id long, start long, digest binary, length long, tail long")
    parts = rows.join(chunks, "digest").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct((-F.col("tail")).alias("at"), "ids"))).alias("parts"))
    return parts.select("doc_id", "start", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def id_size(tokenizer: str) -> int:
    from corvale.llm.tokens import encoder

    return 4 if encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 else 2


def store_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and give the digests read back from it."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/corvale-store-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id)
    return read_digests(spark, path, id_size(tokenizer))
