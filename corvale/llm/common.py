"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Long texts make a batch of the default 10,000 rows too large for a worker.
BATCH_ROWS = 512
#: A side may be broadcast when its rows, at the stated bytes each, stay below this; as a hash table it takes about three times that in each executor.
BROADCAST_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once in an application: they may lack them."""
    context = spark.sparkContext
    if getattr(context, "_corvale_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="corvale-"), f"corvale-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    context._corvale_shipped = True


def over(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a DataFrame of another session of the same application."""
    dataset = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` in a copy of its session whose Arrow batches have at most ``rows`` rows; the caller's own settings stay as they are."""
    spark = df.sparkSession
    ship(spark)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return over(df, own)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. In local mode a temporary folder does where the session names none; on a cluster that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corvale-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written_paths(spark: SparkSession) -> list[str]:
    """Folders that the operators of this application have written for intermediate results, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_corvale_written"):
        context._corvale_written = []
    return context._corvale_written


def clean_up(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the intermediate results from number ``since`` on, but those that ``keep`` reads; how many went.

    Results that aren't written yet still read theirs: call it when they are.
    """
    paths = written_paths(spark)
    files = [] if keep is None else keep.inputFiles()
    gone = [p for p in paths[since:] if not any(p in f for f in files)]
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        paths.remove(p)
    return len(gone)


def materialize(df: DataFrame, label: str, row_group: int = 128 << 20, level: int = 3) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    It cuts the lineage like checkpoint(), but the files are compressed, only
    the columns in use are read again, and a lost executor loses nothing. A
    reader holds a column of a row group, so large binaries need small ones.
    A higher ``level`` takes more time and less room.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/corvale-{label}-{uuid.uuid4().hex}"
    written_paths(spark).append(path)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", row_group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """A small result, written once, as a DataFrame of the caller's session ``spark``."""
    return over(materialize(df, label), spark)


def repeatable(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if it only scans files (its rows come in the same order when read again), else a written copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if re.search(r"Exchange|Python|Arrow|Pandas|Sample|ExistingRDD|nondeterministic|rand\(|uuid\(", plan):
        return materialize(df, label)
    return df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids`` (doc_id, distinct; null equals null), whatever other columns are called."""
    name = "gone_id"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    gone = ids.select(F.col("doc_id").alias(name))
    return docs.join(F.broadcast(gone) if fits_broadcast(ids, 32) else gone, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of a cheap (materialized) side stay under the broadcast bound."""
    return df.limit(limit // bytes_per_row + 1).count() * bytes_per_row <= limit


def join_bounded(big: DataFrame, small: DataFrame, on, how: str, bytes_per_row: int) -> DataFrame:
    """Join with a broadcast where the small side's size is checked to be bounded, else with a shuffle."""
    return big.join(F.broadcast(small) if fits_broadcast(small, bytes_per_row) else small, on, how)


def join_spread(
    big: DataFrame, small: DataFrame, on: list[str], by: str, bytes_per_row: int, how: str = "left", counts: DataFrame | None = None, total: int | None = None
) -> DataFrame:
    """Join in which a key may have any share of ``big``; ``small`` has one row a key. ``counts`` (the key and n) and ``total`` are those of ``big``, if known.

    It is a broadcast where the small side is checked to be bounded. Else the
    rows of keys that fill more than half of a fair partition are dealt over
    parts by a hash of ``by``, and those keys' rows of ``small`` go to each
    part. There are at most two such keys a partition, so they are few.
    """
    if fits_broadcast(small, bytes_per_row):
        return big.join(F.broadcast(small), on, how)
    total = big.count() if total is None else total
    fair = max(1, total // (2 * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = materialize(counts.where(F.col("n") > fair).select(*on, F.ceil(F.col("n") / fair).cast("int").alias("parts__")), "hot-keys")
    parts = F.coalesce("parts__", F.lit(1))
    dealt = big.join(F.broadcast(hot), on, "left").withColumn("part__", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts__")
    copies = small.join(F.broadcast(hot), on, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts__")
    return dealt.join(copies, [*on, "part__"], how).drop("part__")


def tidy() -> None:
    """Give memory that Arrow and the C library hold back to the system; workers live on and share an executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """``run`` (batches to batches), with ``tidy`` when a task ends."""

    def rows(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return rows


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x.encode() if x is not None else b"" for x in column.to_pylist()]


# --- vectorised words and shingles -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at once; hashing takes some 60 bytes of memory for each.
SEGMENT = 2 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the number of words of each text.

    Long texts are hashed in segments that end at white space, so the memory
    needed beside the hashes is bounded but for words longer than a segment.
    """
    joined = b" ".join([*texts, b""])
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        stop = _BLANK.search(joined, at + SEGMENT)
        end = stop.end() if stop else len(joined)
        h, start = _segment_hashes(joined[at:end])
        hashes.append(h)
        places.append(start + at)
        at = end
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    upto = np.searchsorted(np.concatenate(places), ends)
    return np.concatenate(hashes), np.diff(np.r_[0, upto])


def _segment_hashes(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``part``."""
    raw = _LOWER[np.frombuffer(part, np.uint8)]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(raw)), out=sums[1:])
    return mix64((sums[end] - sums[start]) * _powers(_RINV, len(raw))[start]), start


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; of fewer words the whole sequence; none without words."""
    h, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = h[at : at + n]
        at += n
        if not n:
            out.append(own)
            continue
        k = min(width, n)
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + own[j : n - k + 1 + j])
        out.append(np.unique(acc))
    return out


def grouped(batches, keys: list[str]):
    """Split a stream of Arrow batches sorted by ``keys`` into tables with equal keys each.

    Only the group in work is held; the keys compare as the stream has them.
    """
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches, keys: list[str], rows: int = 2048):
    """Tables of at least about ``rows`` rows of a stream sorted by ``keys``, none of which cuts a group."""
    import pyarrow as pa

    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(k).to_numpy() for k in keys]
        last = np.ones(table.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = table.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
