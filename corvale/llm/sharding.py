"""Sharding by vector bin packing.

Rows with equal texts form a group. Bytes, words (runs between white space, and
single characters of scripts without spaces) and rows of a unit are its
demand, as shares of one shard's fair capacity; units are placed from the
largest on, each where the dot product of its demand with the shards' residual
capacity is highest, of the shards whose bytes have room for it; if none has,
where most bytes are left. At the end parts of cut groups even out the bytes
of shards that hold the same group. Equal demands are placed in the order of their hashes, and
of shards with equal dot products the first one takes the unit.

A group stays whole unless it is above a whole shard (one text may hold a third
of all rows); then it is cut into as few pieces as fit, whole shards and what is
left. Units are bounded in number: groups above ``1 / fine`` of a shard are units of their own (there are
at most ``3 * fine * shards``), and all smaller groups are hashed into
``fine * shards`` units, so the greedy placement costs the same at any size.
Rows of a large group are counted and numbered in parts of about
``1 / PARTS`` of a shard, so no task holds a group. Counting, hashing and
numbering stay in Spark; no text of any length is held but in its row.

Null texts count as no bytes and form one group; repeated rows count once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvale.llm.common import materialize

#: Words and rows mostly grow with the bytes, so they need a light hand; bytes weigh most, as the law is near equal bytes.
WEIGHTS = (6.0, 1.0, 1.0)
#: Share of a shard's bytes that it may take above its fair part.
SLACK = 0.005
#: Parts that a whole shard of one group's rows is counted and numbered in.
PARTS = 64
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: A token: a run between white space of any kind, or one character of a script written without spaces.
TOKEN = rf"[{_UNSPACED}]|[^\s\p{{Z}}\x85{_UNSPACED}]++"


def place(demand: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """Shard of each unit (rows of ``demand``: its share of one shard's capacity in each dimension)."""
    out = np.zeros(len(demand), np.int64)
    residual = np.ones((shards, demand.shape[1]))
    w = np.asarray(weights)
    for i in np.lexsort((np.arange(len(demand)), -demand[:, 0], -(demand * w).sum(1))):
        room = residual[:, 0] + SLACK >= demand[i, 0]
        at = int(np.argmax(np.where(room, residual @ (demand[i] * w), -np.inf) if room.any() else residual[:, 0]))
        out[i] = at
        residual[at] -= demand[i]
    return out


def pieces(loads: list[float]) -> list[int]:
    """Deal the parts of a group above a whole shard to pieces that fill one each, the last one less: the largest part first, to the first piece with room."""
    held: list[float] = []
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        at = next((k for k, h in enumerate(held) if h + loads[i] <= 1 + 1e-9), len(held))
        if at == len(held):
            held.append(0.0)
        held[at] += loads[i]
        out[i] = at
    return out


def evened(where: np.ndarray, size: np.ndarray, group: np.ndarray, shards: int) -> np.ndarray:
    """Shards of the parts (``group``: which cut group a part is of, or -1) after parts of cut groups went over from fuller to emptier shards that hold the same group already.

    No group gets more pieces by it. The fullest shard gives, else the emptiest
    takes, what brings the two nearest together; it ends when neither can.
    """
    where = where.copy()
    load = np.bincount(where, size, shards)
    cut = group >= 0
    for _ in range(8 * int(cut.sum())):
        full, empty = int(load.argmax()), int(load.argmin())
        best = None
        for one, other in ((full, None), (None, empty)):
            here = np.flatnonzero(cut & (where == (full if one is not None else empty)))
            for g in np.unique(group[here]).tolist():
                holders = np.unique(where[group == g])
                a = full if one is not None else int(holders[load[holders].argmax()])
                b = empty if one is None else int(holders[load[holders].argmin()])
                gap = load[a] - load[b]
                parts = np.flatnonzero((group == g) & (where == a) & (size < gap))
                if len(parts) > 0 and np.count_nonzero((group == g) & (where == a)) > 1:
                    i = int(parts[np.abs(size[parts] - gap / 2).argmin()])
                    gain = min(size[i], gap - size[i])
                    if best is None or gain > best[0]:
                        best = gain, i, a, b
            if best:
                break
        if best is None or best[0] < 1e-3 * load.mean():
            break
        _, i, a, b = best
        where[i] = b
        load[a] -= size[i]
        load[b] += size[i]
    return where


def shard(docs: DataFrame, shards: int = 40, row_bytes: int = 16, fine: int = 256) -> DataFrame:
    """Put ``docs`` (doc_id, text) into ``shards`` shards of near equal bytes."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("size"),
            F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long").alias("words"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), F.monotonically_increasing_id().alias("rid"),
        ),
        "sizes",
    )
    sums = (F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(*sums).first()
    fair = [max(total[x] or 0, 1) / shards for x in ("size", "words", "n")]
    load = F.greatest(*(F.col(x) / F.lit(f) for x, f in zip(("size", "words", "n"), fair, strict=True)))
    heavy = rows.groupBy("k1", "k2").agg(*sums).withColumn("load", load).where(F.col("load") > 1.0 / fine)
    heavy = materialize(heavy.select("k1", "k2", F.ceil(F.col("load") * PARTS).cast("int").alias("parts")), "heavy")
    light = F.pmod(F.col("k1"), F.lit(fine * shards))
    # both broadcasts are bounded by the parameters: each dimension has at most fine * shards groups above 1 / fine of a shard
    rows = rows.join(F.broadcast(heavy), ["k1", "k2"], "left").select(
        "doc_id", "size", "words", "text_crc32", "rid",
        F.when(F.col("parts").isNull(), F.struct(light.alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("c")))
        .otherwise(F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"), F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("c"))).alias("unit"),
    )
    counted = sorted(map(tuple, rows.groupBy("unit").agg(*sums).select("unit.*", "size", "words", "n").collect()))
    demand = np.array([u[3:] for u in counted], float).reshape(-1, 3) / fair
    # parts of a group are one unit again, or one for each piece of a group above a whole shard
    groups: dict[tuple, list[int]] = {}
    for i, u in enumerate(counted):
        groups.setdefault(u[:2] if u[2] >= 0 else u[:3], []).append(i)
    units: dict[tuple, list[int]] = {}
    for key, own in groups.items():
        whole = demand[own].sum(0)
        piece = pieces((demand[own][:, whole.argmax()]).tolist()) if whole.max() > 1 else [0] * len(own)
        for i, p in zip(own, piece, strict=True):
            units.setdefault((*key, p), []).append(i)
    chosen = place(np.array([demand[own].sum(0) for own in units.values()]).reshape(-1, 3), shards).tolist()
    where, group = np.zeros(len(counted), np.int64), np.full(len(counted), -1)
    names: dict[tuple, int] = {}
    for (key, own), s in zip(units.items(), chosen, strict=True):
        where[own] = s
        if (*key[:-1], 1) in units:  # a cut group has more than one piece
            group[own] = names.setdefault(key[:-1], len(names))
    where = evened(where, demand[:, 0], group, shards)
    filled, plan = [0] * shards, []
    for u, s in zip(counted, where.tolist(), strict=True):
        plan.append((u[:3], s, filled[s]))
        filled[s] += u[5]
    table = spark.createDataFrame(plan, "unit struct<a: bigint, b: bigint, c: int>, shard int, before long")
    met = rows.join(F.broadcast(table), "unit")
    number = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "rid"))
    return met.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
