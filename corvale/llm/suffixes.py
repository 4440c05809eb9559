"""Removal of repeated passages by a distributed difference-cover suffix sort.

A byte goes if a ``length``-byte string that covers it also starts in a
document with a smaller doc_id. The order of all suffixes is never needed
beyond that depth, and most suffixes share it with none, so the sort is made
in these steps:

1. *Sampled tuples.* Positions whose offset in their document lies in a
   difference cover modulo ``PERIOD`` are sampled. For any two equal strings
   some shift below ``PERIOD`` makes both positions sampled ones, so the tuples
   of ``length - PERIOD + 1`` bytes there are equal too. Sampled tuples are
   sorted by their names (hashes) in buckets over all documents; suffixes all
   of whose sampled tuples are unique are discarded.
2. *Recursion and merge.* The suffixes left go, as runs of text, to the bucket
   of the smallest hash in their prefix, which equal prefixes share. There the
   runs' suffix array is built: triples at positions 1 and 2 modulo 3 are
   sorted and named, the names are sorted by recursion, the remaining suffixes
   are merged in.
3. *Adjacent prefixes.* Neighbours in the array with equal ``length``-byte
   prefixes form a class; the smallest doc_id of a class keeps its bytes.

All texts are whole and as UTF-8; matches never cross documents. Null texts
are empty. Rows without a doc_id have no smaller and no larger id: they keep
their text and take none. Repeated rows (equal doc_id) take nothing from each
other. An empty table gives no rows; other columns are ignored by ``digests``, kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import mix64, settled, tidied
from corvale.llm.exchange import MESSAGE, answer, expand, packed, receive, rest_of, send, squeeze, texts_of, total_bytes

#: A perfect difference set: each difference modulo PERIOD occurs once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of the grams whose smallest hash routes a suffix.
GRAM = 16
#: Bytes of text for each bucket of sampled tuples, and of suffixes.
SAMPLE_BYTES, SUFFIX_BYTES = 8 << 20, 2 << 20
#: No byte of UTF-8.
BREAK = b"\xff"


def _words(data: bytes, n: int, offset: int) -> np.ndarray:
    """The 8 bytes from each position on, as unsigned integers (a view)."""
    return np.ndarray((n,), "<u8", data, offset, (1,))


def _offsets(width: int) -> list[int]:
    return [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]


def gram_hash(data: bytes, at: np.ndarray | slice, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (8 or more) from each position; ``data`` must go on 8 bytes behind the last."""
    n = len(data) - width
    h: np.ndarray | int = np.uint64(width)
    for o in _offsets(width):
        h = (h ^ _words(data, n, o)[at]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


# --- sets of numbers in few bits ---------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct numbers: 16 low bits each, the rest as a bitmap of steps."""
    high = (values >> np.uint64(16)).astype(np.int64)
    bits = np.zeros(len(values) + (int(high[-1]) if len(high) else 0) + 1, np.uint8)
    bits[high + np.arange(len(values))] = 1
    return squeeze((values & np.uint64(0xFFFF)).astype("<u2"), np.packbits(bits))


def unpack_sorted(raw: bytes) -> np.ndarray:
    low, bits = expand(raw)
    where = np.flatnonzero(np.unpackbits(bits))[: len(low)]
    return ((where - np.arange(len(low))).astype(np.uint64) << np.uint64(16)) | low


# --- suffix array ------------------------------------------------------------------


def _joint(parts: list[np.ndarray], limits: list[int]) -> list[np.ndarray]:
    """For tuples given as equal lists of columns: one number for each, in the order of the tuples.

    ``parts`` are columns; each column is a list of arrays (one per group) that
    are numbered together, so the numbers of the groups compare.
    """
    size = 1
    for limit in limits:
        size *= limit
    if size < 1 << 62:
        out = []
        for group in zip(*parts, strict=True):
            key = np.zeros(len(group[0]), np.int64)
            for col, limit in zip(group, limits, strict=True):
                key = key * limit + col
            out.append(key)
        return out
    lens = [len(g) for g in parts[0]]
    cols = [np.concatenate(p) for p in parts]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), np.int64)
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new)
    return np.split(key, np.cumsum(lens)[:-1])


def suffix_array(s: np.ndarray, limit: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` (numbers from 1 to ``limit - 1``) in their order, by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    small = np.int32 if max(n + 3, limit) < 1 << 31 else np.int64
    t = np.concatenate([s.astype(small, copy=False), np.zeros(3, small)])
    extra = 1 if n % 3 == 1 else 0  # so that the names of positions 1 modulo 3 end with one for the empty suffix
    sampled = np.concatenate([np.arange(1, n + extra, 3, dtype=small), np.arange(2, n, 3, dtype=small)])
    (key,) = _joint([[t[sampled]], [t[sampled + 1]], [t[sampled + 2]]], [limit] * 3)
    order = np.argsort(key).astype(small, copy=False)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    names = np.empty(len(order), small)
    names[order] = np.cumsum(new, dtype=small)
    del new
    most = int(names[order[-1]])
    if most < len(order):
        del order
        order = suffix_array(names, most + 1)
    del names
    ranks = np.zeros(n + 3, small)
    ranks[sampled[order]] = np.arange(1, len(order) + 1, dtype=small)
    top = len(order) + 1
    rest = np.arange(0, n, 3, dtype=small)
    in_order = sampled[order]
    del order, sampled
    in_order = in_order[in_order < n]
    is_one = in_order % 3 == 1
    ones, twos = in_order[is_one], in_order[~is_one]
    rest_key, ones_key = _joint([[t[rest], t[ones]], [ranks[rest + 1], ranks[ones + 1]]], [limit, top])
    by = np.argsort(rest_key)
    rest, rest_key = rest[by], rest_key[by]
    rest_two, twos_key = _joint([[t[rest], t[twos]], [t[rest + 1], t[twos + 1]], [ranks[rest + 2], ranks[twos + 2]]], [limit, limit, top])
    place = np.arange(len(rest)) + np.searchsorted(ones_key, rest_key) + np.searchsorted(twos_key, rest_two)
    del rest_key, ones_key, rest_two, twos_key
    out = np.empty(n, small)
    others = np.ones(n, bool)
    others[place] = False
    out[place] = rest
    out[others] = in_order
    return out


def equal_prefixes(runs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of the ``length`` bytes from each start in each run (runs one after the other), and how many starts each run has."""
    joined = BREAK.join(runs) + BREAK + bytes(8)
    text = np.frombuffer(joined, np.uint8)[:-8]
    sizes = np.array([len(r) for r in runs], np.int64)
    counts = sizes - length + 1
    first = np.cumsum(sizes + 1) - sizes - 1
    starts = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    small = np.int32 if len(text) < 1 << 31 else np.int64
    number = np.full(len(text), -1, small)
    number[starts] = np.arange(len(starts), dtype=small)
    del starts
    order = suffix_array(text.astype(np.int16) + np.int16(1), 257)
    order = order[number[order] >= 0]
    differs = np.zeros(len(order), bool)
    differs[0] = True
    for o in _offsets(length):
        w = _words(joined, len(joined) - 8, 0)[order + o]
        differs[1:] |= w[1:] != w[:-1]
    classes = np.empty(len(order), small)
    classes[number[order]] = np.cumsum(differs, dtype=small) - small(1)
    return classes, counts


# --- the steps over chunks ---------------------------------------------------------


class _Chunk:
    """A chunk's texts one after the other, and its sampled tuples."""

    def __init__(self, ids: list[int | None], texts: list[bytes], length: int, bits: int):
        self.ids, self.length = ids, length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = b"".join(texts) + bytes(length + 8)
        width = length - PERIOD + 1
        most = int(self.sizes.max(initial=0))
        pattern = (np.arange(0, most + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        usable = [i is not None and n >= length for i, n in zip(ids, self.sizes.tolist(), strict=True)]
        counts = np.where(usable, np.searchsorted(pattern, self.sizes - width, "right"), 0)
        small = np.int32 if len(self.data) < 1 << 31 else np.int64
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        pattern = pattern.astype(small)
        self.at = np.concatenate([np.zeros(0, small), *(pattern[:c] + small(f) for f, c in zip(self.first.tolist(), counts.tolist(), strict=True) if c)])
        h = np.concatenate([np.zeros(0, np.uint64), *(gram_hash(self.data, self.at[i : i + (1 << 18)], width) for i in range(0, len(self.at), 1 << 18))])
        h >>= np.uint64(64 - bits)
        order = np.argsort(h).astype(np.int32 if len(h) < 1 << 31 else np.int64)
        ranked = h[order]
        del h
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.names = ranked[heads]
        del ranked
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1
        who = self.owner[order]
        self.shared = np.minimum.reduceat(who, heads) != np.maximum.reduceat(who, heads) if len(who) else np.zeros(0, bool)

    def left(self, repeated: np.ndarray) -> np.ndarray:
        """For each byte whether the string from it on holds a repeated sampled tuple in its first positions."""
        hits = self.at[repeated[self.place]]
        owner = self.owner[repeated[self.place]]
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, np.maximum(hits - PERIOD + 1, self.first[owner]), 1)
        np.add.at(step, np.minimum(hits, self.first[owner] + self.sizes[owner] - self.length) + 1, -1)
        np.cumsum(step, out=step)
        return step[:-1] > 0


def _routes(c: _Chunk, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that are left and share the smallest gram hash of their prefix: hash, document, first start, number."""
    at = np.flatnonzero(left)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    edge = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]]
    low = np.empty(len(at), np.uint64)
    span, k = c.length - GRAM + 1, 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        h = gram_hash(c.data[a : b + c.length + 8], slice(0, b - a + span), GRAM)
        w = 1
        while 2 * w <= span:
            h = np.minimum(h[: len(h) - w], h[w:])
            w *= 2
        low[k : k + b - a + 1] = np.minimum(h[: b - a + 1], h[span - w : span - w + b - a + 1])
        k += b - a + 1
    doc = np.searchsorted(c.first, at, "right") - 1
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (np.diff(at) > 1) | (doc[1:] != doc[:-1])])
    heads = np.flatnonzero(new)
    return low[heads], doc[heads], at[heads], np.diff(np.r_[heads, len(at)])


def _repeats(rows: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    """For the runs of one bucket: to each chunk, for stretches of starts in its runs, the least doc_id that has the strings there.

    A chunk sends each of its runs once, with the least and the greatest of its
    doc_ids that have it, so a passage costs a bucket one entry for each chunk
    it lies in; which of its documents lose bytes is the chunk's own business.
    """
    index: dict[bytes, int] = {}
    runs, lows, highs = [], [], []
    for _, message in rows:
        sizes, text, low, high = expand(message)
        raw, ends = text.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
        runs.append(np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
        lows.append(low)
        highs.append(high)
    least = np.full(len(index), np.iinfo(np.int64).max)
    for own, low in zip(runs, lows, strict=True):
        np.minimum.at(least, own, low)
    classes, counts = equal_prefixes(list(index), length)
    first = np.cumsum(counts) - counts
    lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, classes, np.repeat(least, counts))
    here = lowest[classes]
    del classes, lowest
    for (chunk, _), own, high in zip(rows, runs, highs, strict=True):
        n = counts[own]
        upto = np.cumsum(n)
        inner = np.arange(upto[-1]) - np.repeat(upto - n, n)
        own_least = here[np.repeat(first[own], n) + inner]
        hit = np.flatnonzero(own_least < np.repeat(high, n))
        if not len(hit):
            continue
        run, at, low = np.repeat(np.arange(len(own)), n)[hit], inner[hit], own_least[hit]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(run) > 0) | (np.diff(low) != 0)]))
        tails = np.r_[heads[1:] - 1, len(hit) - 1]
        yield chunk, squeeze(run[heads].astype("<u4"), at[heads].astype("<u4"), at[tails].astype("<u4"), low[heads].astype("<i8"))


def _own_places(chunk: int, places: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, int, bytes]:
    """A chunk's message to itself: where its runs lie, by bucket. It travels under a number of its own, so it meets no other."""
    deltas = [np.diff(start, prepend=0) for _, _, start in places]
    parts = np.array([p for p, _, _ in places], "<u4")
    return chunk, -1 - chunk, squeeze(parts, np.array([len(d) for d in deltas], "<u4"), np.concatenate([r for _, r, _ in places]).astype("<u4"), np.concatenate(deltas).astype("<i4"))


def _spans(answers: list[dict] | None, ids: list[int | None], texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each document of a chunk its maximal removed spans."""
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    got = {a["bucket"]: a["message"] for a in answers or []}
    mine = [m for b, m in got.items() if b < 0]
    if len(got) < 2 or not mine:
        return out
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    parts, n_places, runs, deltas = expand(mine[0])
    found, at = [], 0
    for part, n in zip(parts.tolist(), n_places.tolist(), strict=True):
        if part in got:
            run, start = runs[at : at + n].astype(np.int64), np.cumsum(deltas[at : at + n].astype(np.int64))
            doc = np.searchsorted(first, start, "right") - 1
            of, low, high, least = (x.astype(np.int64) for x in expand(got[part]))
            a, b = np.searchsorted(of, run, "left"), np.searchsorted(of, run, "right")
            k = b - a
            o = np.repeat(np.arange(n), k)
            s = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(k.sum())
            goes = least[s] < numbers[doc[o]]
            o, s = o[goes], s[goes]
            begin = start[o] - first[doc[o]]
            found.append((doc[o], begin + low[s], begin + high[s] + length))
        at += n
    if not found:
        return out
    doc, start, end = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((start, doc))
    for d, a, b in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        own = out[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], b))
        else:
            own.append((a, b))
    return out


def removed(docs: DataFrame, length: int = 50, carry: bool = False) -> DataFrame:
    """Rows (chunk, blob, rest if carried, answers) of the texts of ``docs`` with the strings that go; see ``digests`` and ``deduplicated``."""
    if length < PERIOD + 8 or length < GRAM:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    chunks = packed(docs, carry=carry)
    total = total_bytes(chunks)
    bits = min(60, max(24, int(max(1, total * len(COVER) // PERIOD)).bit_length() + 10))  # names collide for one in about a thousand
    buckets, parts = max(1, -(-total // SAMPLE_BYTES)), max(1, -(-total // SUFFIX_BYTES))
    span = -(-(1 << bits) // buckets)

    def cuts(names: np.ndarray) -> np.ndarray:
        return np.searchsorted(names, np.minimum(np.arange(buckets + 1) * span, (1 << bits)).astype(np.uint64))

    def say(ids: list[int | None], texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        c = _Chunk(ids, texts, length, bits)
        at = cuts(c.names)
        for b in range(buckets):
            if at[b] < at[b + 1]:
                yield b, pack_sorted(c.names[at[b] : at[b + 1]] - np.uint64(b * span))

    def named(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        sets = [unpack_sorted(m) for _, m in rows]
        every = np.concatenate(sets)
        every.sort()
        again = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        for (chunk, _), own in zip(rows, sets, strict=True):
            at = np.minimum(np.searchsorted(again, own), max(len(again) - 1, 0))
            yield chunk, squeeze(np.packbits(again[at] == own if len(again) else np.zeros(len(own), bool)))

    @tidied
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = texts_of(blob)
                c = _Chunk(ids, texts, length, bits)
                at = cuts(c.names)
                repeated = c.shared.copy()
                for a in answers or []:
                    b = a["bucket"]
                    repeated[at[b] : at[b + 1]] |= np.unpackbits(expand(a["message"])[0])[: at[b + 1] - at[b]].astype(bool)
                low, doc, start, n = _routes(c, c.left(repeated))
                if not len(low):
                    continue
                numbers = np.array([0 if i is None else i for i in ids], np.int64)
                part = (low >> np.uint64(8)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(np.r_[-1, part[order].astype(np.int64), -1]))
                rows, places = [], []
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own = order[x:y]
                    index: dict[bytes, int] = {}
                    run = np.array([index.setdefault(c.data[a : a + k + length - 1], len(index)) for a, k in zip(start[own].tolist(), n[own].tolist(), strict=True)], np.int64)
                    who = numbers[doc[own]]
                    least, most = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
                    np.minimum.at(least, run, who)
                    np.maximum.at(most, run, who)
                    number = int(part[own[0]])
                    rows.append((chunk, number, squeeze(np.array([len(r) for r in index], "<u4"), np.frombuffer(b"".join(index), np.uint8), least.astype("<i8"), most.astype("<i8"))))
                    places.append((number, run, start[own]))
                rows.append(_own_places(chunk, places))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "message"])

    routed = receive(chunks.select("chunk", "blob", "n_bytes"), answer(send(chunks, say), buckets, named)).mapInArrow(route, MESSAGE)
    return receive(chunks, answer(routed, parts, lambda bucket, rows: iter(rows) if bucket < 0 else _repeats(rows, length)))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the remaining bytes."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, answers in zip(batch.column("blob").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                ids, texts = texts_of(blob)
                spans = _spans(answers, ids, texts, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                        pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return settled(removed(docs, length).mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), docs.sparkSession, "digests")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with all its columns, the repeated strings cut out of ``text``, and ``n_chars`` (if there) counted anew.

    A character that loses a byte goes whole; texts of which nothing but white space is left go.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    schema = docs.schema

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, raw, answers in zip(*(batch.column(c).to_pylist() for c in ("blob", "rest", "answers")), strict=True):
                ids, texts = texts_of(blob)
                rest = rest_of(raw)
                spans = _spans(answers, ids, texts, length)
                kept = [None if null else _kept(t, s).decode(errors="ignore") for t, s, null in zip(texts, spans, rest.column(0).to_pylist(), strict=True)]
                cols = dict(zip(others, rest.columns[1:], strict=True)) | {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(kept, pa.string())}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(k) if s else n for k, s, n in zip(kept, spans, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
                stays = pa.array([not s or bool(k.strip()) for k, s in zip(kept, spans, strict=True)])
                for part in pa.table([cols[c] for c in names], names=names).filter(stays).combine_chunks().to_batches():
                    yield part

    plain = [F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in names]
    types = ", ".join(f"`{c}` " + {"doc_id": "bigint", "text": "string"}.get(c, schema[c].dataType.simpleString()) for c in names)
    return removed(docs, length, carry=True).mapInArrow(rows, types).select(*plain)
