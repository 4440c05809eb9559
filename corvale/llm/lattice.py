"""Document likelihood by a lattice of subword segmentations.

The pieces of an existing vocabulary file get unigram scores from the training
documents: each distinct word, segmented by that vocabulary, counts with its
frequency, plus one. A word's marginal probability is the sum over all its
segmentations, by the forward recursion in log space over bytes (the file's
byte pieces make every text reachable); pieces never hold a space but as their
first byte, so a document's marginal is the product of its words' marginals
and of the end's. Each distinct word is scored once in the whole corpus.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null texts are empty and
have the end alone. A row counts as held out by its doc_id (null: as empty
text). Repeated rows count and are scored each. With no training rows all
counts are 0. Equal texts have equal scores, wherever they lie; a text of any
length is scored whole, word by word. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import grouped, materialize, settled, tidied, word_hashes
from corvale.llm.exchange import BUCKET_BYTES, answer, expand, meet, messages, packed, receive, send, squeeze, texts_of, total_bytes

SPACE_MARK = "▁"
#: Words above this many bytes are scored one by one.
LONG_WORD = 64
LN10 = math.log(10)
_MODELS: dict[str, object] = {}


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def piece_bytes(path: str) -> list[bytes | None]:
    """The bytes each piece stands for, a space for the mark; None for control pieces and those with an inner space."""
    sp, out = model(path), []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        raw = bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
        out.append(None if sp.is_control(i) or sp.is_unknown(i) or b" " in raw[1:] else raw)
    return out


class Lattice:
    """Log-probabilities of pieces, and word marginals by the forward recursion."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        raws = list(scores)
        h = np.array([_hash(r) for r in raws], np.uint64)
        order = np.argsort(h)
        self.keys, self.values = h[order], np.array([scores[raws[i]] for i in order])

    def word(self, raw: bytes) -> float:
        """Marginal of one word of any length."""
        table, most, alpha = self.scores, self.longest, [0.0]
        for i in range(1, len(raw) + 1):
            terms = [alpha[j] + s for j in range(max(0, i - most), i) if (s := table.get(raw[j:i])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha[-1]

    def words(self, raws: list[bytes]) -> np.ndarray:
        """Marginals of many words, those of equal length in step."""
        out = np.empty(len(raws))
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            if len(r) > LONG_WORD:
                out[i] = self.word(r)
            else:
                by_length.setdefault(len(r), []).append(i)
        out[by_length.pop(0, [])] = 0.0
        for n, own in by_length.items():
            for lo in range(0, len(own), 20_000):
                part = own[lo : lo + 20_000]
                out[part] = self._same_length(np.frombuffer(b"".join(raws[i] for i in part), np.uint8).reshape(-1, n))
        return out

    def _same_length(self, m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        sums = np.zeros((n + 1, len(m)), np.uint64)
        for i in range(n):
            sums[i + 1] = sums[i] * _BASE + (m[:, i].astype(np.uint64) + np.uint64(1))
        alpha = np.full((n + 1, len(m)), -np.inf)
        alpha[0] = 0.0
        last = len(self.keys) - 1
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                h = sums[i] - sums[j] * _POWER[i - j]
                at = np.minimum(np.searchsorted(self.keys, h), last)
                hit = np.flatnonzero(self.keys[at] == h)
                if len(hit):
                    alpha[i, hit] = np.logaddexp(alpha[i, hit], alpha[j, hit] + self.values[at[hit]])
        return alpha[n]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(LONG_WORD + 1, _BASE)])


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in order of their first place, the number of each word of all texts, and how many words each text has."""
    words: list[bytes] = []
    counts = []
    for t in texts:
        own = t.lower().split()
        counts.append(len(own))
        words += own
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return list(index), np.fromiter(map(index.__getitem__, words), np.int64, len(words)), np.array(counts, np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's own values (``counts`` of them), so that it depends on nothing but that text."""
    out = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def _bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return (word_hashes([b" ".join(words)])[0] >> np.uint64(20)) % np.uint64(buckets) if words else np.zeros(0, np.uint64)


def _by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = _bucket_of(words, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _totals(rows: list[tuple[int, bytes]]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket's messages, their training counts, and the numbers of each message's words."""
    index: dict[bytes, int] = {}
    places, counts = [], []
    for _, m in rows:
        raw, c = expand(m)
        words = raw.tobytes().split(b" ")
        places.append(np.array([index.setdefault(w, len(index)) for w in words], np.int64))
        counts.append(c)
    total = np.zeros(len(index), np.int64)
    for p, c in zip(places, counts, strict=True):
        total[p] += c
    return list(index), total, places


def score(docs: DataFrame, vocabulary: str, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the marginal probability)."""
    spark = docs.sparkSession
    chunks = packed(docs)
    buckets = max(1, -(-total_bytes(chunks) // BUCKET_BYTES))

    def say(ids: list[int | None], texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        words, at, counts = _distinct(texts)
        trains = np.array([not held_out(i, folds, fold) for i in ids], bool)
        seen = np.bincount(at[np.repeat(trains, counts)], minlength=len(words)).astype("<u4")
        for k, own in _by_bucket(words, buckets):
            yield k, squeeze(np.frombuffer(b" ".join([words[i] for i in own.tolist()]), np.uint8), seen[own])

    @tidied
    def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of pieces in the training words of each bucket; at -1 all words, at -2 the distinct ones."""
        sp = model(vocabulary)
        for own in grouped(batches, ["bucket"]):
            words, total, _ = _totals(messages(own))
            sums = np.zeros(sp.get_piece_size(), np.int64)
            known = np.flatnonzero(total)
            for lo in range(0, len(known), 50_000):
                part = known[lo : lo + 50_000]
                cut = sp.encode([words[i].decode() for i in part.tolist()], num_threads=1)
                sums += np.bincount(np.fromiter(chain.from_iterable(cut), np.int64), np.repeat(total[part], [len(c) for c in cut]), len(sums)).astype(np.int64)
            ids = np.r_[-1, -2, np.flatnonzero(sums)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.r_[total.sum(), len(known), sums[ids[2:]]])], ["piece", "n"])

    sent = materialize(send(chunks, say), "words")
    rows = meet(sent, buckets).mapInArrow(piece_counts, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row per piece of the vocabulary file
    counts = {r["piece"]: r["n"] for r in rows}
    fold_of = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))
    ends = docs.select("doc_id").where(fold_of != fold).count()
    train_tokens, distinct = counts.pop(-1, 0) + ends, counts.pop(-2, 0) + (1 if ends else 0)
    raws = piece_bytes(vocabulary)
    usable = [i for i, r in enumerate(raws) if r is not None]
    mass = sum(counts.get(i, 0) + 1 for i in usable) + ends + 1
    scores: dict[bytes, float] = {}
    for i in usable:  # a byte may be a piece by itself and a byte piece: both lead to it
        own = math.log((counts.get(i, 0) + 1) / mass)
        scores[raws[i]] = float(np.logaddexp(scores[raws[i]], own)) if raws[i] in scores else own
    end_score = math.log((ends + 1) / mass)
    pieces = spark.sparkContext.broadcast(scores)  # as long as the vocabulary file

    def reply(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        words, total, places = _totals(rows)
        marginals = Lattice(pieces.value).words([b" " + w for w in words])
        for (chunk, _), own in zip(rows, places, strict=True):
            yield chunk, squeeze(total[own], marginals[own])

    @tidied
    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = train_tokens + distinct + 1
        base_end = math.log10((ends + 1) / floor)
        for batch in batches:
            for blob, answers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, texts = texts_of(blob)
                words, at, n = _distinct(texts)
                total, marginal = np.zeros(len(words), np.int64), np.zeros(len(words))
                got = {a["bucket"]: a["message"] for a in answers or []}
                for k, own in _by_bucket(words, buckets):
                    total[own], marginal[own] = expand(got[k])
                part = [_sums(v[at], n) for v in (np.log10((total + 1) / floor), marginal, (total > 0).astype(float))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([held_out(i, folds, fold) for i in ids]), pa.array(n + 1), pa.array(np.rint(part[2]).astype(np.int64) + (1 if ends else 0)),
                        pa.array(np.full(len(ids), train_tokens)), pa.array(part[0] + base_end), pa.array((part[1] + end_score) / LN10),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    met = receive(chunks, answer(sent, buckets, reply))
    return settled(met.mapInArrow(results, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), spark, "scores")
