"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``window`` bytes, once in each
direction, labels every position, and a document's probabilities are the mean
over all its positions. It is trained here in numpy by backpropagation through
time on a bounded sample of labelled rows (``per_lang`` crops for each label,
chosen by a hash of doc_id), with fixed seeds, so a run is repeatable.

Null texts and texts without a letter are ``und`` with score 0. With no
labelled rows all documents are ``und``. Of labels with equal pooled sums the
first by name wins. A text of any length is read in blocks of windows, so only
the text itself is held. Repeated rows get equal results, an empty table gives
no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.llm.common import settled, small_batches, tidied

UNDETERMINED = "und"
#: A letter, as in the choice of the rows to learn from; numbers such as a half or a square are none.
_LETTER = regex.compile(r"\p{L}")
_PAD = 0


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == 0


def sample(docs: DataFrame, per_lang: int, chars: int, most_langs: int = 500) -> list[tuple[str, str]]:
    """At most ``per_lang`` crops of ``chars`` characters for each label, from rows that aren't held out: the first by a hash of doc_id.

    Labels are learnt if they are among the ``most_langs`` with the most rows
    (ties by name), so a column of dirty labels stays bounded on the driver.

    Of a label with many rows only those below a hash that about four times as
    many stay under are looked at, so the ranking never meets all rows of one.
    """
    space = 1 << 40
    h = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("lang", F.col("lang").cast("string"))
    counts = [(r["lang"], min(space, space * 4 * per_lang // r["n"])) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()]
    if not counts:
        return []
    below = docs.sparkSession.createDataFrame(counts, "lang string, below long")
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    near = usable.select("doc_id", "lang", "text", h.alias("h")).join(F.broadcast(below), "lang").where("h < below").where(F.col("text").rlike(r"\p{L}"))
    first = near.select("doc_id", "lang", "h", F.substring(F.col("text"), start.cast("int"), F.lit(chars)).alias("crop"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "crop")
    top = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    return sorted((r["lang"], r["crop"]) for r in top.collect())


class Network:
    """Weights of both directions; ``hidden`` units each."""

    def __init__(self, labels: list[str], hidden: int, window: int, seed: int = 7):
        g, n, k = np.random.default_rng(seed), hidden, len(labels)
        self.labels, self.hidden, self.window = labels, hidden, window
        self.w = {f"x{d}": g.normal(0, 0.3, (256, 3 * n)) for d in "fb"} | {f"u{d}": g.normal(0, 1 / np.sqrt(n), (n, 3 * n)) for d in "fb"}
        self.w |= {"o": g.normal(0, 1 / np.sqrt(2 * n), (2 * n, k)), "c": np.zeros(k)}
        self.w = {name: v.astype(np.float32) for name, v in self.w.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states at each position of ``x`` (positions, batch), read in direction ``d``."""
        n, wx, u = self.hidden, self.w[f"x{d}"], self.w[f"u{d}"]
        h = np.zeros((x.shape[1], n), np.float32)
        states, tape = np.empty((len(x), x.shape[1], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, a = wx[x[t]], h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * n] + a[:, : 2 * n])))
            z, r = zr[:, :n], zr[:, n:]
            m = np.tanh(g[:, 2 * n :] + r * a[:, 2 * n :])
            if keep:
                tape.append((t, h, z, r, m, a[:, 2 * n :]))
            h = m + z * (h - m)
            states[t] = h
        return states, tape

    def _back(self, x: np.ndarray, d: str, tape: list, dstates: np.ndarray, grads: dict) -> None:
        n, u = self.hidden, self.w[f"u{d}"]
        dx, du, dh = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros(dstates.shape[1:], np.float32)
        for t, h, z, r, m, a in reversed(tape):
            dh = dh + dstates[t]
            dz, dm = dh * (h - m) * z * (1 - z), dh * (1 - z) * (1 - m * m)
            dr = dm * a * r * (1 - r)
            gate = np.concatenate([dz, dr, dm], 1)
            np.add.at(dx, x[t], gate)
            inner = np.concatenate([dz, dr, dm * r], 1)
            du += h.T @ inner
            dh = dh * z + inner @ u.T
        grads[f"x{d}"], grads[f"u{d}"] = dx, du

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the mean cross-entropy of all positions; x: (windows, positions) bytes."""
        g = np.random.default_rng(seed)
        mean, var = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        n = self.hidden
        for step in range(1, steps + 1):
            pick = g.integers(0, len(x), batch)
            xt, yt = x[pick].T, y[pick]
            fwd, tf = self._run(xt, "f", True)
            bwd, tb = self._run(xt, "b", True)
            both = np.concatenate([fwd, bwd], 2)
            p = both @ self.w["o"] + self.w["c"]
            p = np.exp(p - p.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            real = (xt != _PAD)[..., None]
            p[:, np.arange(batch), yt] -= 1
            p = (p * real / max(real.sum(), 1)).astype(np.float32)
            grads = {"o": np.einsum("tbn,tbk->nk", both, p), "c": p.sum((0, 1))}
            back = p @ self.w["o"].T
            self._back(xt, "f", tf, back[..., :n], grads)
            self._back(xt, "b", tb, back[..., n:], grads)
            scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((v * v).sum()) for v in grads.values()))))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in grads.items():
                v = v * scale
                mean[k] = 0.9 * mean[k] + 0.1 * v
                var[k] = 0.99 * var[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over the real positions of each window (rows of ``x``) of the label probabilities.

        The same recurrence as in training, with units as rows so that gates are contiguous, in place.
        """
        n, k, batch = self.hidden, len(self.labels), len(x)
        index = np.ascontiguousarray(x.T).astype(np.intp)
        logits = np.empty((len(index), k, batch), np.float32)
        logits[:] = self.w["c"][:, None]
        g, a, zr = (np.empty((r * n, batch), np.float32) for r in (3, 3, 2))
        for d, out in (("f", self.w["o"][:n].T.copy()), ("b", self.w["o"][n:].T.copy())):
            wx, u, h = self.w[f"x{d}"].T.copy(), self.w[f"u{d}"].T.copy(), np.zeros((n, batch), np.float32)
            for t in range(len(index)) if d == "f" else range(len(index) - 1, -1, -1):
                np.take(wx, index[t], axis=1, out=g, mode="clip")
                np.dot(u, h, out=a)
                np.add(g[: 2 * n], a[: 2 * n], out=zr)
                zr *= 0.5  # the logistic function is 0.5 + 0.5 tanh(x / 2)
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                m = a[2 * n :]
                m *= zr[n:]
                m += g[2 * n :]
                np.tanh(m, out=m)
                h -= m
                h *= zr[:n]
                h += m
                logits[t] += out @ h
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits *= ((index != _PAD)[:, None, :] / np.maximum(logits.sum(1, keepdims=True), 1e-30)).astype(np.float32)
        return logits.sum(0, dtype=np.float64).T


def windows(raw: bytes, size: int) -> np.ndarray:
    """All bytes of a text as rows of ``size``, the last one padded; byte 0, which is the padding, becomes 32."""
    a = np.frombuffer(raw, np.uint8)
    out = np.full(-(-len(a) // size) * size, _PAD, np.uint8)
    out[: len(a)] = np.where(a == _PAD, 32, a)
    return out.reshape(-1, size)


def fit(docs: DataFrame, per_lang: int = 300, chars: int = 600, most_langs: int = 500, hidden: int = 8, window: int = 64, steps: int = 500) -> Network | None:
    """Train on a sample of at most ``per_lang`` rows for each label; None without labelled rows."""
    rows = sample(docs, per_lang, chars, most_langs)
    labels = sorted({lang for lang, _ in rows})
    if not rows:
        return None
    xs, ys = [], []
    for lang, crop in rows:
        own = windows(crop.encode(), window)
        xs.append(own)
        ys += [labels.index(lang)] * len(own)
    x, y = np.concatenate(xs), np.array(ys)
    counts = np.bincount(y, minlength=len(labels))
    pick = np.concatenate([np.resize(np.flatnonzero(y == k), counts.max()) for k in range(len(labels))])  # labels weigh alike
    net = Network(labels, hidden, window)
    net.train(x[pick], y[pick], steps)
    return net


def predict_batch(net: Network | None, texts: list[str | None], block: int = 2048) -> tuple[list[str], list[float]]:
    """Label and pooled probability of each text; all bytes are read, in blocks of windows."""
    labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if net is None:
        return labels, scores
    held, owner, waiting = [], [], 0
    sums = np.zeros((len(texts), len(net.labels)))

    def flush() -> None:
        nonlocal held, owner, waiting
        if held:
            x, who = np.concatenate(held), np.concatenate(owner)
            for lo in range(0, len(x), block):
                np.add.at(sums, who[lo : lo + block], net.position_sums(x[lo : lo + block]))
        held, owner, waiting = [], [], 0

    for i, text in enumerate(texts):
        if text is None or not _LETTER.search(text):
            continue
        own = windows(text.encode(), net.window)
        held.append(own)
        owner.append(np.full(len(own), i))
        waiting += len(own)
        if waiting >= block:
            flush()
    flush()
    total = sums.sum(1)
    for i in np.flatnonzero(total > 0).tolist():
        best = int(sums[i].argmax())
        labels[i], scores[i] = net.labels[best], float(sums[i, best] / total[i])
    return labels, scores


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the pooled probability of that label) of every text."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_batch(net, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **params) -> DataFrame:
    """Fit on the rows that aren't held out and label all: doc_id, held_out, lang_pred, score."""
    net = fit(docs, **params)
    return settled(predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"), docs.sparkSession, "languages")


def keep_identified(docs: DataFrame, least: float = 0.5, **params) -> DataFrame:
    """The rows of ``docs`` with a language of at least ``least`` pooled probability, all columns as they were.

    Without any labelled row there is no model to tell languages apart, and all rows whose text has a letter stay.
    The rows pass through the labelling as they are, so ids that repeat or are null can't be confused.
    """
    net = fit(docs, **params)
    at = docs.columns.index("text")

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if net is None:
                yield batch.filter(pa.array([t is not None and _LETTER.search(t) is not None for t in texts], pa.bool_()))
                continue
            names, scores = predict_batch(net, texts)
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)]))

    return small_batches(docs).mapInArrow(rows, docs.schema)
