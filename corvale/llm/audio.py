"""Telephony audio as binary columns: G.711 mu-law and A-law, IMA ADPCM blocks, resampled PCM.

``store`` wraps bytes losslessly as 8-bit mu-law samples of a WAV file,
``describe`` reads the stored files back, expands the samples by lookup table,
decodes ADPCM with numpy over all blocks of a batch at once, resamples to
``rate``, stores that PCM and gives features; ``decode`` gives the resampled PCM itself.

Stored PCM is in a lossless code (``pack_pcm``): between the samples that a
whole ratio of rates repeats from the source, the code holds what differs from
their interpolation, and few distinct sample values are stored as a table and
indices. ``unpack_pcm`` gives the samples back, whatever they are.

Null and empty texts give one block of filling. A text of any length is worked
on whole, at some 40 bytes of memory for each of its own. Equal texts give equal values,
in whatever batch they lie. Repeated rows give a row each, an empty table none;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import materialize, over, small_batches, text_bytes, tidied

MU_LAW, A_LAW, IMA = 7, 6, 0x11
BLOCK, FILL = 576, 255
#: Bytes of blocks that are decoded at once.
PART = 4 << 20

# Fixed values of the IMA ADPCM format: step sizes and index changes.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law code: bits inverted, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law code: even bits inverted, sign, 3 bits of exponent, 4 of mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For state ``16 * index`` plus code: the change of the sample, and the next state."""
    index, code = np.arange(89)[:, None], np.arange(16)[None, :]
    step = IMA_STEPS[index]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (np.clip(index + IMA_INDEX[code], 0, 88) * 16).astype(np.int32).ravel()


_IMA_CHANGE, _IMA_NEXT = _ima_tables()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (rows of bytes): the header's sample, then two of each byte, low half first.

    The steps of a block follow each other, so the loop is over the positions
    and each step is taken in all blocks at once.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for t, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            at = state + code
            sample += _IMA_CHANGE[at]
            np.clip(sample, -32768, 32767, out=sample)
            state = _IMA_NEXT[at]
            out[1 + 2 * t + half] = sample
    return out.T


def resample(pcm: np.ndarray, source: int, target: int, taps: int = 8) -> np.ndarray:
    """Windowed-sinc resampling of 16-bit PCM by the ratio of the rates, one output phase at a time."""
    if source == target or not len(pcm):
        return pcm
    g = int(np.gcd(source, target))
    up, down = target // g, source // g
    cutoff = min(1.0, up / down)
    half = int(np.ceil(taps / cutoff))
    n_out = len(pcm) * up // down
    padded = np.concatenate([np.zeros(half, np.float32), pcm.astype(np.float32), np.zeros(half + 1, np.float32)])
    out = np.empty(n_out, np.float32)
    for phase in range(up):
        where = np.arange(phase, n_out, up, dtype=np.int64) * down
        whole, rest = where // up, (phase * down % up) / up
        x = np.arange(-half + 1, half + 1) - rest
        kernel = cutoff * np.sinc(cutoff * x) * (0.5 + 0.5 * np.cos(np.pi * x / (half + 1)))
        kernel = (kernel / kernel.sum()).astype(np.float32)
        if np.count_nonzero(np.abs(kernel) > 1e-7) == 1:
            out[phase::up] = padded[whole + half]
            continue
        acc = np.zeros(len(where), np.float32)
        step = down if up == 1 or len(where) < 2 else int(whole[1] - whole[0])
        for k, weight in enumerate(kernel):
            first = int(whole[0]) + k + 1 if len(whole) else 0
            acc += weight * padded[first : first + step * len(where) : step][: len(where)]
        out[phase::up] = acc
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def pack_pcm(pcm: np.ndarray, up: int = 1) -> bytes:
    """A lossless code of 16-bit PCM at ``up`` times the rate of its source: kind, ratio, length; every ``up``-th sample; what the others differ by from the interpolation of those."""
    base = np.ascontiguousarray(pcm[::up])
    guess = resample(base, 1, up)[: len(pcm)]
    rest = pcm - np.pad(guess, (0, len(pcm) - len(guess)))  # modulo 2**16
    rest[::up] = 0
    some = bool(rest.any())
    # indices into the distinct values, found by marking them: sorting would cost more
    seen = np.zeros(1 << 16, bool)
    seen[base.view(np.uint16)] = True
    values = np.flatnonzero(seen).astype("<u2")
    head = struct.pack("<BBIH", (len(values) <= 256) + 2 * some, up, len(pcm), len(values) if len(values) <= 256 else 0)
    if len(values) <= 256:
        place = np.zeros(1 << 16, np.uint8)
        place[values] = np.arange(len(values))
        body = values.tobytes() + place[base.view(np.uint16)].tobytes()
    else:
        body = base.astype("<i2").tobytes()
    return head + body + (rest.astype("<i2").tobytes() if some else b"")


def unpack_pcm(raw: bytes) -> np.ndarray:
    """The samples that ``pack_pcm`` was given."""
    kind, up, n, values = struct.unpack_from("<BBIH", raw)
    at, size = struct.calcsize("<BBIH"), -(-n // up)
    if kind & 1:
        table = np.frombuffer(raw, "<u2", values, at)
        base = table[np.frombuffer(raw, np.uint8, size, at + 2 * values)].view(np.int16)
        at += 2 * values + size
    else:
        base = np.frombuffer(raw, "<i2", size, at)
        at += 2 * size
    guess = resample(base, 1, up)[:n]
    out = np.pad(guess, (0, n - len(guess)))
    out[::up] = base
    return out + np.frombuffer(raw, "<i2", n, at) if kind & 2 else out


def to_wav(data: bytes, rate: int = 8000, codec: int = MU_LAW, block: int = 1) -> bytes:
    """A mono WAV file of ``data``: 8-bit samples, or 4-bit ADPCM in blocks of ``block`` bytes."""
    bits, samples = (4, len(data) // block * (1 + 2 * (block - 4))) if codec == IMA else (8, len(data))
    per_second = rate * block // (1 + 2 * (block - 4)) if codec == IMA else rate
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_second, block, bits) + (struct.pack("<HH", 2, 1 + 2 * (block - 4)) if codec == IMA else struct.pack("<H", 0))
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(raw: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, bytes of a block and data of a mono WAV file; ValueError if it is none."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", raw, at + 8)
        if name == b"data" and fmt:
            if fmt[1] != 1:
                raise ValueError("more than one channel")
            return fmt[0], fmt[2], fmt[4], raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def pcm_of(codec: int, data: bytes, block: int) -> np.ndarray:
    """16-bit PCM of mu-law, A-law or ADPCM data."""
    a = np.frombuffer(data, np.uint8)
    if codec == IMA:
        return ima_decode(a[: len(a) // block * block].reshape(-1, block)).ravel()
    return {MU_LAW: MU_TABLE, A_LAW: A_TABLE}[codec][a]


def store(docs: DataFrame, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes and media (the WAV file) of the text bytes of ``docs``, filled up to whole blocks; written and read back."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = text_bytes(batch.column(1))
            media = [to_wav(r + bytes([FILL]) * (-len(r) % BLOCK if r else BLOCK), rate) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(small_batches(docs, 256).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, media binary"), "media", level=9)


def decode(media: DataFrame, rate: int = 16000) -> DataFrame:
    """All columns of ``media`` and ``pcm``: little-endian 16-bit PCM at ``rate`` of each file; null for a null or damaged file."""
    at = media.columns.index("media")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for raw in batch.column(at).to_pylist():
                try:
                    codec, own, block, data = from_wav(raw or b"")
                    out.append(resample(pcm_of(codec, data, block), own, rate).astype("<i2").tobytes())
                except (ValueError, KeyError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "pcm"])

    return small_batches(media, 64).mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + ", pcm binary")


def _energy(pcm: np.ndarray) -> int:
    wide = pcm.astype(np.int64)
    return int(np.dot(wide, wide))


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame, rate: int = 16000, coded: bool = False) -> DataFrame:
    """Digests and features of stored files, from their bytes alone.

    ``feature`` has the energy of the samples as mu-law and as A-law, the sign
    changes, the energy of the data's blocks as ADPCM and the CRC of the PCM
    resampled to ``rate``, which is written as little-endian 16-bit samples, or
    if ``coded`` in its lossless code, and read back (and expanded) for it.
    """

    def block_energies(datas: list[bytes]) -> list[int]:
        """ADPCM energy of each, decoded over the blocks of many files at once."""
        blocks = np.frombuffer(b"".join(datas), np.uint8).reshape(-1, BLOCK)
        size = PART // BLOCK
        sums = [np.einsum("bt,bt->b", w := ima_decode(blocks[i : i + size]).astype(np.float64), w) for i in range(0, len(blocks), size)]
        upto = np.r_[0, np.cumsum(np.concatenate(sums).astype(np.int64))]
        ends = np.cumsum([len(d) // BLOCK for d in datas])
        return np.diff(upto[np.r_[0, ends]]).tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, sizes, raws = (c.to_pylist() for c in batch.columns)
            if not raws:
                continue
            files = [from_wav(r) for r in raws]
            energies = block_energies([f[3] for f in files])
            cols: list[list] = [[] for _ in range(7)]
            for raw, (_, own, _, data), ima in zip(raws, files, energies, strict=True):
                a = np.frombuffer(data, np.uint8)
                pcm = MU_TABLE[a]
                flips = int(np.count_nonzero((a[1:] ^ a[:-1]) & 128))
                heard = resample(pcm, own, rate)
                heard = pack_pcm(heard, rate // own if rate % own == 0 else 1) if coded else heard.astype("<i2").tobytes()
                feature = f"mu={_energy(pcm)};a={_energy(A_TABLE[a])};flips={flips};ima={ima}"
                for c, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, heard), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5]), pa.array(cols[6], pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
            )

    described = small_batches(media, 64).select("doc_id", "n_bytes", "media").mapInArrow(rows, DESCRIBED + ", pcm binary")
    @tidied
    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [f"{f};pcm{rate}={zlib.crc32(unpack_pcm(p).astype('<i2').tobytes() if coded else p):08x}" for f, p in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(marks, pa.string())], batch.schema.names[:8])

    stored = over(materialize(described, "pcm", 16 << 20, level=9), media.sparkSession)
    return stored.mapInArrow(heard, DESCRIBED)
