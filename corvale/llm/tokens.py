"""Token ids of whole texts with a public tokenizer file, by a cache of words."""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[tuple[str, int], WordEncoder] = {}

#: Parts a worker keeps; 100,000 take about 30 MB.
CACHE = 300_000

#: A part that is one run of Latin letters, hence one pre-token.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
#: Text that ends in a Latin letter or digit, then ASCII punctuation but no apostrophe: a pre-token begins between them.
_STEM = re.compile(rb"([^<]*?(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:;=>?@\[-`{-~]+)\Z", re.S)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class WordEncoder:
    """Encode texts with a lower-casing byte-level tokenizer whose pre-tokens never contain white space.

    Then the ids of a text are the ids of its parts between ASCII white space
    in order, so each distinct part is encoded once and later looked up. The
    cache is cleared at ``most`` parts, which bounds a worker's memory.
    """

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: what all special pieces begin with; they are matched in the text as it is, so their case counts
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix([re.split("[A-Za-z]", t)[0] for t in special])
        self.has_special = bool(special)
        self.clear()

    def clear(self) -> None:
        #: part -> its number; a part is one entry of the pool or two (a stem, then punctuation)
        self.index: dict[bytes, int] = {}
        self.first, self.second = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.starts, self.lens = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, n: int, ids: int) -> None:
        while n > len(self.lens):
            for name in ("first", "second", "starts", "lens"):
                setattr(self, name, np.r_[getattr(self, name), np.zeros(len(getattr(self, name)), np.int32)])
        while self.used + ids > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]

    def _single(self, parts: list[bytes]) -> None:
        """Give each part an entry with its own ids."""
        easy = [p for p in parts if _LETTERS.match(p)]  # one pre-token each: the model alone gives the ids
        model = self.tokenizer.model.tokenize
        ids = [[t.id for t in model(p.decode() if p.isascii() else p.decode().lower().encode().decode("latin-1").translate(_BYTE_CHARS))] for p in easy]
        if len(easy) < len(parts):
            hard = list(set(parts).difference(easy))
            for lo in range(0, len(hard), 20_000):
                encoded = self.tokenizer.encode_batch_fast([x.decode() for x in hard[lo : lo + 20_000]], add_special_tokens=False)
                ids += [e.ids for e in encoded]
            easy += hard
        n, lens = len(self.index), np.fromiter(map(len, ids), np.int64, len(ids))
        total, upto = int(lens.sum()), np.cumsum(lens)
        self._room(n + len(ids), total)
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        own = slice(n, n + len(ids))
        self.lens[own], self.starts[own] = lens, self.used + upto - lens
        self.first[own], self.second[own] = np.arange(n, n + len(ids)), -1
        self.used += total
        self.index.update(zip(easy, range(n, n + len(ids)), strict=True))

    def _add(self, parts: list[bytes]) -> None:
        """Number the distinct parts, none of which is known."""
        single, joined = [], []
        for p in parts:
            m = _STEM.match(p)
            if m:
                joined.append((p, m[1], m[2]))
            else:
                single.append(p)
        known = self.index
        single += [x for j in joined for x in j[1:] if x not in known]
        self._single(list(dict.fromkeys(single)))
        if joined:
            n = len(known)
            self._room(n + len(joined), 0)
            own = slice(n, n + len(joined))
            self.first[own] = [known[j[1]] for j in joined]
            self.second[own] = [known[j[2]] for j in joined]
            known.update(zip((j[0] for j in joined), range(n, n + len(joined)), strict=True))

    def encode(self, texts: pa.Array | list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, ``end_id`` after each text (null: empty), and how many each text has."""
        column = pa.array([t.decode() for t in texts]) if isinstance(texts, list) else texts
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pc.fill_null(column.cast(pa.string()), "")
        lowered = pc.ascii_lower(column)
        if self.has_special:  # words of texts that may hold a special piece keep their case
            lowered = pc.if_else(pc.match_substring(column, self.special), column, lowered)
        parts = pc.ascii_split_whitespace(lowered)
        upto_words = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.index) > self.most:
            self.clear()
        number = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new = [words[i] for i in lost.tolist()]
            self._add(new)
            number[lost] = np.fromiter(map(self.index.__getitem__, new), np.int32, len(new))
        at = number[coded.indices.to_numpy()]
        second = self.second[at]
        entries = np.stack([self.first[at], second], 1).ravel()
        entries = entries[entries >= 0]
        lens = self.lens[entries]
        upto = np.cumsum(lens)
        shift = (self.starts[entries] - (upto - lens)).astype(np.int32)  # a batch has fewer than 2**31 ids
        ids = self.pool[np.repeat(shift, lens) + np.arange(upto[-1], dtype=np.int32)]
        # a text's ids go up to the last entry of its last word (each text has a word, if an empty one)
        ends = upto[upto_words - 1 + np.cumsum(second >= 0)[upto_words - 1]]
        out = np.empty(len(ids) + len(ends), np.uint32)
        final = ends + np.arange(len(ends))
        inner = np.ones(len(out), bool)
        inner[final] = False
        out[inner], out[final] = ids, end_id
        return out, np.diff(np.r_[-1, final])


def encoder(path: str, most: int = CACHE) -> WordEncoder:
    """The worker's encoder for this file and size of cache; loaded once in a process."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = WordEncoder(path, most)
    return _ENCODERS[path, most]


def gathered(batches, rows_bytes: int = 8 << 20):
    """Arrow batches joined to about ``rows_bytes`` each: repeated words are then looked up once for many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= rows_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (last := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield last.to_batches()[0]
