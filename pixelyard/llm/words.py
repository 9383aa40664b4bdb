"""Words, hashes and character counts of whole Arrow batches of texts, as numpy arrays."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of bytes that ``Texts.kinds`` counts.
KINDS = ("blank", "lower", "upper", "digit", "stop", "shout", "symbol", "other")


def _kind_table() -> np.ndarray:
    table = np.full(256, KINDS.index("other"), np.uint8)
    for name, chars in {"blank": b" \t\n\x0b\x0c\r", "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:'\"()-?", "shout": b"!", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~"}.items():
        table[list(chars)] = KINDS.index(name)
    return table


_KIND = _kind_table()

#: Bytes of the words ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: ASCII letters and digits, and all of a character beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Texts of one Arrow string array (null: empty). Words are the runs of ``[^\\x20\\x09-\\x0D]``, or of the bytes that ``alphabet`` marks."""

    def __init__(self, texts: pa.Array, lower: bool = True, alphabet: np.ndarray | None = None):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        size = int(bounds[-1] - bounds[0])
        self.raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if size else np.empty(0, np.uint8)
        self.bounds, self.n = bounds - bounds[0], len(texts)
        self.data = self.raw
        if lower:
            self.data = self.raw + ((self.raw >= 65) & (self.raw <= 90)).astype(np.uint8) * np.uint8(32)
        ink = ~((self.raw == 32) | ((self.raw >= 9) & (self.raw <= 13))) if alphabet is None else alphabet[self.raw]
        self.ink = ink
        edge = np.zeros(size + 1, bool)
        edge[self.bounds] = True  # words end with their text
        after_blank = np.concatenate([[True], ~ink]) | edge
        before_blank = np.concatenate([~ink, [True]]) | edge
        self.starts = np.flatnonzero(after_blank[:-1] & ink)
        self.ends = np.flatnonzero(before_blank[1:] & ink) + 1
        #: Index of each text's first word; one more at the end.
        self.first = np.searchsorted(self.starts, self.bounds)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits of each word: a polynomial of its bytes, mixed."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        packed = self.data[self.ink].astype(np.uint64) + np.uint64(1)
        lengths = self.ends - self.starts
        begin = np.cumsum(lengths) - lengths
        power = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        place = np.arange(len(packed)) - np.repeat(begin, lengths)
        return mix64(np.add.reduceat(packed * power[place], begin))

    def words(self) -> pa.Array:
        """All words, one after another."""
        edges = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        packed = self.data[self.ink]
        return pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(packed)])

    def distinct(self) -> tuple[list[str], np.ndarray]:
        """The distinct words, and the number of each word among them."""
        coded = self.words().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()

    def kinds(self) -> np.ndarray:
        """Bytes of each kind in each text: one row per text."""
        which = np.repeat(np.arange(self.n) * len(KINDS), np.diff(self.bounds)) + _KIND[self.raw]
        return np.bincount(which, minlength=self.n * len(KINDS)).reshape(self.n, len(KINDS))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of word values by text."""
        return np.bincount(self.owner, values, self.n)
