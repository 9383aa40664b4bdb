"""Byte-level BPE ids of whole Arrow batches: each distinct stretch of text is encoded once."""

from __future__ import annotations

import ctypes
import itertools
import os

import numpy as np
import pyarrow as pa


def _cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions before which the pre-tokenizer always starts a new token.

    Its pattern lets no token reach from a character that is not white space over a following
    space, a lone line feed between such characters is a token of its own, and a run of letters
    ends before a comma or full stop. Only characters that are certainly not white space count:
    ASCII 33-126, two-byte letters from U+00C0 on, and for what follows also lead bytes of blocks
    without white space. A missed cut only makes a stretch longer.
    """
    if len(data) < 3:
        return np.empty(0, np.int64)
    ink = (data > 32) & (data < 127)
    lead2 = (data >= 0xC3) & (data <= 0xDF)
    before = ink.copy()
    before[1:] |= (data[1:] >= 0x80) & lead2[:-1]
    after = ink | ((data >= 0xC3) & (data != 0xE1) & (data != 0xE2) & (data != 0xE3))
    middle = before[:-2] & after[2:]
    space = np.flatnonzero(middle & (data[1:-1] == 32)) + 1
    feed = np.flatnonzero(middle & (data[1:-1] == 10)) + 1
    letter = ((data[:-1] | 32) >= 97) & ((data[:-1] | 32) <= 122) & (data[:-1] < 128)
    stop = np.flatnonzero(letter & ((data[1:] == 44) | (data[1:] == 46))) + 1
    return np.concatenate([space, feed, feed + 1, stop])


def _with_room(table: np.ndarray, used: int, size: int) -> np.ndarray:
    """The table, or one at least twice as long with its first ``used`` values."""
    if size <= len(table):
        return table
    wider = np.empty(max(size, 2 * len(table)), table.dtype)
    wider[:used] = table[:used]
    return wider


class BatchEncoder:
    """``encode(array)`` gives the ids of all texts one after another, and where each text begins.

    The vocabulary is a file in the format of the ``tokenizers`` library. Distinct stretches of at most
    ``longest`` characters are remembered between batches, until they take about ``memo`` bytes;
    longer ones and further ones are encoded anew for each slice. An encoder belongs to one task.
    """

    #: What a remembered stretch takes beside its characters and ids: a string, two numbers, a slot of a table.
    _ENTRY = 200

    def __init__(self, path: str, memo: int = 64 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.longest = Tokenizer.from_file(path), memo, longest
        self.known: dict[str, int] = {}
        self.held = 0
        # A table of ids that grows in place; a slice's other stretches stand behind the remembered ones.
        self.ids, self.starts = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _look_up(self, distinct: list[str]) -> np.ndarray:
        """Rows of the distinct stretches in the table, until the next call."""
        rows = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0).tolist()
        if not new:
            return rows
        if self.held < self.memo:
            new.sort(key=lambda i: len(distinct[i]) > self.longest)
        fresh = [distinct[i] for i in new]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        first, at = len(self.known), int(self.starts[len(self.known)])
        self.ids = _with_room(self.ids, at, at + int(lengths.sum()))
        self.starts = _with_room(self.starts, first + 1, first + 1 + len(fresh))
        self.ids[at : at + int(lengths.sum())] = np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(lengths.sum()))
        self.starts[first + 1 : first + 1 + len(fresh)] = at + np.cumsum(lengths)
        rows[new] = np.arange(first, first + len(fresh))
        for row, text, n in zip(range(first, first + len(fresh)), fresh, lengths.tolist(), strict=True):
            if len(text) > self.longest or self.held >= self.memo:
                break
            self.known[text] = row
            self.held += self._ENTRY + 4 * len(text) + 4 * n
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(bounds[-1] - bounds[0])
        if not size:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        begins = np.zeros(size + 1, bool)
        begins[bounds] = True
        begins[_cuts(data)] = True
        edges = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        rows = self._look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, starts = self.ids, self.starts
        first, lengths = starts[rows], starts[rows + 1] - starts[rows]
        ends = np.cumsum(lengths)
        at = np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1])
        return ids[at], np.concatenate([[0], ends])[np.searchsorted(edges, bounds)]


def slices(texts: pa.Array, budget: int = 1 << 20):
    """Zero-copy slices of about ``budget`` bytes of text (one text may be longer), with their first row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, int(bounds[start]) + budget, "right")) - 1)
        yield start, texts.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Spark keeps the Python worker for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
