"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words whose smallest period fits into it three times or more. All
texts of a slice are searched at once, as one sequence of word numbers with a mark of its own between
texts.

Periods 1 to 7 are found by comparing the sequence with itself shifted: these are the regions in
which positions cannot be chosen by hashes, because too many contexts are equal. For periods of each
dyadic scale P to 2P - 1 the context length is t = P / 2. Equal stretches of t words get equal hashes,
except that stretches inside a known run of period t / 3 or less take no part. A position belongs to
the synchronising set if the smallest hash in the t + 1 stretches from it on is the first or the last
one, so it depends on the 2t words after it alone, and any t neighbouring positions hold one unless
all their words are highly periodic. In a run of period p the set is therefore repeated every p words,
and at a position near its start the next equal context of 3P / 2 words (p < 3P / 2) or of 2P words
(p >= 3P / 2) is exactly p words away: a nearer one would, with p, give the stretch a smaller period.
Each pair of such positions proposes a period; proposals that overlap by a period are united,
extended word by word, and kept if the period fits three times and no smaller one gives the same
stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.tokens import slices
from pixelyard.llm.words import Texts, mix64

#: Periods below this are found by shifts; the first dyadic scale begins here.
_SMALL = 8
_OUT = np.iinfo(np.uint64).max


class _Runs:
    """The maximal stretches found so far, by (start, end); the smallest period comes first."""

    def __init__(self):
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= 3 * period:
            self.period.setdefault((start, end), period)

    def table(self) -> np.ndarray:
        return np.array([(a, b, p) for (a, b), p in self.period.items()], np.int64).reshape(-1, 3)


def _shifts(x: np.ndarray, runs: _Runs) -> None:
    for p in range(1, _SMALL):
        if len(x) <= p:
            return
        same = np.zeros(len(x) - p + 2, np.int8)
        same[1:-1] = x[:-p] == x[p:]
        turn = np.diff(same)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = end - begin >= 2 * p
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            runs.add(a, b + p, p)


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers, others different ones."""
    return pd.factorize(first.astype(np.int64) << 32 | second)[0]


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Numbers of stretches of ``2 * step`` words from those of ``step`` words. Stretches that the
    sequence cuts short are numbered apart from one another."""
    second = np.empty(len(names), np.int64)
    second[: len(names) - step] = names[step:]
    second[max(0, len(names) - step) :] = np.arange(min(step, len(names))) + len(names)
    return _names(names, second)


def _synchronising(names: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set for contexts of ``t`` words, ascending."""
    ids = mix64(names.astype(np.uint64) + np.uint64((t * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    ids[periodic] = _OUT
    least, width = ids, 1
    while width < t:  # t is a power of two
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # over t + 1 stretches
    n = len(least)
    return np.flatnonzero((least != _OUT) & ((least == ids[:n]) | (least == ids[t : t + n])))


def _extend(x: np.ndarray, a: int, b: int, p: int, step: int) -> tuple[int, int]:
    """The maximal stretch of period ``p`` around ``[a, b)``."""
    while a > 0:
        low = max(0, a - step)
        other = np.flatnonzero(x[low:a] != x[low + p : a + p])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a = low
    while b < len(x):
        high = min(len(x), b + step)
        other = np.flatnonzero(x[b:high] != x[b - p : high - p])
        if len(other):
            b += int(other[0])
            break
        b = high
    return a, b


def _proposals(at: np.ndarray, contexts: np.ndarray, reach: int, least: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of ``reach`` more words than their period, from neighbouring equal contexts that are
    ``least`` to ``most - 1`` words apart; overlapping ones of a period are united."""
    order = np.argsort(contexts, kind="stable")
    s, c = at[order], contexts[order]
    d = np.diff(s)
    near = (c[1:] == c[:-1]) & (d >= least) & (d < most)
    s, d = s[:-1][near], d[near]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if not len(s):
        return
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + reach))  # else they share a period or more
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    yield from zip(s[first].tolist(), (s[last] + d[last] + reach).tolist(), d[first].tolist(), strict=True)


def find_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of the texts whose word numbers ``x`` holds one after another, ``bounds`` being their
    limits: rows of text, start in the text, length and smallest period, sorted."""
    found = []
    texts = np.flatnonzero(np.diff(bounds) >= 3)
    runs, names, begins, scale = _Runs(), None, None, _SMALL
    while len(texts):
        # Only texts that three periods of this scale fit into; a mark ends each.
        sizes = np.diff(bounds)[texts]
        starts = np.cumsum(sizes + 1) - sizes - 1
        seq = np.empty(int((sizes + 1).sum()), np.int64)
        seq[starts + sizes] = -1 - np.arange(len(texts))
        inside = np.ones(len(seq), bool)
        inside[starts + sizes] = False
        seq[inside] = x[np.repeat(bounds[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        if names is None:
            _shifts(seq, runs)
            names, step = pd.factorize(seq)[0], 1
        else:
            # Carry runs and names over to the shorter sequence.
            keep = np.isin(before, texts)
            old = runs.table()
            which = np.searchsorted(begins, old[:, 0], "right") - 1
            gone = ~keep[which]
            found.append(np.column_stack([before[which[gone]], old[gone, 0] - begins[which[gone]], old[gone, 1] - old[gone, 0], old[gone, 2]]))
            shift = np.zeros(len(before), np.int64)
            shift[keep] = starts - begins[keep]
            runs = _Runs()
            for a, b, p in (old[~gone] + np.column_stack([shift[which[~gone]]] * 2 + [np.zeros(len(which[~gone]), np.int64)])).tolist():
                runs.add(a, b, p)
            names = names[np.repeat(keep, ends - begins + 1)]
        begins, ends, before = starts, starts + sizes, texts
        t = scale // 2
        while step < t:
            names = _doubled(names, step)
            step *= 2
        if (sizes >= 3 * scale).any():
            known = runs.table()
            known = known[(known[:, 2] * 3 <= t) & (known[:, 1] - known[:, 0] >= t)]
            edge = np.zeros(len(seq) + 1, np.int64)
            np.add.at(edge, known[:, 0], 1)
            np.add.at(edge, known[:, 1] - t + 1, -1)
            at = _synchronising(names, t, np.cumsum(edge)[:-1] > 0)
            double = _doubled(names, t)
            wide = at[at + 2 * scale <= len(seq)]
            narrow = at[at + 3 * t <= len(seq)]
            # Contexts of 3P / 2 and of 2P words.
            for a, b, p in [
                *_proposals(narrow, _names(double[narrow], names[narrow + 2 * t]), 3 * t, scale, 3 * t),
                *_proposals(wide, _names(double[wide], double[wide + 2 * t]), 4 * t, 3 * t, 2 * scale),
            ]:
                runs.add(*_extend(seq, a, b, p, scale), p)
        scale *= 2
        texts = texts[sizes >= 3 * scale]
    if names is not None:
        old = runs.table()
        which = np.searchsorted(begins, old[:, 0], "right") - 1
        found.append(np.column_stack([before[which], old[:, 0] - begins[which], old[:, 1] - old[:, 0], old[:, 2]]))
    out = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

#: Which word of a text stands at each place: from its id and its number of words. None: as they are.
Order = Callable[[int | None, int], np.ndarray | None]


def _search(kept: int, least: int, order: Order | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(kept)):
                t = Texts(texts, lower=False)
                words = t.words()
                source = np.arange(len(words))
                if order is not None:
                    for i, (key, n) in enumerate(zip(batch.column(0).slice(first, t.n).to_pylist(), t.counts.tolist(), strict=True)):
                        other = order(key, n) if n else None
                        if other is not None:
                            source[t.first[i] : t.first[i + 1]] = t.first[i] + other
                x = words.dictionary_encode().indices.to_numpy().astype(np.int64)[source] if len(words) else source
                runs = find_runs(x, t.first)
                runs = runs[runs[:, 2] >= least]
                edge = np.zeros(len(words) + 1, np.int64)
                begin = t.first[runs[:, 0]] + runs[:, 1]
                np.add.at(edge, begin + runs[:, 3], 1)
                np.add.at(edge, begin + runs[:, 2], -1)
                stays = np.cumsum(edge)[:-1] == 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=t.n))]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"]))
                edges = np.concatenate([[0], np.cumsum(stays)])[t.first]
                left = pa.LargeListArray.from_arrays(pa.array(edges), words.take(pa.array(source[stays])))
                text = pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.large_string())
                columns = [batch.column(c).slice(first, t.n) for c in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(t.counts, pa.int64()), lists, text.cast(pa.string()) if text.nbytes < 1 << 30 else text], names=[*batch.schema.names[:kept], "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: int = 24, order: Order | None = None) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``n_words``, ``runs`` and ``collapsed`` of each row.

    Words are the stretches of a text without white space, told apart by every byte. ``runs`` are
    all maximal stretches of at least ``least`` words into which their smallest period fits three
    times or more, by start, then period. ``collapsed`` joins by one space the words that no run
    contains after its first period. ``order`` can put a text's words in another order first.

    Each row is judged by itself, with its whole text, in memory of a few dozen bytes a word;
    rows that repeat get equal results. Null or empty texts have no words, no runs and collapse to
    ''. Nothing is shuffled. A column of the input named like a result is left out unless ``keep``
    names it, which is refused. An empty table gives no rows.
    """
    if set(keep) & {"n_words", "runs", "collapsed"}:
        raise ValueError("keep names a column of the result")
    kept = [id_col, *(c for c in keep if c != id_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)) + f", {FOUND}"
    return docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(_search(len(kept), least, order), schema)


def planted(key: int | None, n: int) -> np.ndarray | None:
    """Every tenth text (by its id's checksum) is made periodic from a word on."""
    import zlib

    if key is None:
        return None
    g, rest = divmod(zlib.crc32(str(key).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digests(found: DataFrame) -> DataFrame:
    """The runs of ``collapse_runs`` as their number, the one of the greatest exponent, and checksums."""

    def better(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # length * 1000 over period by whole numbers: both sides stay far below 2 ** 53.
    exponent = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
