"""Benchmark decontamination: documents' token windows against a broadcast set of the items' n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import row_key, without
from pixelyard.llm.items import item_blocks
from pixelyard.llm.tokens import slices
from pixelyard.llm.words import TERM, Texts, mix64

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

FOUND = "n_words bigint, n_hit bigint, spans array<struct<start: bigint, stop: bigint>>, items array<bigint>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Lower-cased words of texts, their text with one space between words, and hashes of word windows."""

    def __init__(self, texts: pa.Array):
        self.t = t = Texts(texts, alphabet=TERM)
        kept, data = t.ink.copy(), t.data.copy()
        inner = np.ones(len(t.starts), bool)
        inner[t.first[:-1][t.counts > 0]] = False
        gap = t.starts[inner] - 1  # the byte before a word that is not its text's first
        kept[gap], data[gap] = True, 32
        place = np.concatenate([[0], np.cumsum(kept)])
        self.joined = data[kept].tobytes()
        self.begin, self.end = place[t.starts], place[t.ends]
        n = len(t.starts)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.hashes * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_BACK, n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``size`` words of one text."""
        n = len(self.t.starts)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        hashes = (self.sums[size:] - self.sums[:-size]) * self.back[: n - size + 1]
        last = self.t.first[1:][self.t.owner[: n - size + 1]]  # where the text's words end
        at = np.flatnonzero(np.arange(n - size + 1) + size <= last)
        return at, mix64(hashes[at])

    def text(self, at: int, size: int) -> bytes:
        return self.joined[self.begin[at] : self.end[at + size - 1]]


class Grams:
    """Distinct windows of a block of items by size: sorted hashes, a bitmap before them, texts, and the items that hold each."""

    def __init__(self, block: list[tuple[int | None, str]], size: int):
        w = Words(pa.array([text for _, text in block], pa.large_string()))
        held: dict[int, dict[bytes, tuple[int, set]]] = {}
        counts = np.minimum(w.t.counts, size)
        for n in np.unique(counts[counts > 0]).tolist():
            at, hashes = w.windows(n)
            owner = w.t.owner[at]
            right = counts[owner] == n  # an item of fewer words is one window, the others have windows of `size` only
            for i, h, o in zip(at[right].tolist(), hashes[right].tolist(), owner[right].tolist(), strict=True):
                held.setdefault(n, {}).setdefault(w.text(i, n), (h, set()))[1].add(block[o][0])
        self.by_size = {}
        for n, grams in held.items():
            order = sorted(grams.items(), key=lambda g: (g[1][0], g[0]))
            hashes = np.array([h for _, (h, _) in order], np.uint64)
            bits = max(10, int(len(hashes) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.by_size[n] = hashes, bits, seen, [text for text, _ in order], [sorted(i for i in ids if i is not None) for _, (_, ids) in order]

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """Verified windows of the texts: first word, size and items."""
        for n, (hashes, bits, seen, texts, ids) in self.by_size.items():
            at, of = w.windows(n)
            maybe = seen[of >> np.uint64(64 - bits)]
            at, of = at[maybe], of[maybe]
            found = np.searchsorted(hashes, of)
            right = hashes[np.minimum(found, len(hashes) - 1)] == of
            for i, h, k in zip(at[right].tolist(), of[right], found[right].tolist(), strict=True):
                while k < len(hashes) and hashes[k] == h:
                    if w.text(i, n) == texts[k]:
                        yield i, n, ids[k]
                        break
                    k += 1


def _find(grams, kept: int, hits_only: bool):
    """Of each row the first ``kept`` columns and what is found in the text after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(kept)):
                w = Words(texts)
                t = w.t
                edge, of_doc = np.zeros(len(t.starts) + 1, np.int64), [set() for _ in range(t.n)]
                for i, n, ids in grams.value.hits(w):
                    edge[i] += 1
                    edge[i + n] -= 1
                    of_doc[t.owner[i]].update(ids)
                hit = np.cumsum(edge)[:-1] > 0
                # A span: neighbouring hit words of one text.
                new = np.ones(len(hit), bool)
                new[1:] = ~hit[:-1] | (t.owner[1:] != t.owner[:-1])
                begins = np.flatnonzero(hit & new)
                stops = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True)) if len(hit) else begins
                owner = t.owner[begins]
                n_hit = np.bincount(t.owner[hit], minlength=t.n)
                offset = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                span = pa.StructArray.from_arrays([pa.array(t.starts[begins] - t.bounds[owner]), pa.array(t.ends[stops] - t.bounds[owner])], names=["start", "stop"])
                spans = pa.ListArray.from_arrays(offset(np.bincount(owner, minlength=t.n)), span)
                ids = pa.ListArray.from_arrays(offset([len(x) for x in of_doc]), pa.array([i for x in of_doc for i in sorted(x)], pa.int64()))
                names = batch.schema.names[:kept]
                columns = [*(batch.column(c).slice(first, t.n) for c in range(kept)), pa.array(t.counts, pa.int64()), pa.array(n_hit, pa.int64()), spans, ids]
                out = pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_hit", "spans", "items"])
                yield out.filter(pa.array(n_hit > 0)) if hits_only else out

    return run


def _merge_spans(kept: int):
    """Unites the spans that several blocks of items gave to a text, and counts its words and hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(kept)):
                t = Texts(texts, alphabet=TERM)
                found = batch.column(kept + 1).slice(first, t.n).to_pylist()
                spans, n_hit = [], []
                for i, lists in enumerate(found):
                    merged: list[list[int]] = []
                    for s in sorted((s["start"], s["stop"]) for x in lists or () for s in x):
                        # Neighbouring words are one span: only bytes that belong to no word are between them.
                        if merged and (s[0] <= merged[-1][1] or not t.ink[t.bounds[i] + merged[-1][1] : t.bounds[i] + s[0]].any()):
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    spans.append([{"start": a, "stop": b} for a, b in merged])
                    n_hit.append(sum(int(np.searchsorted(t.starts, t.bounds[i] + b) - np.searchsorted(t.starts, t.bounds[i] + a)) for a, b in merged))
                columns = [*(batch.column(c).slice(first, t.n) for c in range(kept)), pa.array(t.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), batch.column(kept + 2).slice(first, t.n)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], "n_words", "n_hit", "spans", "items"])

    return run


def scan(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), most_rows: int = 20_000, most_bytes: int = 2 << 20) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``n_words``, ``n_hit``, ``spans`` and ``items`` of each row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is
    ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. A
    document's words inside any occurrence of a window are hit; ``spans`` are maximal stretches of
    them as byte offsets of the UTF-8 text, ``items`` the ids whose windows occur, ascending.

    The distinct windows of the items are broadcast as sorted hashes behind a bitmap. A document's
    windows are looked up in them, and each hit is compared with the window's text. A broadcast
    covers at most about ``most_rows`` items and ``most_bytes`` of their text, by count; larger item
    tables are scanned in blocks, one pass over the documents for each, and only what the passes
    found is shuffled and joined back. Documents are never shuffled where one block is enough.

    Null or empty texts have no words, an item without words no window. An item with a null id
    marks words but is not listed; rows of items that repeat an id are one item. Rows of ``docs`` that
    repeat each get their result, null ids too. Columns of ``docs`` named like a result are replaced
    (or refused in ``keep``). No items: no hits. No documents: no rows.
    """
    if set(keep) & {"n_words", "n_hit", "spans", "items"}:
        raise ValueError("keep names a column of the result")
    spark = docs.sparkSession
    kept = [id_col, *(c for c in keep if c != id_col)]
    fields = lambda names, frame: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (frame.schema[c] for c in names))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    # Only one block is in the driver's memory at a time: a broadcast keeps its value in a file.
    grams = [spark.sparkContext.broadcast(Grams(block, size)) for block in item_blocks(items, item_col, item_text, most_rows, most_bytes)]
    if len(grams) == 1:
        return docs.select(*kept, text).mapInArrow(_find(grams[0], len(kept), False), f"{fields(kept, docs)}, {FOUND}")
    keys = ["__row1", "__row2"]
    keyed = docs.select(*kept, text, *(k.alias(n) for k, n in zip(row_key(F.col(text_col)), keys, strict=True)))
    rows = keyed.select(*keys, "__text")
    parts = [rows.mapInArrow(_find(g, 2, True), f"{fields(keys, rows)}, {FOUND}") for g in grams]
    # Equal texts have one key and equal findings: the first of each block, then all blocks.
    parts = [p.groupBy(*keys).agg(F.first("spans").alias("spans"), F.first("items").alias("items")) for p in parts]
    found = reduce(DataFrame.unionAll, parts).groupBy(*keys).agg(F.collect_list("spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    joined = keyed.join(found, keys, "left").select(*kept, "__text", "__spans", F.coalesce("__items", F.array().cast("array<bigint>")).alias("__items"))
    return joined.mapInArrow(_merge_spans(len(kept)), f"{fields(kept, docs)}, {FOUND}")


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(spans_at)
            touched = np.flatnonzero(np.diff(spans.offsets.to_numpy()))
            texts = batch.column(text_at).to_pylist() if len(touched) else None
            columns = list(batch.columns[:spans_at])
            if texts is not None:
                for i in touched.tolist():
                    data, at, left = texts[i].encode(), 0, []
                    for s in spans[i].as_py():
                        left.append(data[at : s["start"]])
                        at = s["stop"]
                    texts[i] = b"".join([*left, data[at:]]).decode()
                columns[text_at] = pa.array(texts, batch.column(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:spans_at])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what they share with the items.

    ``remove="spans"`` cuts the hit spans out of the texts (a text of nothing else becomes ''),
    ``remove="documents"`` drops rows of which more than ``share`` of the words are hit. Rows
    without hits, null and empty texts are left as they are; columns and names stay the same.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    docs = docs.select(*docs.columns)
    shared = [c for c in docs.columns if c in ("n_words", "n_hit", "spans", "items")]
    aside = {c: f"__kept_{c}" for c in shared}
    inner = without(docs.withColumns({aside[c]: F.col(c) for c in shared}), *shared)
    found = scan(inner, items, id_col=id_col, text_col=text_col, keep=tuple(c for c in inner.columns if c != id_col), **options)
    back = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    if remove == "documents":
        return found.where(F.col("n_hit") <= F.col("n_words") * share).select(*back)
    names = [c for c in inner.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (inner.schema[c] for c in names))
    cut = found.select(*names, "spans").mapInArrow(_cut(names.index(text_col), len(names)), schema)
    return cut.select(*back)


def digests(found: DataFrame) -> DataFrame:
    """The findings of ``scan`` with ids as a digest: n_items, items_sha256 and contaminated."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERY_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_at AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM item_words WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM item_at),
doc_at AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i
  FROM words, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size),
hits AS (
  SELECT doc_id, i, d.size, item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM doc_at) d JOIN grams USING (size, gram)),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
