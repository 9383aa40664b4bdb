"""Ranked lexical search: tiles of the items' term weights times tiles of documents' term impacts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch
from pixelyard.llm.items import item_blocks
from pixelyard.llm.tokens import slices
from pixelyard.llm.words import TERM, Texts

_SCALE, _SATURATION, _SLOPE, _PERCENT = 1_000_000_000, 1_000, 8, 75
#: An impact is below this: scale * tf / (saturation * tf + ...).
_MOST_IMPACT = _SCALE // _SATURATION
#: Sums of products of float64 whole numbers are exact up to here.
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max


def _item_terms(block: list[tuple[int | None, str]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The block's vocabulary; and for each (term, item) that occurs, sorted, its numbers and its repeats."""
    t = Texts(pa.array([text for _, text in block], pa.large_string()), alphabet=TERM)
    coded = t.words().dictionary_encode()
    cells, repeats = np.unique(coded.indices.to_numpy().astype(np.int64) * len(block) + t.owner, return_counts=True)
    term, item = np.divmod(cells, len(block))
    return coded.dictionary, term, item, repeats


_POSTINGS = "id bigint, n bigint, terms array<int>, counts array<int>"


def _postings(vocabulary):
    """Of each document its number of terms, and which terms of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                t = Texts(texts, alphabet=TERM)
                coded = t.words().dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[coded.indices.to_numpy()] if len(number) else np.empty(0, np.int64)
                cells, counts = np.unique(t.owner[term >= 0] * len(known) + term[term >= 0], return_counts=True)
                doc, term = np.divmod(cells, max(1, len(known)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, t.n), pa.array(t.counts, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return run


def lengths_in_millis(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's length against the average one: 25 + (75 * n * documents) div terms."""
    if _PERCENT * int(n.max(initial=0)) * documents < 1 << 63:
        return 100 - _PERCENT + (_PERCENT * documents * n) // terms
    return np.array([100 - _PERCENT + (_PERCENT * int(x) * documents) // terms for x in n], np.int64)


class Queries:
    """Weights of a block of items by term, in columns cut so that no partial sum can reach 2 ** 53."""

    def __init__(self, ids: list[int | None], term: np.ndarray, item: np.ndarray, weight: np.ndarray, terms: int, columns: int):
        self.ids, self.terms, self.columns = ids, terms, columns
        limit = (_EXACT - 1) // _MOST_IMPACT
        total = np.zeros(len(ids))
        np.add.at(total, item, weight.astype(float))
        if total.max(initial=0) * _MOST_IMPACT >= 2.0**63:
            raise ValueError("an item's scores can leave 64 bits")
        # A weight beyond the limit is given in several layers of the same term.
        self.layers = []
        while True:
            self.layers.append((np.searchsorted(term, np.arange(terms + 1)), item, np.minimum(weight, limit).astype(float)))
            over = weight > limit
            if not over.any():
                break
            term, item, weight = term[over], item[over], weight[over] - limit
        self.limit = limit

    def tiles(self, present: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the terms ``present`` (ascending) which of them a tile covers, and the tile: terms by items."""
        for begins, item, weight in self.layers:
            sizes = begins[present + 1] - begins[present]
            at = np.repeat(begins[present] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(present)), sizes)
            most = np.zeros(len(present))
            np.maximum.at(most, row, weight[at])
            start = 0
            while start < len(present):
                stop = start + max(1, int(np.searchsorted(np.cumsum(most[start : start + self.columns]), self.limit, "right")))
                stop = min(stop, start + self.columns, len(present))
                inside = slice(*np.searchsorted(row, [start, stop]))
                tile = np.zeros((stop - start, len(self.ids)))
                tile[row[inside] - start, item[at[inside]]] = weight[at[inside]]
                yield np.arange(start, stop), tile
                start = stop


class Best:
    """The ``k`` best documents of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, null, id
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """A tile of documents by items. All that tie with the last of the best are looked at."""
        least = self.least
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, 0)[-self.k])
        doc, item = np.nonzero(scores >= least)
        self.new.append([item, scores[doc, item], null[doc], ids[doc]])
        self.waiting += len(doc)
        if self.waiting > 200_000:
            self.settle()

    def settle(self) -> None:
        rows = [np.concatenate(c) for c in zip(self.rows, *self.new, strict=True)]
        item, score, null, ids = rows
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.rows, self.new, self.waiting = [c[order] for c in rows], [], 0
        full, last = np.unique(self.rows[0][place[place < self.k] == self.k - 1], return_index=True)
        self.least[full] = self.rows[1][np.flatnonzero(place[place < self.k] == self.k - 1)[last]]


_RANKED = "number bigint, item_id bigint, doc_id bigint, score bigint"


def _rank(queries, documents: int, terms: int, k: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = Best(len(q.ids), k)
        for batch in batches:
            for a in range(0, batch.num_rows, tile):
                part = batch.slice(a, tile)
                lists = part.column(2)
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                m = lengths_in_millis(part.column(1).to_numpy(), documents, terms)
                impact = (_SCALE * tf) // (_SATURATION * tf + _SLOPE * m[doc])
                present, column = np.unique(term, return_inverse=True)
                order = np.argsort(column, kind="stable")
                doc, column, impact = doc[order], column[order], impact[order]
                scores = np.zeros((part.num_rows, len(q.ids)), np.int64)
                for covered, weights in q.tiles(present):
                    inside = slice(*np.searchsorted(column, [covered[0], covered[-1] + 1]))
                    dense = np.zeros((part.num_rows, len(covered)))
                    dense[doc[inside], column[inside] - covered[0]] = impact[inside]
                    scores += (dense @ weights).astype(np.int64)  # whole numbers below 2 ** 53: exact
                ids = part.column(0)
                best.add(scores, ids.fill_null(_LAST).to_numpy(), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64))
        best.settle()
        item, score, null, ids = best.rows
        names = pa.array(q.ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, mask=null > 0), pa.array(score)], names=["number", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_rows: int = 512, most_bytes: int = 1 << 20, columns: int = 2048, tile: int = 1024) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case; weights,
    impacts and scores are whole numbers (a saturating term frequency against the document's
    length, times ``floor(1000 * ln((2N + 2) / (2df + 1)))``), so ties are real ties and go to the
    smaller ``doc_id``.

    Documents are read once for each block of at most about ``most_rows`` items and ``most_bytes``
    of their text: their counts of the block's terms are written to the shared folder, document
    frequencies are added up from there, and tasks multiply tiles of ``tile`` documents by
    at most ``columns`` terms with tiles of those terms by the block's items, in float64. Tiles end before a partial
    sum could reach 2 ** 53. Only a block's terms and weights are broadcast; larger tables of items
    take more passes. A task keeps ``k`` rows an item, and these meet in two steps.

    Null or empty texts have no terms: such documents count nowhere, such items rank nothing. Ids
    must be whole numbers; documents with a null id come last among ties, and rows that repeat
    are ranked each. Rows of items that repeat id and text are one item; two texts of one id are
    ranked each by itself. Other columns play no part. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = []
    for number, block in enumerate(item_blocks(items, item_col, item_text, most_rows, most_bytes)):
        vocabulary, term, item, repeats = _item_terms(block)
        if not len(vocabulary):
            continue
        words = spark.sparkContext.broadcast(vocabulary)
        postings = scratch.write("postings", texts.mapInArrow(_postings(words), _POSTINGS))
        documents, terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        # One row for each term of the block, whose size is bounded.
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            df[r["term"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        queries = spark.sparkContext.broadcast(Queries([i for i, _ in block], term, item, weight[term] * repeats, len(vocabulary), columns))
        ranked = postings.where(F.size("terms") > 0).mapInArrow(_rank(queries, documents, terms, k, tile), _RANKED)
        parts.append(ranked.withColumn("block", F.lit(number)))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionAll, parts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("block", "number", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "number").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


QUERY_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_terms AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, corpus WHERE term IN (SELECT term FROM item_terms) GROUP BY term, n_docs),
impacts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(part * repeats) AS BIGINT) AS score FROM impacts JOIN item_terms USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
