"""Quality classifier: a generalised additive model with pairwise interactions over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.boosting import AdditiveModel
from pixelyard.llm.labelled import held_out, training_rows
from pixelyard.llm.tokens import slices
from pixelyard.llm.words import KINDS, Texts

FEATURES = ["words", "word_length", "long_words", "upper", "digit", "stop", "shout", "symbol", "other", "blank", "lines", "line_words", "distinct_words", "adjacent_repeats", "top_word", "repeated_lines", "capital_words", "symbol_words", "pair_repeats"]


def _repeats(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and how often the commonest occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
    runs = np.diff(np.concatenate([begin, [len(o)]]))
    top = np.zeros(n)
    np.maximum.at(top, o[begin], runs)
    return np.bincount(o[begin], minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    t = Texts(texts)
    kinds = t.kinds()
    total = np.maximum(1, kinds.sum(1))
    size = np.maximum(1, kinds.sum(1) - kinds[:, KINDS.index("blank")])
    words, lengths = np.maximum(1, t.counts), t.ends - t.starts
    share = lambda name: kinds[:, KINDS.index(name)] / size
    distinct, top = _repeats(t.owner, t.hashes, t.n)
    same = np.concatenate([[False], (t.hashes[1:] == t.hashes[:-1]) & (t.owner[1:] == t.owner[:-1])]) if len(lengths) else np.zeros(0, bool)
    inner = np.concatenate([[False], t.owner[1:] == t.owner[:-1]]) if len(lengths) else np.zeros(0, bool)
    pairs = t.hashes[inner] * np.uint64(31) + t.hashes[np.flatnonzero(inner) - 1]
    different, _ = _repeats(t.owner[inner], pairs, t.n)
    n_pairs = np.maximum(1, np.bincount(t.owner[inner], minlength=t.n))
    kind_sum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    upper = kind_sum((t.raw >= 65) & (t.raw <= 90))
    capital = (upper[t.ends] - upper[t.starts] >= 0.6 * lengths) & (lengths >= 2)
    odd = kind_sum((t.raw >= 33) & (t.raw <= 126) & ~((t.raw | 32) - 97 < 26) & ~(t.raw - 48 < 10) & ~np.isin(t.raw, list(b".,;:'\"()-?!")))
    odd_words = odd[t.ends] - odd[t.starts] >= 2
    feeds = kind_sum(t.raw == 10)
    lines = feeds[t.bounds[1:]] - feeds[t.bounds[:-1]] + 1
    # A line's hash: the sum of its words' hashes by place; equal lines have equal sums.
    line_of = t.owner + feeds[t.starts] if len(lengths) else np.zeros(0, np.int64)
    if len(lengths):
        begin = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        line_owner, line_hash = t.owner[begin], np.add.reduceat(t.hashes, begin)
        line_kinds, _ = _repeats(line_owner, line_hash, t.n)
        full = np.maximum(1, np.bincount(line_owner, minlength=t.n))
        repeated = 1 - line_kinds / full
    else:
        repeated = np.zeros(t.n)
    return np.stack([np.log1p(t.counts), size / words, t.per_text(lengths >= 12) / words, share("upper"), share("digit"), share("stop"), share("shout"), share("symbol"), share("other"), kinds[:, 0] / total, np.log1p(lines), t.counts / lines, distinct / words, t.per_text(same) / words, top / words, repeated, t.per_text(capital) / words, t.per_text(odd_words) / words, 1 - different / n_pairs], 1)


class QualityModel:
    """The additive model, or a base rate where nothing could be learned."""

    def __init__(self, base: float = 0.5, additive: AdditiveModel | None = None):
        self.base, self.additive = base, additive

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.additive.score(x) if self.additive else np.full(len(x), self.base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> QualityModel:
    """A model from at most ``most`` labelled rows (the bound of the sample); one class only, or no rows: the base rate."""
    rows = training_rows(docs, labels, label, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                x = np.column_stack([features(texts), batch.column(1).to_numpy()[first : first + len(texts)]])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["x"])

    sample = np.array([r[0] for r in rows.mapInArrow(run, "x array<double>").collect()], float).reshape(-1, len(FEATURES) + 1)
    sample = sample[np.lexsort(sample.T)]  # the same model whatever the order of the rows
    x, y = sample[:, :-1], sample[:, -1]
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(float(y.mean()) if len(y) else 0.5)
    return QualityModel(float(y.mean()), AdditiveModel().fit(x, y))


def scored(docs: DataFrame, model: QualityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score in [0, 1] and predicted (1 from ``threshold`` on) of each row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(model.score(features(texts)))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
