"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.boosting import GradientBoosting, Isotonic, _sigmoid
from pixelyard.llm.common import Scratch, without
from pixelyard.llm.labelled import held_out, training_rows
from pixelyard.llm.tokens import give_back, slices
from pixelyard.llm.words import KINDS, Texts

# General insults, and second-person words of four languages.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "dumb", "jerk", "creep", "filthy", "vermin", "coward", "liar", "ugly"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "tú", "ti", "vosotros"]

#: Characters that stand for letters in disguised words, and the letters.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_STEM = (4, 5, 6)
_NEAR = 5
_NOTHING = (0.0,) * 7

FEATURES = ["words", "hits", "hit_density", "weight_density", "top_weight", "insult_density", "stem_density", "near_you", "capitals", "capital_words", "stops", "shouts", "symbols", "digits", "disguised", "disguised_hits", "word_length"]

_EDGE = ".,;:!?\"'()[]{}-*_~#<>«»¿¡…"


def _plain(word: str) -> str:
    return word.strip(_EDGE)


def _undisguised(word: str) -> str:
    """The word without signs between its letters, digits read as letters."""
    return "".join(c for c in word.translate(_DISGUISE) if c.isalpha())


def learn_lexicon(rows: DataFrame, scratch: Scratch, folds: tuple[int, ...] = (0, 1), most: int = 400, support: int = 4) -> list[dict[str, float]]:
    """For each fold the terms that tell its toxic texts from its others, then those of all folds.

    Terms are words, and word beginnings of 4 to 6 letters (written with a trailing ``*``). A term's
    weight is its smoothed log odds by document counts; kept are at most ``most`` terms that at
    least ``support`` toxic documents hold and whose odds are at least five to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                t = Texts(texts)
                distinct, number = t.distinct()
                label, fold = (batch.column(i).to_numpy()[first : first + t.n] for i in (1, 2))
                table: dict[str, int] = {}
                of_word = []
                for w in map(_plain, distinct):
                    terms = [w] if 3 <= len(w) <= 24 else []
                    terms += [w[:n] + "*" for n in _STEM if len(w) >= n]
                    of_word.append([table.setdefault(x, len(table)) for x in terms])
                sizes = np.fromiter(map(len, of_word), np.int64, len(of_word))
                flat = np.fromiter((i for x in of_word for i in x), np.int64, int(sizes.sum()))
                begin = np.cumsum(sizes) - sizes
                n = sizes[number]
                term = flat[np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                doc = np.repeat(t.owner, n)
                pairs = np.unique(doc * len(table) + term) if len(table) else np.empty(0, np.int64)
                doc, term = np.divmod(pairs, max(1, len(table)))
                cell = term * 4 + fold[doc] * 2 + label[doc]
                counts = np.bincount(cell, minlength=4 * len(table)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *(pa.array(counts[:, i]) for i in range(4))], names=["term", "c00", "c01", "c10", "c11"])

    counts = rows.mapInArrow(run, "term string, c00 long, c01 long, c10 long, c11 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])
    # Written once for the three choices of folds: terms that enough toxic documents hold.
    counts = scratch.write("terms", counts.where(F.col("c01") + F.col("c11") >= support))
    totals = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    out = []
    for chosen in [*((f,) for f in folds), folds]:
        ones, zeros = sum((F.col(f"c{f}1") for f in chosen), F.lit(0)), sum((F.col(f"c{f}0") for f in chosen), F.lit(0))
        n1, n0 = sum(totals.get((f, 1), 0) for f in chosen), sum(totals.get((f, 0), 0) for f in chosen)
        odds = F.log((ones + 0.5) / (n1 + 1)) - F.log((zeros + 0.5) / (n0 + 1))
        kept = counts.where(ones >= support).select("term", odds.alias("odds"), ones.alias("ones")).where(F.col("odds") >= float(np.log(5)))
        # By what a term explains: its odds times the square root of its documents.
        best = kept.orderBy((F.col("odds") * F.sqrt("ones")).desc(), "term").limit(most)
        out.append({r["term"]: float(r["odds"]) for r in best.collect()})
    return out


class Features:
    """Dense features of texts under a lexicon; what is known of a word is kept between batches."""

    def __init__(self, lexicon: dict[str, float], memo: int = 200_000):
        self.lexicon, self.memo, self.known = lexicon, memo, {}
        self.insults, self.second = set(INSULTS), set(SECOND_PERSON)

    def _weight(self, word: str) -> tuple[float, float]:
        exact = self.lexicon.get(word, 0.0)
        stem = max((self.lexicon.get(word[:n] + "*", 0.0) for n in _STEM if len(word) >= n), default=0.0)
        return exact, stem

    def _word(self, raw: str) -> tuple[float, ...]:
        word = _plain(raw)
        exact, stem = self._weight(word)
        disguised = hidden = 0.0
        inner = raw.strip(".,;:!?\"'()")
        if not inner.isalpha() and len(inner) >= 4 and any(c.isalpha() for c in inner) and not inner.replace("-", "").replace("'", "").isalpha():
            disguised, clear = 1.0, _undisguised(inner)
            hidden = float(clear in self.insults or max(self._weight(clear)) > 0)
        if not (exact or stem or disguised) and word not in self.insults and word not in self.second:
            return _NOTHING
        return max(exact, stem), float(exact > 0), float(stem > 0), float(word in self.insults), float(word in self.second), disguised, hidden

    def __call__(self, texts: pa.Array) -> np.ndarray:
        t = Texts(texts)
        distinct, number = t.distinct()
        if len(self.known) > self.memo:
            self.known = {}
        known = self.known
        for w in distinct:
            if w not in known:
                known[w] = self._word(w)
        facts = np.array([known[w] for w in distinct], float).reshape(len(distinct), 7)[number]
        weight, exact, stem, insult, second, disguised, hidden = facts.T
        hit = ((weight > 0) | (insult > 0) | (hidden > 0)).astype(float)
        near = np.zeros(len(number), bool)
        at = np.flatnonzero(second)
        for d in range(-_NEAR, _NEAR + 1):
            to = at + d
            to = to[(to >= 0) & (to < len(near))]
            near[to] |= t.owner[to] == t.owner[to - d]
        kinds = t.kinds()
        size = np.maximum(1, kinds.sum(1) - kinds[:, KINDS.index("blank")])
        words = np.maximum(1, t.counts)
        upper = (t.raw >= 65) & (t.raw <= 90)
        ups = np.concatenate([[0], np.cumsum(upper)])
        caps = (ups[t.ends] - ups[t.starts] == t.ends - t.starts) & (t.ends - t.starts >= 3)
        top = np.zeros(t.n)
        np.maximum.at(top, t.owner[weight > 0], weight[weight > 0])
        share = lambda name: kinds[:, KINDS.index(name)] / size
        hits = t.per_text(hit)
        return np.stack([np.log1p(t.counts), np.log1p(hits), hits / words, t.per_text(weight) / words, top, t.per_text(insult) / words, t.per_text(stem) / words, t.per_text(hit * near), share("upper"), t.per_text(caps) / words, share("stop"), share("shout"), share("symbol"), share("digit"), t.per_text(disguised) / words, np.log1p(t.per_text(hidden)), size / words], 1)


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], base: float = 0.5, trees: GradientBoosting | None = None, calibration: Isotonic | None = None):
        self.lexicon, self.base, self.trees, self.calibration = lexicon, base, trees, calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        margin = self.trees.margin(x)
        return self.calibration(margin) if self.calibration else _sigmoid(margin)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000) -> ToxicityModel:
    """A model from at most ``most`` labelled rows (the bound of the sample).

    The lexicon and the trees are cross-fitted: a row's features come from terms of the other
    fold, and the calibration sees margins of trees that never saw the row. If the sample holds one
    class only, or none, every score is its base rate.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write("sample", training_rows(docs, labels, label, most))
    lexicons = learn_lexicon(rows, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = [Features(lexicons[1]), Features(lexicons[0])]
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                label, fold = (batch.column(i).to_numpy()[first : first + len(texts)] for i in (1, 2))
                x = np.where(fold[:, None] == 0, views[0](texts), views[1](texts))
                flat = pa.array(np.column_stack([x, label, fold]).ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] + 2)), flat)], names=["x"])

    sample = np.array([r[0] for r in rows.mapInArrow(run, "x array<double>").collect()], float).reshape(-1, len(FEATURES) + 2)
    scratch.release("sample", "terms")
    sample = sample[np.lexsort(sample.T)]  # the same model whatever the order of the rows
    x, y, fold = sample[:, :-2], sample[:, -2], sample[:, -1]
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(lexicons[2], float(y.mean()) if len(y) else 0.5)
    margins, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in (0, 1):
        inside = fold == f
        if inside.any() and (~inside).any():
            margins[inside] = GradientBoosting().fit(x[~inside], y[~inside]).margin(x[inside])
            seen |= inside
    calibration = Isotonic().fit(margins[seen], y[seen]) if seen.any() else None
    return ToxicityModel(lexicons[2], float(y.mean()), GradientBoosting().fit(x, y), calibration)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", output: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and the score in [0, 1] of each row's whole text (null: empty).
    The text goes to Python once, also where ``keep`` names it."""
    kept = [id_col, *keep]
    sent = kept if text_col in kept else [*kept, text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)) + f", `{output}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for batch in batches:
            for first, texts in slices(batch.column(sent.index(text_col))):
                got = pa.array(model.score(features(texts)))
                columns = [batch.column(i).slice(first, len(texts)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, got], names=[*kept, output])
        del features
        give_back()

    return docs.select(*sent).mapInArrow(run, schema)


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of each row."""
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    docs = without(docs, "__score")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    out = score(docs, model, output="__score", keep=rest)
    return out.where(F.col("__score") < threshold).select(*docs.columns)
