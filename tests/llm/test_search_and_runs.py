"""Lexical search, periodic runs and decontamination against brute force, on odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelyard.llm import contamination, lexical, periodic, queries

from .conftest import DOC, prose

ITEM = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def items_of(rows):
    """Passages of the documents, other words, repeats, nulls, nothing, and items of fewer words than a window."""
    long = [" ".join(terms(t)[5:30]) for _, t, *_ in rows if len(terms(t)) > 40]
    return [(k, t) for k, t in enumerate(long)] + [(50, None), (51, ""), (52, "Two, WORDS"), (53, " ".join(prose(77, 30))), (54, long[0]), (55, "last last last end"), (None, long[0] + " tail"), (56, "naïve Ünïcode 日本語"), (56, "x x x x x x x x x x x")]


def brute_search(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(repr(item), rank + 1, repr(None if null else i), -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"columns": 3, "tile": 4}, {"most_rows": 4, "k": 3}])
def test_search(spark, odd, odd_rows, options):
    items = items_of(odd_rows)
    got = lexical.search(odd, spark.createDataFrame(items, ITEM).withColumn("score", F.lit("mine")), **options)
    assert sorted((repr(r.item_id), r["rank"], repr(r.doc_id), r.score) for r in got.collect()) == brute_search(odd_rows, items, options.get("k", 10))


def test_search_of_nothing(spark, none, odd):
    items = spark.createDataFrame([(1, "alpha")], ITEM)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, items.where("false")).count() == 0
    assert lexical.search(odd, spark.createDataFrame([(1, None), (2, "?!")], ITEM)).count() == 0


def test_tiles_stay_exact():
    """Repeats so many that one weight would pass 2 ** 53 are multiplied in layers, and tiles end before it."""
    rng = random.Random(3)
    weights = np.array([rng.randrange(1, 1 << 35) for _ in range(400)])
    q = lexical.Queries([0, 1], np.repeat(np.arange(200), 2), np.tile([0, 1], 200), weights, 200, 64)
    impact = np.array([rng.randrange(10**6) for _ in range(200)])
    total = np.zeros(2, np.int64)
    for covered, tile in q.tiles(np.arange(200)):
        partial = impact[covered].astype(float) @ tile
        assert partial.max() < 2**53
        total += partial.astype(np.int64)
    assert total.tolist() == [sum(int(a) * int(b) for a, b in zip(impact, weights[i::2])) for i in (0, 1)]


def test_best_keeps_the_smaller_ids_of_ties():
    best, rng, all_rows = lexical.Best(1, 5), np.random.default_rng(1), []
    for _ in range(30):
        scores, ids = rng.integers(0, 4, (50, 1)), rng.permutation(10_000)[:50]
        best.add(scores, ids, np.zeros(50, np.int64))
        all_rows += [(-int(s), int(i)) for s, i in zip(scores[:, 0], ids) if s > 0]
    best.settle()
    assert [(-int(s), int(i)) for s, i in zip(best.rows[1], best.rows[3])] == sorted(all_rows)[:5]


def brute_windows(rows, items, size=10):
    grams = {}
    for item, text in items:
        w = terms(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    by_first, out = {}, []
    for g in grams:
        by_first.setdefault(g[0], []).append(g)
    for i, t, *_ in rows:
        w, hit, ids = terms(t), set(), set()
        for at, first in enumerate(w):
            for g in by_first.get(first, ()):
                if tuple(w[at : at + len(g)]) == g:
                    hit.update(range(at, at + len(g)))
                    ids |= grams[g]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((repr(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"most_rows": 3}])
def test_contamination(spark, odd, odd_rows, options):
    items = items_of(odd_rows)
    found = contamination.scan(odd, spark.createDataFrame(items, ITEM), **options)
    got = contamination.digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_windows(odd_rows, items)


@pytest.mark.parametrize("options", [{}, {"most_rows": 3}])
def test_decontaminate(spark, odd, odd_rows, options):
    items = spark.createDataFrame(items_of(odd_rows), ITEM)
    dirty = odd.withColumn("items", F.lit("mine"))
    cut = contamination.decontaminate(dirty, items, **options)
    assert cut.columns == dirty.columns and cut.count() == len(odd_rows)
    assert cut.where("items <> 'mine'").count() == 0
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert {(7, ""), (4, None), (5, ""), *((r[0], r[1]) for r in odd_rows if r[0] == 14)} <= texts
    kept = contamination.decontaminate(dirty, items, remove="documents", **options)
    hits = {r[0] for r in brute_windows(odd_rows, items_of(odd_rows)) if r[2]}
    want = Counter(r[0] for r in odd_rows if repr(r[0]) not in hits)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_spans_are_what_is_cut(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "three four")], ITEM)
    docs = spark.createDataFrame([(1, "Ünï — ONE, two three\nfour! tail"), (2, "one two"), (3, "one two three, one two three")], "doc_id long, text string")
    for rows in (20_000, 1):
        got = {r.doc_id: r.text for r in contamination.decontaminate(docs, items, most_rows=rows).collect()}
        assert got == {1: "Ünï — ! tail", 2: "one two", 3: ""}


def test_contamination_of_nothing(spark, none, odd, odd_rows):
    items = spark.createDataFrame(items_of(odd_rows), ITEM)
    assert contamination.scan(none, items).count() == 0
    assert contamination.scan(odd, items.where("false")).where("n_hit > 0").count() == 0


def smallest_period(w):
    edge, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = edge[k - 1]
        k += w[i] == w[k]
        edge[i] = k
    return len(w) - edge[-1]


def brute_runs(w, least=0):
    out = set()
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p) and smallest_period(w[i : j + p]) == p:
                out.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, depth=0):
    """Nested repetitions with edits, over alphabets of few or many letters."""
    kind = rng.randrange(6)
    if depth > 4 or kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
    if kind <= 2:
        return repetitive(rng, depth + 1) * rng.randrange(1, 6) + repetitive(rng, depth + 1)[: rng.randrange(9)]
    w = repetitive(rng, depth + 1) + repetitive(rng, depth + 1)
    if rng.random() < 0.3:
        w[rng.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_nested_repetitions(seed):
    rng = random.Random(seed)
    for _ in range(15):
        texts = [repetitive(rng)[: rng.choice([50, 400, 1500])] for _ in range(rng.randrange(1, 10))] + [[]]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = periodic.find_runs(np.array([x for w in texts for x in w], np.int64), bounds)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, w in enumerate(texts) for r in brute_runs(w)]


def test_runs_of_every_period():
    """One run of each period, exactly three periods long, between other words; also a word short of it."""
    texts = []
    for p in range(1, 150):
        base = [1000 + k for k in range(p)]
        texts += [[*range(5), *base * 3, 7, 8], [*range(5), *(base * 3)[:-1], 7]]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    got = periodic.find_runs(np.array([x for w in texts for x in w], np.int64), bounds)
    assert got.tolist() == [[2 * (p - 1), 5, 3 * p, p] for p in range(1, 150)]


def brute_periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 24)
    drop = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (repr(doc_id), len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_collapsed_texts(spark, odd, odd_rows):
    def words(w):
        return " ".join(f"w{x}" for x in w)

    rng = random.Random(8)
    rows = [r for r in odd_rows if r[0] != 9]  # the quadratic reference takes too long for 60,000 words
    rows += [(100 + k, words(repetitive(rng)[:600]), None, None, 0) for k in range(60)] + [(None, words([1, 2, 3] * 20), None, None, 0)]
    found = periodic.collapse_runs(spark.createDataFrame(rows, DOC).withColumn("runs", F.lit("mine")), order=periodic.planted)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(repr((repr(r[0]), *r[1:])) for r in periodic.digests(found).select(*names).collect()) == sorted(repr(brute_periodic(r[0], r[1])) for r in rows)


def test_runs_of_a_long_text(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(7001)]
    text = " ".join([*prose(5, 20_000), *(base * 12), *prose(6, 100)])
    row = periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(20_000, 84_012, 7001)]
    assert row.collapsed == " ".join([*prose(5, 20_000), *base, *prose(6, 100)])


def test_runs_of_nothing(none):
    assert periodic.digests(periodic.collapse_runs(none)).count() == 0


def test_queries_take_the_production_parameters(spark, tmp_path, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (None, 9)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    items = [x for x in items_of(rows) if x[0] is not None]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr((repr(r[0]), *r[1:])) for r in got) == sorted(repr(brute_periodic(r[0], r[1])) for r in rows)
    got = queries.op11_lexical_search(spark, str(tmp_path)).collect()
    assert sorted((repr(r.item_id), r["rank"], repr(r.doc_id), r.score) for r in got) == brute_search(rows, items, 10)
    got = queries.op13_decontamination(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_windows(rows, items)


def test_windows_do_not_cross_texts():
    w = contamination.Words(pa.array(["a b", "c d", None, "e"]))
    assert [w.text(int(i), 2) for i in w.windows(2)[0]] == [b"a b", b"c d"]
