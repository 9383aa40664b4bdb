"""Classifiers, mixing, packing, archives, neighbours and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pixelyard.llm import mixing, neighbours, packing, quality, toxicity, warc
from pixelyard.llm import queries as Q
from pixelyard.llm.boosting import AdditiveModel, GradientBoosting, Isotonic
from pixelyard.llm.tokens import BatchEncoder, slices

from .conftest import DOC

SMALL = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("memo", [0, 60_000, 32 << 20])
def test_encoder_is_the_tokenizer(memo):
    rng, t = random.Random(1), Tokenizer.from_file(VOCABULARY)
    signs = [" ", "  ", "\n", "\n\n", "\t", "a", "é", "日", "’", " ", " ", "　", "'s", "1", "!", "<|endoftext|>", "🙂", "word", "The", "\r\n", ".", ",", "\x85", "\x1c", "т"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, ""]
    encoder = BatchEncoder(VOCABULARY, memo=memo)
    for first, part in slices(pa.array(texts), 20_000):
        ids, begin = encoder.encode(part)
        for k in range(len(part)):
            assert ids[begin[k] : begin[k + 1]].tolist() == t.encode(texts[first + k] or "", add_special_tokens=False).ids


def test_memo_is_bounded_by_bytes():
    """Long unbroken stretches are never remembered, short ones until the bound; results do not depend on it."""
    rng, t = random.Random(2), Tokenizer.from_file(VOCABULARY)
    texts = ["".join(rng.choice("日本語文字列漢字") for _ in range(1000)) for _ in range(40)] + [f"w{k} x{k}" for k in range(3000)]
    encoder = BatchEncoder(VOCABULARY, memo=100_000)
    for _ in range(2):
        for first, part in slices(pa.array(texts), 50_000):
            ids, begin = encoder.encode(part)
            for k in range(len(part)):
                assert ids[begin[k] : begin[k + 1]].tolist() == t.encode(texts[first + k], add_special_tokens=False).ids
        assert max(map(len, encoder.known)) <= 64 and 300 < len(encoder.known) < 600 and encoder.held < 101_000
    assert len(encoder.ids) < 1 << 18


def check_packing(rows, packed, width):
    t, want = Tokenizer.from_file(VOCABULARY), Counter()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % width or width
        edges = [0, *range(first, len(ids) + 1, width)]
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, [*parts[1:], (sum(parts[-1]), 0)])) and parts[0][0] == 0
        assert sum(parts[-1]) <= width
    return len(bins), -(-sum(n for x in bins.values() for _, n in x) // width)


def test_packing(odd, odd_rows):
    packed = packing.pack(packing.tokenize(odd, VOCABULARY, 512), 512, block=50, fan_in=2).collect()
    used, least = check_packing(odd_rows, packed, 512)
    assert used <= least + 3


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(6)
    used, least = check_packing([tuple(r) for r in docs.collect()], packing.pack(packing.tokenize(docs, VOCABULARY, 2048)).collect(), 2048)
    assert used <= 1.03 * least


def test_packing_of_nothing(none):
    assert packing.pack(packing.tokenize(none, VOCABULARY, 2048)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5]


@pytest.mark.parametrize("parts", [[7, 2, 1], [1] * 10, [10], [333, 333, 334], [3, 3, 3, 1]])
def test_edf_stays_within_a_block(parts):
    slots = mixing.edf(parts)
    assert sorted(int(t) for s in slots for t in s) == list(range(sum(parts)))
    for share, own in zip(parts, slots):
        for t in range(sum(parts) + 1):
            assert abs(np.searchsorted(own, t) - share * t / sum(parts)) < 1


def test_mix(spark, none):
    rows = [(k, "abc"[(k > 500) + (k > 800)]) for k in range(900)] + [(None, "a"), (7, "a"), (7, "a"), (950, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'mine' AS mix_slot")
    got = mixing.mix(docs, {"a": 3, "b": 2, "c": 1, None: 1}, block=4, period=70, bucket_rows=50).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    places = Counter((r.source, r.mix_block, r.mix_place) for r in got)
    assert set(places.values()) == {1}
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.mix_slot, set()).add((r.source, r.mix_block, r.mix_phase))
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(x) == 1 for x in by_slot.values())
    seen, first = Counter(), [next(iter(by_slot[s])) for s in sorted(by_slot)]
    parts = mixing.quantized({"a": 3, "b": 2, "c": 1, None: 1}, 70)
    for t, (source, block, phase) in enumerate(first, 1):
        assert block == seen[source]
        seen[source] += 1
        if phase == 0:
            assert all(abs(seen[s] - t * parts[s] / 70) < 1 for s in parts)
    only = mixing.mix(docs, {"a": 3, "b": 2, "c": 1, None: 1}, block=4, period=70, until="first").collect()
    assert {(r.source, r.mix_slot) for r in only} == {(r.source, r.mix_slot) for r in got if r.mix_phase == 0}
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1}).count()


@pytest.mark.parametrize("sizes", [[2000] + [200] * 20, [1500] + [2 + k % 2 for k in range(1500)]])
def test_mix_follows_the_target_weights(spark, sizes):
    """Deviation from the exact weights, not from parts of a period; also with more sources than a period has slots."""
    docs = spark.createDataFrame([(k, f"s{s}") for s, n in enumerate(sizes) for k in range(n)], "doc_id long, source string")
    got = mixing.mix(docs, exponent=0.9, block=1).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    assert sorted(r.mix_slot for r in got) == list(range(sum(sizes)))
    own = {f"s{s}": n**0.9 for s, n in enumerate(sizes)}
    phase = [r for r in got if r.mix_phase == 0]
    assert sorted(r.mix_slot for r in phase) == list(range(len(phase)))
    total, ended = sum(own.values()), Counter(r.source for r in phase)
    for r in phase:
        share = own[r.source] / total
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        assert abs(r.mix_block - share * r.mix_slot) < 1 and abs(r.mix_block + 1 - share * (r.mix_slot + 1)) < 1
    assert all(abs(ended[s] - w / total * len(phase)) < 1 for s, w in own.items())


def test_trees_pairs_and_calibration():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    assert ((AdditiveModel(pairs=2).fit(x[:2000], y[:2000]).score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert ((GradientBoosting().fit(x[:2000], y[:2000]).margin(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    margin = rng.normal(size=4000)
    truth = rng.random(4000) < 1 / (1 + np.exp(-3 * margin))
    fitted = Isotonic().fit(margin, truth.astype(float))
    grid = fitted(np.linspace(-4, 4, 50))
    assert (np.diff(grid) >= 0).all() and abs(fitted(np.array([0.0]))[0] - 0.5) < 0.12


@pytest.mark.parametrize("name, label, threshold", [("op5_toxicity", "toxic", 0.7), ("op8_quality", "quality", 0.5)])
def test_held_out_accuracy(spark, name, label, threshold):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.QUERIES[name](spark, folder).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    held = [i for i in labels if i in got and got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.97 * len(held)
    assert sum(got[i].predicted for i in held if labels[i]) >= 0.9 * sum(labels[i] for i in held)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_of_odd_rows(odd, none, spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (2, 1, 1)], LABEL)
    rows = module.scored(odd, module.fit(odd, labels)).collect()
    assert len(rows) == 17 and all(0 <= r.score <= 1 for r in rows)
    nothing = spark.createDataFrame([], LABEL)
    assert {r.score for r in module.scored(odd, module.fit(odd, nothing)).collect()} == {0.5}
    assert module.scored(none, module.fit(none, labels)).count() == 0


def test_toxic_rows_go_and_columns_stay(odd, spark):
    model = toxicity.ToxicityModel({}, base=0.1)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.without_toxic(odd, model).count() == 17
    assert toxicity.without_toxic(odd, toxicity.ToxicityModel({}, base=0.9)).count() == 0


def brute_pages(rows):
    last = {}
    for i, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        revisit = i is not None and i < top
        out.append((repr(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", repr(top if revisit else None)))
    return sorted(out)


def test_archives(spark):
    rows = [(1, "<p>same</p>"), (2, "<p>same</p>"), (3, None), (4, ""), (5, "ü\r\n\r\nWARC/1.1\r\n" * 50), (6, "x" * 2_000_000), (6, "x" * 2_000_000), (None, "<p>same</p>"), (-7, "neg"), (9, "neg")]
    pages = spark.createDataFrame([(i, f"http://h/{i}\nx", h, "mine") for i, h in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to)) for r in got) == brute_pages(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_filters_skip_payloads(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 5}</p>" * 3000) for k in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.records(pages).coalesce(2).write.format("warc").mode("append").option("rolloverBytes", 2000).save(folder)
    read = spark.read.format("warc").load(folder)
    assert read.where("record_type = 'revisit'").count() == 35
    one = read.where("target_uri = 'http://h/39'").collect()
    assert [bytes(r.payload) for r in one] == [b"<p>4</p>" * 3000]
    reader = warc._Reader(folder, 1 << 20, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(rest) == 1 and reader.tests == [("WARC-Type", {"revisit"})]
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 35


def test_archives_of_others(tmp_path):
    """Plain archives, and members without lengths in their gzip header."""
    import gzip

    records = [(f"r{k}", "metadata" if k % 2 else "resource", bytes([65 + k]) * (10_000 * k)) for k in range(6)]
    plain = b"".join(f"WARC/1.0\r\nWARC-Type: {t}\r\nWARC-Record-ID: {i}\r\nX-Folded: a\r\n b\r\nContent-Length: {len(d)}\r\n\r\n".encode() + d + b"\r\n\r\n" for i, t, d in records)
    (tmp_path / "a.warc").write_bytes(plain)
    cut = [p for p in plain.split(b"WARC/1.0\r\n") if p]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\n" + p) for p in cut))
    for name in ("a.warc", "b.warc.gz"):
        with open(tmp_path / name, "rb") as file:
            got = list(warc._Members(file).records(lambda h: h["WARC-Type"] == "resource"))
        assert [(h["WARC-Record-ID"], b) for h, b in got] == [(i, d if t == "resource" else None) for i, t, d in records]
        assert all(h["X-Folded"] == "a b" for h, _ in got)


def exact_neighbours(ids, x, asks, k):
    out = {}
    for q in np.flatnonzero(asks):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_reach_their_recall(spark):
    got = {}
    for r in Q.QUERIES["op1_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = exact_neighbours(ids, x, ids % 20 == 0, 20)
    assert set(got) == set(truth)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want}) / len(want) for q, want in truth.items()]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=4).tolist()
    rows = [(k, same) for k in range(0, 90)] + [(100 + k, rng.normal(size=4).tolist()) for k in range(30)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 1.0]), (None, same), (205, [])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").selectExpr("*", "'mine' AS label", "1 AS id", "2 AS leaf")
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 10 == 0, k=20, sample=50, block=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, want in exact_neighbours(ids, x, ids % 10 == 0, 20).items():
        if q < 90:  # copies: ties go to the smallest ids
            assert [v for _, v, _ in sorted(got[q])] == [v for v, _ in want]
        assert len(got[q]) == 20
    few = neighbours.search(frame.where("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert sorted((r.rank, r.vec_id) for r in few) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_mixing_stage_keeps_every_document(spark):
    """A source of one document ends the first phase early; the others' documents follow."""
    rows = [(k, f"text {k}", "en", "large" if k < 3000 else "small" if k < 3040 else None, 9) for k in range(3041)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows, key=lambda r: r[0])


def test_pipeline_stages(spark):
    """Each stage on its own input: what goes and what stays."""
    folder, docs, before = "/root/testdata/sf0.001", None, None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        names.append(name)
        old, new = {r.doc_id: r for r in before.collect()}, docs.collect()
        if name in ("toxicity", "ngram_jaccard_join", "mix_sources"):
            assert all(old[r.doc_id] == r for r in new) and len({r.doc_id for r in new}) == len(new) >= 0.5 * len(old)
        if name == "line_dedup":
            assert {r.doc_id for r in new} == set(old) and all(r.n_chars == len(r.text) for r in new)
        if name == "best_fit_packing":
            check_packing([(r.doc_id, r.text) for r in old.values()], new, 2048)
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    whole = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in new)


def test_stages_take_odd_rows_and_none(spark, odd, none):
    """Nulls, empty and very long texts, repeats and clashing columns: filtering stages keep the columns and lose no clean row."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, "/root/testdata/sf0.001")
        assert kept.columns == odd.columns, name
        ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
        assert name == "toxicity" or set(ids) >= {None, 1, 4, 5, 7, 9, 14}, name
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, odd, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.select("doc_id").collect()}
    assert pack(spark, none, "/root/testdata/sf0.001").count() == 0


def test_vectors_of_another_length_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=5).tolist()) for i in range(20)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5)
    found = got.collect()
    assert {r.query_id for r in found} == {0, 20, 40} and all(r.vec_id < 100 for r in found) and len(found) == 15


def test_archives_are_read_through_pushed_record_types(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "v", None)], "page_id long, url string, html string")
    out = warc.round_trip(pages)
    assert {(r.page_id, r.record_type, r.refers_to) for r in out.collect()} == {(1, "revisit", 2), (2, "response", None), (3, "response", None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter " in line]
    assert plan.count("BatchScan warc") == 2 and not any("= response" in line or "= revisit" in line for line in left), plan


def test_the_schedule_is_never_broadcast(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(400)], "doc_id long, source string")
    out = mixing.mix(docs, block=8)
    assert out.count() == 400
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "mix_block" in line]
    assert joins and not any("Broadcast" in line for line in joins)
