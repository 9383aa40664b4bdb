"""N-gram Jaccard join: token-combination prefixes, exact verification and connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch
from pixelyard.llm.components import contract
from pixelyard.llm.tokens import slices
from pixelyard.llm.words import Texts, mix64

#: Counters of the frequency table; its size does not depend on the corpus.
COUNTERS = 1 << 20
_ODD, _BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and where each text begins.

    A text of fewer than ``size`` words is one shingle, one without words has none.
    """
    t = Texts(texts)
    n, h = len(t.hashes), t.hashes
    if not n:
        return np.empty(0, np.uint64), np.zeros(t.n + 1, np.int64)
    rolled = np.zeros(n, np.uint64)
    left = t.first[1:][t.owner] - np.arange(n)  # words from here to the end of the text
    for i in range(size):
        inside = left > i
        rolled[inside] = rolled[inside] * _ODD + h[np.flatnonzero(inside) + i]
    whole = (left >= size) | ((t.counts[t.owner] < size) & (np.arange(n) == t.first[:-1][t.owner]))
    # A short text's hash is told from a full one's by its number of words.
    values = mix64(rolled[whole] + np.minimum(t.counts[t.owner[whole]], size).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    owner = t.owner[whole]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
    return values[new], np.searchsorted(owner[new], np.arange(t.n + 1))


_DIGESTS = (np.uint64(0x1F123BB5), np.uint64(0x5851F42D))


def _digest(values: np.ndarray, begin: np.ndarray, key: np.uint64) -> np.ndarray:
    """64 bits of each set: a sum over its members, so their order does not matter."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values + key))])
    return (sums[begin[1:]] - sums[begin[:-1]]).view(np.int64)


def _profile(size: int):
    """Rows (doc_id, n, digest) of each text, and one row with the partition's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(COUNTERS, np.uint32), ["doc_id", "n", "d1", "d2", "counts"]
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                values, begin = shingle_sets(texts, size)
                counts += np.bincount((values >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                d1, d2 = (_digest(values, begin, k) for k in _DIGESTS)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).cast(pa.int64()), pa.array(np.diff(begin)), pa.array(d1), pa.array(d2), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            raw = zlib.decompress(x.as_buffer())
            part = np.frombuffer(raw, np.uint32 if len(raw) == 4 * COUNTERS else np.uint64)
            total = part.astype(np.uint64) if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["counts"])


def frequency_table(counts: DataFrame, fan_in: int = 64) -> np.ndarray:
    """The counters of all partitions, added up in a tree of tasks that stream ``fan_in`` tables each."""
    n = counts.count()
    while n > 1:
        n = -(-n // fan_in)
        counts = counts.repartition(n).mapInArrow(_add_up, "counts binary")
    rows = counts.collect()  # one table of fixed size
    return np.zeros(COUNTERS, np.uint64) if not rows else next(_widen(r[0]) for r in rows)


def _widen(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * COUNTERS else np.uint64).astype(np.uint64)


#: Bits of a filter of ids at most; its size is bounded whatever the corpus, and what it lets through grows instead.
FILTER_BITS = 1 << 28


def _filter_places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = values.astype(np.int64).view(np.uint64), np.uint64(bits - 1)
    return (mix64(x + _ODD) & mask).astype(np.int64), (mix64(x ^ _BASE) & mask).astype(np.int64)


class IdFilter:
    """A Bloom filter of the whole numbers in a table's columns, built in tasks and broadcast: two bits of sixteen for
    each number up to ``FILTER_BITS``. It lets every number of the table through and few others,
    so that a join shuffles little more than what it keeps. Results never depend on it."""

    def __init__(self, ids: DataFrame, most_bits: int = FILTER_BITS, fan_in: int = 64):
        self.bits = bits = min(most_bits, 1 << max(10, (16 * len(ids.columns) * ids.count()).bit_length()))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(bits, bool)
            for batch in batches:
                for column in batch.columns:
                    for places in _filter_places(column.to_numpy(), bits):
                        table[places] = True
            if table.any():
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(table).tobytes(), 1)], pa.binary())], names=["bits"])

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                for x in batch.column(0):
                    total |= np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["bits"])

        parts, n = ids.mapInArrow(fill, "bits binary"), ids.rdd.getNumPartitions()
        while n > 1:
            n = -(-n // fan_in)
            parts = parts.repartition(n).mapInArrow(unite, "bits binary")
        rows = parts.collect()  # one filter of bounded size
        packed = np.frombuffer(zlib.decompress(rows[0][0]), np.uint8) if rows else np.zeros(bits // 8, np.uint8)
        self.table = ids.sparkSession.sparkContext.broadcast(packed)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        table, hit = self.table.value, np.ones(len(values), bool)
        for places in _filter_places(values, self.bits):
            hit &= (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0
        return hit

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows whose first column may be in the table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self(batch.column(0).to_numpy())))

        return rows.mapInArrow(run, rows.schema)


def _signatures(size: int, percent: int, table, frequent: int, pairs_to: int):
    """Rows (signature, d1, n) of each text's prefix; d1 is half of the set's digest.

    Shingles are ordered by their counter, rare ones first. Two sets that link share at least
    ``a = ceil(percent * n / 100)`` shingles of either, so the first shared one stands among the
    first ``n - a + 1``, the second among the first ``n - a + 2``. A rare shingle is indexed alone,
    a frequent one together with every later one of the prefix. Sets much larger than ``pairs_to``
    index frequent ones alone as well instead, as their pairs would be too many; around that size,
    where a smaller and a larger set can still link, both are indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = table.value
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                values, begin = shingle_sets(texts, size)
                sizes = np.diff(begin)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                digest = _digest(values, begin, _DIGESTS[0])
                count = counters[(values >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((values, count, owner))
                values, common = values[order], count[order] >= frequent
                at = np.arange(len(values)) - begin[owner]
                spare = sizes - (percent * sizes + 99) // 100  # n - a
                inside = at <= spare[owner]
                small, large = sizes * 100 <= pairs_to * 100 * 100 // percent, sizes * 100 >= pairs_to * percent
                alone = inside & (~common | large[owner] | (sizes[owner] < 2))
                signs, docs = [values[alone]], [owner[alone]]
                for d in np.unique(owner[inside & common & small[owner] & (sizes[owner] >= 2)]):
                    a, b = begin[d], begin[d] + min(sizes[d], spare[d] + 2)
                    tail = values[a:b][common[a:b]]
                    i, j = np.triu_indices(len(tail), 1)
                    signs.append(mix64(tail[i] * _ODD + tail[j]))
                    docs.append(np.full(len(i), d))
                signs, docs = np.concatenate(signs), np.concatenate(docs)
                yield pa.RecordBatch.from_arrays([pa.array(signs.view(np.int64)), pa.array(digest[docs]), pa.array(sizes[docs].astype(np.int32))], names=["signature", "d1", "n"])

    return run


def sketch(values: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of about ``len(values) / 2`` equal ranges."""
    bits = min(16, max(4, (len(values) // 2).bit_length()))
    return np.minimum(np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65_535).astype(np.uint16).tobytes()


def _at_most(x: np.ndarray, y: np.ndarray) -> int:
    """No more shared hashes than this: in each range at most the smaller count. The finer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    x = x.reshape(len(y), -1).sum(1, dtype=np.int64)
    return int(np.minimum(x, y).sum())


def _sets(size: int, marked: IdFilter, crowded: IdFilter):
    """Rows (doc_id, n, values, ranges) of the texts whose ids may be marked: the sketch of a text's shingle
    hashes and, if the id may be in a crowd, the sorted hashes themselves as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(batch.column(0).to_numpy())))
            for first, texts in slices(batch.column(1)):
                values, begin = shingle_sets(texts, size)
                each = [values[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                ids = batch.column(0).slice(first, len(texts))
                held = [x.tobytes() if c else None for x, c in zip(each, crowded(ids.to_numpy()).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begin)), pa.array(held, pa.binary()), pa.array([sketch(x) for x in each], pa.binary())], names=["doc_id", "n", "values", "ranges"])

    return run


def _links_in_blocks(percent: int):
    """Links (a, b) between the components of a block's sets: a forest, not all links.

    The rows of a block come together, sorted by block. A set is compared with those it is not yet
    joined to and whose size can match; all overlaps of one set are counted in one pass.
    """

    def find(root: np.ndarray, i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def solve(comps: np.ndarray, packed: list) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        n = np.array([len(s) for s in sets])
        begin = np.concatenate([[0], np.cumsum(n)])
        every, number = np.unique(np.concatenate(sets), return_inverse=True)
        flags, root, out = np.zeros(len(every), np.int64), np.arange(len(sets)), []
        known: dict[int, int] = {}
        for i, c in enumerate(comps.tolist()):  # what earlier rounds have joined
            root[i] = known.setdefault(c, i)
        for i in range(len(sets) - 1):
            rest = np.arange(i + 1, len(sets))
            mine = find(root, i)
            roots = np.array([find(root, j) for j in rest.tolist()])
            rest = rest[(roots != mine) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))]
            if not len(rest):
                continue
            own = number[begin[i] : begin[i + 1]]
            flags[own] = 1
            shared = np.array([flags[number[begin[j] : begin[j + 1]]].sum() for j in rest.tolist()]) if len(rest) < 8 else np.add.reduceat(flags[number], begin[:-1])[rest]
            flags[own] = 0
            for j in rest[100 * shared >= percent * (n[i] + n[rest] - shared)].tolist():
                a, b = find(root, i), find(root, j)
                if a != b:
                    root[b] = a
                    out.append((int(comps[i]), int(comps[j])))
        return out

    def links(held: list) -> pa.RecordBatch:
        found = solve(np.array([h[0] for h in held]), [h[1] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return _by_block(links)


def _by_block(solve):
    """Runs ``solve`` on the rows of each block of at least two; rows begin with the block's two columns and come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for key, part, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if (key, part) != block:
                    if len(held) > 1:
                        yield solve(held)
                    block, held = (key, part), []
                held.append(row)
        if len(held) > 1:
            yield solve(held)

    return run


def _with_partner(percent: int):
    """The ids of a block's sets whose sketches allow a link to a set of another component in the block."""

    def solve(held: list) -> pa.RecordBatch:
        comps = np.array([h[1] for h in held])
        sketches = [np.frombuffer(h[2], np.uint16) for h in held]
        n, width = np.array([x.sum(dtype=np.int64) for x in sketches]), np.array([len(x) for x in sketches])
        full = np.array([x.max() == 65_535 for x in sketches])
        tables = {w: np.stack([x for x in sketches if len(x) == w]).astype(np.int32) for w in set(width.tolist())}
        row = np.zeros(len(held), np.int64)
        for w in tables:
            row[width == w] = np.arange(len(tables[w]))
        marked = full.copy()
        if full.any():
            marked[:] = True  # a sketch at its limit bounds nothing
        for i in range(len(held) - 1):
            rest = np.arange(i + 1, len(held))
            fits = (comps[rest] != comps[i]) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
            rest = rest[fits & ~(marked[rest] & marked[i])]
            for w in set(width[rest].tolist()):
                here = rest[width[rest] == w]
                x, y = tables[width[i]][row[i]], tables[w][row[here]]
                x, y = (x.reshape(w, -1).sum(1), y) if len(x) >= w else (x, y.reshape(len(here), len(x), -1).sum(2))
                most = np.minimum(x, y).sum(1)
                near = here[100 * most >= percent * (n[i] + n[here] - most)]
                marked[near] = True
                marked[i] |= len(near) > 0
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h, m in zip(held, marked.tolist(), strict=True) if m], pa.int64())], names=["doc_id"])

    return _by_block(solve)


def _possible_pairs(percent: int):
    """Of rows (a, b, sketch of a, sketch of b) those whose sketches allow a link; the sketch's total is the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint16), np.frombuffer(y.as_buffer(), np.uint16)
                most = _at_most(x, y)
                keep.append(max(x.max(), y.max()) == 65_535 or 100 * most >= percent * (int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64)) - most))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _linked_pairs(percent: int):
    """Of rows (a, b, values of a, values of b) those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each block together."""
    return rows.repartition("signature", "part").sortWithinPartitions("signature", "part", "doc_id").select("signature", "part", *columns)


class _Labels:
    """The component of every set that shares a signature, refined as links are found."""

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        self.scratch, self.table = scratch, scratch.write("nodes", nodes.select("doc_id", F.col("doc_id").alias("comp")))

    def ends(self, edges: DataFrame) -> DataFrame:
        """Edges between sets as edges between the components that hold them."""
        of_a, of_b = (self.table.withColumnsRenamed({"doc_id": c, "comp": f"c{c}"}) for c in "ab")
        return edges.join(of_a, "a").join(of_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    def join(self, edges: DataFrame) -> None:
        """``edges`` are between components: an end that was joined before is found by its component only."""
        moved = contract(edges, self.scratch)
        if moved is not None:
            joined = self.table.join(moved, self.table["comp"] == moved["node"], "left")
            self.table = self.scratch.write("nodes", joined.select("doc_id", F.coalesce("label", "comp").alias("comp")))


def join_components(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", frequent: int | None = None, pairs_to: int = 160, block: int = 2_048, block_shingles: int = 500_000, crowd: int = 8, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of each row whose links form the components.

    A text's set is its distinct shingles of ``size`` words (ASCII lower case); two sets link when
    ``100 * shared >= percent * union``. ``component_id`` is the smallest id reachable. An empty set links
    with nothing: its component is its own id. A row with a null id has a null component and takes
    no part. Rows that repeat an id are one document: the components of their texts are one.

    1. One pass counts shingles in a table of fixed size and gives each text's set a digest of 128
       bits; equal sets are one class from here on, led by the smallest id.
    2. Sets index their prefixes (``_signatures``): rare shingles alone, frequent ones (whose
       counter is at least ``frequent``; by default 8 times the mean and 64) in pairs. Only the order of
       shingles and the choice of what is paired depend on the table; the result does not. Of signatures
       that the same sets hold, as those of a passage that they quote, one is kept.
    3. In each of ``rounds`` every set that shares a signature with more than ``crowd`` rows goes to one of
       those that still hold different components, the one that most sets hold, and is compared there
       in blocks of at most about ``block`` sets and ``block_shingles`` shingles, those first dropped whose
       sketches allow no link in their block. So a group of thousands of near copies is joined without listing its pairs.
    4. What still shares a signature, is not joined and has not met in a block is verified pair by pair,
       so no link is lost: first by sketches that bound what two sets can share, then by the sets.

    Signatures, sets and links are written to the shared folder and dropped when no longer read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngramjoin")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = scratch.write("profile", docs.mapInArrow(_profile(size), "doc_id long, n long, d1 long, d2 long, counts binary"))
    table = frequency_table(both.where("counts IS NOT NULL").select("counts"))
    profile = both.where("counts IS NULL").drop("counts")
    leaders = profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("leader"))
    leaders = scratch.write("leaders", leaders)
    repeated = profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y")).where("x <> y").select("doc_id")

    if frequent is None:
        frequent = max(64, int(8 * int(table.sum()) / COUNTERS))
    sent = spark.sparkContext.broadcast(table)  # 8 MB, whatever the corpus
    signs = scratch.write("signs", docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_signatures(size, percent, sent, frequent, pairs_to), "signature long, d1 long, n int"))
    # Signatures that different sets hold; of just two rows, only where their sizes can match.
    held = signs.groupBy("signature").agg(F.count("*").alias("m"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    held = held.where(f"low <> high AND (m > 2 OR 100 * least >= {percent} * most)")
    # Signatures of the same sets say the same: one is kept, here of those that two rows hold and below of all others.
    held = held.groupBy("m", "low", "high", "least", "most", F.when(F.col("m") > 2, F.col("signature")).alias("own")).agg(F.min("signature").alias("signature")).select("signature", "m")
    held = scratch.write("held", held)
    rows = scratch.write("rows", IdFilter(held.select("signature")).of(signs).join(held, "signature").distinct())
    holders = [F.bit_xor(F.xxhash64(F.lit(i), "d1", "n")).alias(f"x{i}") for i in range(2)]
    one = rows.groupBy("signature").agg(*holders).groupBy("x0", "x1").agg(F.min("signature").alias("signature")).select("signature")
    shared = rows.join(one, "signature").join(leaders.select("d1", F.col("leader").alias("doc_id"), F.col("n").alias("n_")), "d1").where("n = n_").select("signature", "doc_id", "n", "m")
    shared = scratch.write("shared", shared)
    scratch.release("signs", "held", "rows")
    nodes = scratch.write("marked", shared.groupBy("doc_id").agg(F.bool_or(F.col("m") > crowd).alias("crowded")))
    labels = _Labels(nodes, scratch)
    # Texts are not shuffled: the scan itself leaves out what shares no signature.
    sets_of = "doc_id long, n long, values binary, ranges binary"
    marked, crowd_ids = IdFilter(nodes.select("doc_id")), IdFilter(nodes.where("crowded").select("doc_id"))
    sets = docs.where("doc_id IS NOT NULL").mapInArrow(_sets(size, marked, crowd_ids), sets_of)
    sets = scratch.write("sets", sets)
    crowded_sets = sets.where("values IS NOT NULL")

    met: list[DataFrame] = []  # the block of each set in each round
    for round_ in range(rounds + 1):
        about = labels.table
        for i, earlier in enumerate(met):  # one row a set, joined before there is one for each signature
            about = about.join(earlier.select("doc_id", F.col("signature").alias(f"was{i}"), F.xxhash64("signature", "part").alias(f"met{i}")), "doc_id", "left")
        known = shared.join(about, "doc_id")
        mixed = known.groupBy("signature").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("signature")
        open_ = scratch.write("open", known.join(mixed, "signature"))
        if open_.isEmpty():
            break
        crowds = open_.where(F.col("m") > crowd)
        last = round_ == rounds or crowds.isEmpty()
        if not last:
            for i in range(len(met)):
                crowds = crowds.where(f"was{i} IS NULL OR was{i} <> signature")
            chosen = crowds.groupBy("doc_id").agg(F.max(F.struct("m", "signature")).alias("s"), F.first("comp").alias("comp"), F.first("n").alias("n")).select("doc_id", "comp", "n", "s.signature")
            parts = chosen.groupBy("signature").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).alias("parts"), F.count("*").alias("c")).where("c > 1").drop("c")
            placed = chosen.join(parts, "signature").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(round_)), F.col("parts")))
            placed = scratch.write("met", placed.select("signature", "part", "doc_id", "comp"))
            met.append(placed)
            near = _dealt(placed.join(crowded_sets, "doc_id"), "doc_id", "comp", "ranges").mapInArrow(_with_partner(percent), "doc_id long")
            near = scratch.write("near", near.distinct())
            # Only the sets that are compared are shuffled, not those of every crowd.
            kept = IdFilter(near).of(crowded_sets.select("doc_id", "values"))
            links = _dealt(placed.join(near, "doc_id").join(kept, "doc_id"), "comp", "values").mapInArrow(_links_in_blocks(percent), "a long, b long")
        else:
            # What a block has compared is done. A pair of a crowd comes up once, at the smallest of the
            # crowded signatures that both hold.
            crowded = F.col("m") > crowd
            held = open_.where(crowded).groupBy("doc_id").agg(F.array_sort(F.collect_set("signature")).alias("held"))
            rows = open_.join(held, "doc_id", "left").withColumn("held", F.when(crowded, F.col("held")))
            for i in range(len(met)):
                rows = rows.withColumn(f"met{i}", F.when(crowded, F.col(f"met{i}")))
            columns = ["doc_id", "comp", "n", "held", *[f"met{i}" for i in range(len(met))]]
            rows = rows.select("signature", *columns)
            main = open_.groupBy("signature", "comp").count().groupBy("signature").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
            minor = rows.join(main, "signature").where("comp <> main").select("signature", *[F.col(c).alias(f"x_{c}") for c in columns])
            once = "(held IS NULL OR signature = array_min(array_intersect(x_held, held)))"
            fresh = "".join(f" AND NOT coalesce(x_met{i} = met{i}, false)" for i in range(len(met)))
            fits = F.expr(f"x_comp <> comp AND 100 * least(x_n, n) >= {percent} * greatest(x_n, n){fresh} AND {once}")
            pairs = minor.join(rows, "signature").where(fits).select(F.least("x_doc_id", "doc_id").alias("a"), F.greatest("x_doc_id", "doc_id").alias("b"))
            pairs = scratch.write("pairs", pairs.distinct())
            ranges = IdFilter(pairs).of(sets.select("doc_id", "ranges"))
            near = pairs.join(ranges.select(F.col("doc_id").alias("b"), F.col("ranges").alias("rb")), "b").join(ranges.select(F.col("doc_id").alias("a"), F.col("ranges").alias("ra")), "a")
            pairs = scratch.write("pairs", near.select("a", "b", "ra", "rb").mapInArrow(_possible_pairs(percent), "a long, b long").distinct())
            # Few of the marked texts get here: their sets are made now rather than kept for all.
            ends = IdFilter(pairs)
            few = scratch.write("few", docs.where("doc_id IS NOT NULL").mapInArrow(_sets(size, ends, ends), sets_of).select("doc_id", "values"))
            right = pairs.join(few.select(F.col("doc_id").alias("b"), F.col("values").alias("vb")), "b")
            full = right.join(few.select(F.col("doc_id").alias("a"), F.col("values").alias("va")), "a").select("a", "b", "va", "vb")
            links = labels.ends(scratch.write("linked", full.mapInArrow(_linked_pairs(percent), "a long, b long")))
        labels.join(scratch.write("found", links))
        if last:
            break
    scratch.release("sets", "shared")

    of_class = leaders.join(labels.table.withColumnRenamed("doc_id", "leader"), "leader", "left").select("n", "d1", "d2", F.coalesce("comp", "leader").alias("comp"))
    same_id = profile.join(repeated, "doc_id").join(of_class, ["n", "d1", "d2"])
    moved = contract(same_id.join(same_id.groupBy("doc_id").agg(F.min("comp").alias("b")), "doc_id").select(F.col("comp").alias("a"), "b"), scratch)
    if moved is not None:
        of_class = of_class.join(moved, of_class["comp"] == moved["node"], "left").select("n", "d1", "d2", F.coalesce("label", "comp").alias("comp"))
    found = profile.join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns, reduced to the smallest id of each component; rows that repeat it count
    once, rows with a null id stay."""
    found = join_components(docs, size, percent)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    leaders = docs.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id"]).select(*docs.columns)
    return leaders.unionByName(docs.where("doc_id IS NULL"))
