"""Best-fit packing of tokenized documents into fixed-length sequences, by hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch
from pixelyard.llm.tokens import BatchEncoder, give_back, slices

PIECE = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"


def tokenize(docs: DataFrame, vocabulary: str, width: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. A document is its ids and then ``end_id``; one longer than ``width`` is cut
    into pieces of ``width``, of which the first may be shorter. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(vocabulary)
        for batch in batches:
            names = batch.column(0)
            for first, texts in slices(batch.column(1), 4 << 20):
                ids, bounds = encoder.encode(texts)
                sizes = np.diff(bounds) + 1
                whole = np.insert(ids, bounds[1:], end_id).astype("<u4")
                begin = np.concatenate([[0], np.cumsum(sizes)])
                count = -(-sizes // width)
                owner = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                short = sizes - (count - 1) * width  # of the first piece
                start = np.where(piece == 0, 0, short[owner] + (piece - 1) * width)
                length = np.where(piece == 0, short[owner], width)
                data, at = memoryview(whole).cast("B"), begin[owner] + start
                sums = np.fromiter((zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner + first)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del encoder
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin number and offset of each item.

    Bins are kept by free space; one bit per free space that occurs finds the tightest fit.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(width + 1)]
    present, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                present ^= 1 << room
        else:
            room, chosen, opened = width, opened, opened + 1
        bins[i], offsets[i] = chosen, width - room
        left = room - n
        if left:
            free[left].append(chosen)
            present |= 1 << left
    return bins, offsets


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BIN = "fill: bigint, members: array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"


def _bins(fill: np.ndarray, counts: np.ndarray, members: pa.StructArray) -> Iterator[pa.RecordBatch]:
    """Record batches of bins; ``members`` are in the order of their bins."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(fill), 2000):
        b = min(a + 2000, len(fill))
        part = members.slice(int(edges[a]), int(edges[b] - edges[a]))
        nested = pa.ListArray.from_arrays(pa.array(edges[a : b + 1] - edges[a], pa.int32()), part)
        yield pa.RecordBatch.from_arrays([pa.array(fill[a:b], pa.int64()), nested], names=["fill", "members"])


def _pack_pieces(width: int, block: int):
    """Packs the pieces of a partition, at most ``block`` at a time."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths, width)
        order = np.lexsort((offsets, bins))
        sorted_bins = bins[order]
        counts = np.bincount(sorted_bins)
        fill = np.bincount(sorted_bins, lengths[order], len(counts)).astype(np.int64)
        rows = table.take(pa.array(order))
        columns = [rows[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield from _bins(fill, counts, pa.StructArray.from_arrays([*columns, pa.array(offsets[order])], fields=list(_MEMBER)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if rows and rows + part.num_rows > block:
                    yield from flush(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from flush(held)

    return run


def _merge_bins(width: int, block: int):
    """Packs bins as items, at most ``block`` members at a time; their members' offsets move along."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table["fill"].to_numpy()
        bins, offsets = best_fit(lengths, width)
        order = np.lexsort((offsets, bins))
        nested = table["members"].combine_chunks()
        nested = (nested.chunk(0) if isinstance(nested, pa.ChunkedArray) else nested).take(pa.array(order))
        sizes = np.diff(nested.offsets.to_numpy())
        members = nested.flatten()
        moved = members.field("offset").to_numpy() + np.repeat(offsets[order], sizes)
        members = pa.StructArray.from_arrays([*(members.field(c.name) for c in list(_MEMBER)[:-1]), pa.array(moved)], fields=list(_MEMBER))
        counts = np.bincount(bins[order], sizes).astype(np.int64)
        fill = np.bincount(bins[order], lengths[order]).astype(np.int64)
        yield from _bins(fill, counts, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch.column(1).flatten())
            if rows >= block:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


def pack(pieces: DataFrame, width: int = 2048, slack: int = 16, fan_in: int = 8, block: int = 200_000) -> DataFrame:
    """``pieces`` (the columns of ``tokenize``, length 1 to ``width``) plus ``sequence_id`` and ``offset``.

    Every partition is packed best-fit by itself. Bins with at most ``slack`` free tokens are final;
    the others become items of the next round, which meets the bins of ``fan_in`` tasks of the round
    before in one task, and so on. No task holds more than about ``block`` pieces, so where fewer
    tasks would have to hold more, rounds end once one has removed less than one bin in a hundred.

    Bins are written after each round; a lost executor repeats one round's tasks at most. Ids of
    sequences have gaps. Rows that repeat are packed each by itself; an empty input gives no rows.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    bins = pieces.mapInArrow(_pack_pieces(width, block), _BIN)
    bins = scratch.write("bins", bins.withColumn("final", F.col("fill") >= width - slack))
    done, open_bins = [bins.where("final")], bins.where(~F.col("final"))
    before, held = open_bins.agg(F.count("*"), F.sum(F.size("members"))).first()
    tasks = bins.rdd.getNumPartitions() if before else 0
    while before:
        tasks = max(-(-tasks // fan_in), -(-(held or 0) // block))
        bins = open_bins.select("fill", "members").repartition(tasks).mapInArrow(_merge_bins(width, block), _BIN)
        bins = scratch.write("bins", bins.withColumn("final", F.col("fill") >= width - slack))
        made, after, held = bins.agg(F.count("*"), F.count_if(~F.col("final")), F.sum(F.when(~F.col("final"), F.size("members")))).first()
        open_bins = bins.where(~F.col("final"))
        if tasks == 1 or after == 0 or (before - made < before / 100 and tasks <= -(-(held or 0) // block)):
            done.append(bins)
            break
        done.append(bins.where("final"))
        before = after
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    # In two steps: beside a generator the ids would be given to its rows.
    numbered = whole.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = numbered.select("sequence_id", F.explode("members").alias("m"))
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
