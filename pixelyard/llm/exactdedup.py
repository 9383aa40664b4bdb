"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import BLANK, Scratch, row_key

#: Two primes below 2**31 and a base for each: a fingerprint has 62 bits, and the length.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353 % 2_147_483_629)
_STEP = 1 << 14  # bytes whose weighted sum fits 64 bits
_BLANK = BLANK.encode()


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** (n - 1), ..., base, 1`` modulo ``prime``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[-n:]


class Fingerprint:
    """``h(ab) = h(a) * base ** len(b) + h(b)`` modulo each prime; parts are combined by their lengths."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES):
        self.primes, self.bases = primes, bases
        self.powers = [_powers(b, p, _STEP) for b, p in zip(bases, primes, strict=True)]

    def combine(self, first: tuple[int, ...], second: tuple[int, ...], length: int) -> tuple[int, ...]:
        """The fingerprint of two parts, the second of ``length`` bytes."""
        return tuple((a * pow(b, length, p) + c) % p for a, c, b, p in zip(first, second, self.bases, self.primes, strict=True))

    def __call__(self, data: bytes) -> tuple[int, ...]:
        out = (0,) * len(self.primes)
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        for at in range(0, len(values), _STEP):
            part = values[at : at + _STEP]
            here = tuple(int((part * w[-len(part) :]).sum() % np.uint64(p)) for w, p in zip(self.powers, self.primes, strict=True))
            out = self.combine(out, here, len(part))
        return out


def _chunk_hashes(fingerprint: Fingerprint):
    """(row, chunk number, chunk) to (row, chunk number, bytes left, two hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [x.as_buffer().to_pybytes().translate(None, _BLANK) for x in batch.column(3)]
            hashes = np.array([fingerprint(x) for x in plain], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(x) for x in plain], pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["row1", "row2", "chunk", "size", "h1", "h2"])

    return run


def _combined(fingerprint: Fingerprint):
    """Sorted chunk rows of each row to one fingerprint, by length-shifted sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, size, value, out = None, 0, (0, 0), []
        for batch in batches:
            for a, b, _, n, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != row:
                    if row:
                        out.append((*row, size, *value))
                    row, size, value = (a, b), 0, (0, 0)
                size, value = size + n, fingerprint.combine(value, (x, y), n)
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if row:
            out.append((*row, size, *value))
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row1", "row2", "size", "h1", "h2"])


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(x.as_buffer().to_pybytes().translate(None, _BLANK)).hexdigest() for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(digests, pa.string())], names=["row1", "row2", "id", "points", "sha"])


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (whose column ``bytes`` is cut) with one row per chunk of ``chunk`` bytes."""
    last = F.greatest(F.lit(0), F.floor((F.length("bytes") - 1) / chunk)).cast("int")
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return cut.withColumn("part", F.substring("bytes", F.col("chunk") * chunk + 1, F.lit(chunk))).drop("bytes")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 4 << 20, fingerprint: Fingerprint | None = None, compare_chunk: int = 1 << 16, spread: int = 500) -> DataFrame:
    """One row for each row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal
    ones the row with the most code points of original text stays, then the smallest id (a null id
    last). Rows that repeat an id and text are rows of their own in ``group_size`` and share ``kept``.

    1. Texts are cut into chunks of ``chunk`` bytes, so that a huge document is hashed by many tasks; the
       chunks' polynomial hashes combine to the hash of the whole by their lengths.
    2. Rows of equal fingerprint and length are compared with one of their number, by chunks of
       ``compare_chunk`` normalised bytes; the leader's chunks go once to every ``spread`` members, so a
       group of a third of all rows is compared by many tasks.
    3. Members that differ (a collision) are compared again among themselves, until none is left.
    """
    spark, fingerprint = docs.sparkSession, fingerprint or Fingerprint()
    scratch = Scratch(spark, "exactdedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(keys[0].alias("row1"), keys[1].alias("row2"), F.col(id_col).alias("id"), F.length(text).cast("long").alias("points"), text.cast("binary").alias("bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    digests = scratch.write("digests", rows.mapInArrow(_sha, f"row1 long, row2 long, id {kind}, points long, sha string"))

    hashed = _chunks(rows.select("row1", "row2", "bytes"), chunk).mapInArrow(_chunk_hashes(fingerprint), "row1 long, row2 long, chunk int, size long, h1 long, h2 long")
    hashed = hashed.dropDuplicates(["row1", "row2", "chunk"]).repartition("row1", "row2").sortWithinPartitions("row1", "row2", "chunk")
    prints = scratch.write("prints", hashed.mapInArrow(_combined(fingerprint), "row1 long, row2 long, size long, h1 long, h2 long"))

    # Equal rows (id and text) have one print; from here on a row key stands for all of them.
    found, open_ = [], prints
    while True:
        leaders = open_.groupBy("size", "h1", "h2").agg(F.min(F.struct("row1", "row2")).alias("lead"), F.count("*").alias("members"))
        leaders = scratch.write("leaders", leaders)
        placed = open_.join(leaders, ["size", "h1", "h2"]).select("row1", "row2", F.col("lead.row1").alias("lead1"), F.col("lead.row2").alias("lead2"), "members")
        placed = scratch.write("placed", placed)
        found.append(placed.where("members = 1 OR (row1 = lead1 AND row2 = lead2)").select("row1", "row2", "lead1", "lead2"))
        others = placed.where("members > 1 AND NOT (row1 = lead1 AND row2 = lead2)")
        if others.isEmpty():
            break
        plain = docs.select(keys[0].alias("row1"), keys[1].alias("row2"), F.translate(text, BLANK, "").cast("binary").alias("bytes"))
        slot = F.pmod(F.col("row1"), F.ceil(F.col("members") / spread)).alias("slot")
        members = plain.join(others.hint("shuffle_hash"), ["row1", "row2"]).dropDuplicates(["row1", "row2"])
        members = _chunks(members, compare_chunk).select("row1", "row2", "lead1", "lead2", "chunk", slot, F.col("part").alias("theirs"))
        leads = placed.where("members > 1 AND row1 = lead1 AND row2 = lead2").select("row1", "row2", "members")
        own = _chunks(plain.join(leads.hint("shuffle_hash"), ["row1", "row2"]).dropDuplicates(["row1", "row2"]), compare_chunk)
        own = own.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / spread) - 1)))
        own = own.select(F.col("row1").alias("lead1"), F.col("row2").alias("lead2"), "chunk", "slot", F.col("part").alias("own"))
        # Prints of one length: both sides have the same chunks.
        compared = members.join(own, ["lead1", "lead2", "chunk", "slot"], "left").groupBy("row1", "row2", "lead1", "lead2").agg(F.bool_and(F.coalesce(F.col("theirs") == F.col("own"), F.lit(False))).alias("same"))
        compared = scratch.write("compared", compared)
        found.append(compared.where("same").drop("same"))
        open_ = prints.join(compared.where("NOT same").select("row1", "row2"), ["row1", "row2"])
    groups = found[0]
    for part in found[1:]:
        groups = groups.unionByName(part)

    full = scratch.write("grouped", digests.join(groups, ["row1", "row2"]))
    best = full.groupBy("lead1", "lead2").agg(F.count("*").alias("group_size"), F.max_by("id", F.struct("points", F.struct(F.col("id").isNotNull(), -F.col("id")))).alias("keep_id"), F.max("points").alias("most"))
    best = scratch.write("best", best)
    out = full.join(best, ["lead1", "lead2"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


QUERY_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS original,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS normal
  FROM documents),
ranked AS (
  SELECT doc_id, normal,
         first_value(doc_id) OVER best AS keep_id,
         count(*) OVER (PARTITION BY normal) AS group_size
  FROM plain
  WINDOW best AS (PARTITION BY normal ORDER BY length(original) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256
FROM ranked
"""
