"""Small tables of items (benchmark texts, queries) in blocks whose size is checked before they are broadcast."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_rows: int, most_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct (id, text) rows, in one block if they keep to both limits, else dealt by hash over
    so many blocks that each is expected to reach half of them. The driver holds one block at a time."""
    kept = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = 1 if rows <= most_rows and size <= most_bytes else max(-(-2 * rows // most_rows), -(-2 * size // most_bytes))
    for block in range(blocks):
        part = kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
