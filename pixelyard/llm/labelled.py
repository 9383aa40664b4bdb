"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3 (a null id is never held out)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text``, ``label`` (0/1) and ``fold`` (0/1) of at most ``most`` labelled ids that aren't held out.

    The ids with the smallest hashes are taken, so the sample does not depend on the layout. An id
    labelled twice counts as 1 if any label says so; null ids or labels take no part.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    fold = F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    # At most `most` rows of an id and a label.
    known = F.broadcast(known.select(F.col(id_col).alias("__id"), "label", fold))
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(known, F.col("__doc") == F.col("__id")).select("text", "label", "fold")
