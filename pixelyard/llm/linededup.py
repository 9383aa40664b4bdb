"""Line dedup: lines that many documents share are kept in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import BLANK, Scratch, ascii_lower, row_key, without


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _join_kept(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped positions (ascending), joined; linear in the number of lines."""
    last = F.size(dropped)

    def stretch(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
        end = F.when(i == last, F.size(lines)).otherwise(F.get(dropped, i))
        return F.slice(lines, begin + 1, end - begin)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), stretch)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` reduced, plus ``n_lines`` (before) and ``n_dropped``.

    Lines are exploded and hashed (128 bits). A key of at least ``min_chars`` code points that
    ``min_docs`` distinct ids hold loses its lines everywhere but in the largest id; the positions
    to drop come back to each document as one sorted array, and the rest is joined in order.

    Null or empty text: one empty line, and the text becomes ''. A row with a null id counts as no
    document and never keeps a repeated line. Rows that repeat an id are one document, each reduced
    alike. Columns named ``n_lines`` or ``n_dropped`` are replaced.

    Only hashes are shuffled for the counts (distinct ids are counted in two steps, so a line that
    a third of the corpus holds is pre-aggregated); the texts are shuffled once. The keys to drop are
    written to the shared folder when this is called.
    """
    docs = without(docs, "n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns(dict(zip(("__row1", "__row2"), row_key(F.col(id_col), F.col(text_col)), strict=True)))
    lines = keyed.select(F.col(id_col).alias("__id"), "__row1", "__row2", F.posexplode(F.split(text, "\n")).alias("__at", "__line"))
    key = line_key(F.col("__line"))
    lines = lines.where(F.length(key) >= min_chars).select("__id", "__row1", "__row2", "__at", F.xxhash64(key).alias("__key1"), F.xxhash64(key, F.lit(1)).alias("__key2"))

    shared = lines.groupBy("__key1", "__key2").agg(F.count_distinct("__id").alias("__docs"), F.max("__id").alias("__keeper"))
    # Written, so that the join below shuffles both sides itself and can split a hot key's lines.
    shared = Scratch(docs.sparkSession, "lines").write("shared", shared.where(F.col("__docs") >= min_docs).drop("__docs"))
    hits = lines.join(shared, ["__key1", "__key2"]).where(F.col("__id").isNull() | (F.col("__id") < F.col("__keeper")))
    # A set: identical rows have identical positions.
    dropped = hits.groupBy("__row1", "__row2").agg(F.sort_array(F.collect_set("__at")).alias("__dropped"))

    joined = keyed.join(dropped.hint("shuffle_hash"), ["__row1", "__row2"], "left")
    split = F.split(text, "\n")
    reduced = F.when(F.col("__dropped").isNull(), text).otherwise(_join_kept(split, F.col("__dropped")))
    out = [reduced.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*out, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"))


QUERY_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND k.doc_id < s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
