"""SQL names for the functions: native SQL functions where an expression exists, else UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from pixelyard import constants as K
from pixelyard.functions.containers import walk
from pixelyard.functions.jpeg import _headers
from pixelyard.functions.stats import ERFC_SEAM, ERFC_TERMS


def _bucket_case() -> str:
    arms = [f"WHEN bytes < {high} THEN '{name}'" for name, _, high in K.BUCKETS if high]
    return f"CASE WHEN bytes < 0 THEN NULL {' '.join(arms)} WHEN bytes IS NULL THEN NULL ELSE '{K.BUCKETS[-1][0]}' END"


NATIVE = {
    "size_bucket(bytes BIGINT) RETURNS STRING": _bucket_case(),
    "clamp_quality(q INT) RETURNS INT": "greatest(30, least(90, q + 10))",
    "extract_format(id STRING) RETURNS STRING": (
        "CASE WHEN contains(substring_index(id, '@', 1), '.') "
        "THEN lower(substring_index(substring_index(id, '@', 1), '.', -1)) ELSE 'unknown' END"
    ),
    "potential(reduction DOUBLE) RETURNS STRING": (
        "CASE WHEN reduction >= 30 THEN 'high' WHEN reduction >= 10 THEN 'medium' ELSE 'low' END"
    ),
    "be(content BINARY, at INT, n INT) RETURNS BIGINT": "cast(conv(hex(substring(content, at, n)), 16, 10) AS BIGINT)",
    "png_header(content BINARY) RETURNS STRUCT<width BIGINT, height BIGINT, bit_depth INT, color_type INT, has_alpha BOOLEAN, is_palette BOOLEAN>": (
        "CASE WHEN length(content) >= 33 AND substring(content, 1, 16) = X'89504E470D0A1A0A0000000D49484452' "
        "AND be(content, 17, 4) BETWEEN 1 AND 2147483647 AND be(content, 21, 4) BETWEEN 1 AND 2147483647 "
        "AND be(content, 26, 1) IN (0, 2, 3, 4, 6) AND be(content, 25, 1) IN (1, 2, 4, 8, 16) "
        "THEN named_struct('width', be(content, 17, 4), 'height', be(content, 21, 4), 'bit_depth', cast(be(content, 25, 1) AS INT), "
        "'color_type', cast(be(content, 26, 1) AS INT), 'has_alpha', be(content, 26, 1) IN (4, 6), 'is_palette', be(content, 26, 1) = 3) END"
    ),
    "normal_p(t DOUBLE) RETURNS DOUBLE": (
        f"aggregate(array(abs(t) / sqrt(2D)), CAST(NULL AS DOUBLE), (p, x) -> CASE WHEN x < {ERFC_SEAM} "
        f"THEN 1 - 2 * x * exp(-x * x) / sqrt(pi()) * aggregate(sequence({ERFC_TERMS}, 1, -1), 1D, (s, k) -> 1 + 2 * x * x / (2 * k + 1) * s) "
        f"ELSE exp(-x * x) / sqrt(pi()) / aggregate(sequence({ERFC_TERMS}, 1, -1), x, (f, k) -> x + k / 2 / f) END)"
    ),
}

#: Over the view ``{relation}`` of (grp, value). Percentiles of one group are one task's work here; for hot groups use
#: ``quantiles.median_abs_deviation``.
OVER_RELATION = {
    "mad() RETURNS TABLE(grp STRING, mad DOUBLE)": (
        "SELECT s.grp, percentile(abs(s.value - m.median), 0.5) AS mad FROM {relation} s "
        "JOIN (SELECT grp, percentile(value, 0.5) AS median FROM {relation} GROUP BY grp) m ON s.grp = m.grp GROUP BY s.grp"
    ),
    "welch(a STRING, b STRING) RETURNS TABLE(t DOUBLE, df DOUBLE, p DOUBLE)": (
        "SELECT t, df, normal_p(t) AS p FROM (SELECT if(ok, (ma - mb) / sqrt(ea + eb), 0D) AS t, "
        "if(ok, coalesce(try_divide((ea + eb) * (ea + eb), ea * ea / (na - 1) + eb * eb / (nb - 1)), cast(greatest(na + nb - 2, 1) AS DOUBLE)), 0D) AS df "
        "FROM (SELECT *, coalesce(na >= 2 AND nb >= 2 AND ea + eb > 0, false) AS ok FROM (SELECT *, try_divide(va, na) AS ea, try_divide(vb, nb) AS eb FROM {pair})))"
    ),
    "cohens_d(a STRING, b STRING) RETURNS TABLE(d DOUBLE)": (
        "SELECT if(coalesce(na >= 2 AND nb >= 2 AND pooled > 0, false), (ma - mb) / sqrt(pooled), 0D) AS d FROM "
        "(SELECT *, try_divide((na - 1) * va + (nb - 1) * vb, na + nb - 2) AS pooled FROM {pair})"
    ),
}
_GROUPS = "(SELECT grp, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM {relation} GROUP BY grp)"
#: Both groups' moments side by side; no row where one of them has no row.
_PAIR = f"(SELECT x.n AS na, y.n AS nb, x.m AS ma, y.m AS mb, x.v AS va, y.v AS vb FROM {_GROUPS} x, {_GROUPS} y WHERE x.grp = a AND y.grp = b)"


@arrow_udtf(returnType="key string, seq int, depth int, kind string, offset bigint, length bigint")
class ContainerSegments:
    """``container_segments(TABLE(SELECT key, content ...))``: one row per chunk, block or box. Each call
    gets a batch of rows and gives one table; the rows stay in their partition."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, found = rows.column(0).cast(pa.string()), [walk(c.as_py()) for c in rows.column(1)]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = [s for f in found for s in f]
        seq = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = {name: pa.array([s[i] for s in flat], kind) for i, (name, kind) in enumerate([("depth", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])}
        yield pa.table({"key": keys.take(pa.array(np.repeat(np.arange(len(found)), sizes))), "seq": pa.array(seq, pa.int32()), **columns})


def register_all(spark: SparkSession) -> None:
    for signature, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("jpeg_header", _headers)
    spark.udtf.register("container_segments", ContainerSegments)


def register_statistics(spark: SparkSession, relation: str = "samples") -> None:
    """``mad()``, ``welch(a, b)`` and ``cohens_d(a, b)`` as table functions over a view of (grp, value)."""
    register_all(spark)
    for signature, body in OVER_RELATION.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body.format(relation=relation, pair=_PAIR.format(relation=relation))}")
