"""Fitting, scoring, artifact and text-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelyard.functions import formats as FF
from pixelyard.operators import fitting as M
from pixelyard.operators.estimate import bits_per_pixel
from pixelyard.plans.scale import scratch_path
from pixelyard.sources import models as artifacts
from pixelyard.sources.tables import read_table
from pixelyard.workload import frames as W
from pixelyard.workload.registry import query

_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_KNOTS = {"knot_q25": ("l_quantity", 25.0)}


@query(
    "training_rows",
    """SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey, l_quantity, floor(l_extendedprice) * 8 / (o_custkey * 7 - 70) AS actual_bpp
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey * 7 - 70 > 0 AND l_linenumber <> 3""",
    rounded="actual_bpp",
)
def _(spark, folder):
    features = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("asset"), "o_custkey", (F.col("o_custkey") * 7 - 70).alias("pixels"))
    results = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("asset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), F.floor("l_extendedprice").alias("optimized_size"),
    )
    rows = M.training_rows(features, results, ["asset"], ["o_custkey", "l_quantity"])
    return rows.select("id", "o_custkey", "l_quantity", "actual_bpp")


@query(
    "fit_scaler",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 1e-9 THEN stddev_pop({c}) ELSE 1 END AS scale, min({c}) AS low, max({c}) AS high FROM src"
        for c in (*_FEATURES, "k")
    ).replace("FROM src", "FROM (SELECT *, 7.0 AS k FROM lineitem)"),
    rounded={"mean": 7, "scale": 7},
)
def _(spark, folder):
    return M.fit_scaler(read_table(spark, folder, "lineitem").withColumn("k", F.lit(7.0)), [*_FEATURES, "k"])


@query("training_envelope", " UNION ALL ".join(f"SELECT '{c}' AS feature, min({c}) AS low, max({c}) AS high FROM lineitem" for c in _FEATURES), rounded="low high")
def _(spark, folder):
    return M.training_envelope(read_table(spark, folder, "lineitem"), _FEATURES)


@query("outside_envelope", "SELECT l_linenumber, CAST(sum(CAST(NOT l_quantity BETWEEN 5 AND 40 AS INTEGER) + CAST(NOT l_tax BETWEEN 0.01 AND 0.05 AS INTEGER)) AS BIGINT) AS n_outside FROM lineitem GROUP BY 1")
def _(spark, folder):
    li = read_table(spark, folder, "lineitem")
    return li.groupBy("l_linenumber").agg(F.sum(M.outside_envelope({"l_quantity": [5, 40], "l_tax": [0.01, 0.05]})).alias("n_outside"))


@query("add_knots", "SELECT l_orderkey * 10 + l_linenumber AS id, greatest(l_quantity - 25, 0) AS knot_q25, greatest(l_discount - 0.05, 0) AS knot_d FROM lineitem", rounded="knot_d")
def _(spark, folder):
    li = read_table(spark, folder, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.add_knots(li, {**_KNOTS, "knot_d": ("l_discount", 0.05)}).select("id", "knot_q25", "knot_d")


def _raw(spark, model):
    """Slopes and intercept on the original scale, one row per term."""
    slopes = [b / s for b, s in zip(model.betas, model.scale)]
    intercept = model.intercept - sum(b * m for b, m in zip(slopes, model.mean))
    rows = [("intercept", float(intercept)), *zip(model.features, map(float, slopes)), *((k, float(b)) for k, b in model.knot_betas.items())]
    return spark.createDataFrame(rows, "term string, value double")


@query(
    "fit_ols_one_feature",
    "SELECT 'intercept' AS term, regr_intercept(l_extendedprice, l_quantity) AS value FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem",
    rounded="value", digits=4,
)
def _(spark, folder):
    return _raw(spark, M.fit_ols(read_table(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(
    "fit_ols_recovers_terms",
    """SELECT * FROM (VALUES ('intercept', 3.0), ('l_quantity', 2.0), ('l_discount', -50.0), ('l_tax', 10.0), ('knot_q25', 0.7)) t(term, value) WHERE (SELECT count(*) FROM lineitem) > 0""",
    rounded="value", digits=5,
)
def _(spark, folder):
    """A target that is linear in the features and a bend is recovered exactly."""
    target = 3.0 + 2.0 * F.col("l_quantity") - 50.0 * F.col("l_discount") + 10.0 * F.col("l_tax") + 0.7 * F.greatest(F.col("l_quantity") - 25, F.lit(0.0))
    li = read_table(spark, folder, "lineitem").withColumn("y", target)
    return _raw(spark, M.fit_ols(li, _FEATURES, "y", _KNOTS))


@query("fit_ols_price", rounded="value", digits=3)
def _(spark, folder):
    return _raw(spark, M.fit_ols(read_table(spark, folder, "lineitem"), _FEATURES, "l_extendedprice", _KNOTS))


_FIXED = M.LinearModel(["l_quantity"], [25.0], [14.0], 38000.0, [21000.0], {"knot": ("l_quantity", 40.0)}, {"knot": 5.0})


@query(
    "residuals",
    """SELECT quantile_cont(e, 0.5) AS median_rel_err, quantile_cont(e, 0.95) AS p95_rel_err, max(e) AS max_rel_err FROM (
 SELECT abs((38000 + 21000 * (l_quantity - 25) / 14 + 5 * greatest(l_quantity - 40, 0) - l_extendedprice) / greatest(l_extendedprice, 1e-9)) AS e FROM lineitem)""",
    rounded="median_rel_err p95_rel_err max_rel_err",
)
def _(spark, folder):
    return M.residuals(read_table(spark, folder, "lineitem"), _FIXED, "l_extendedprice", digits=None)


def _png_training(spark, folder):
    """Header features of the PNG heads; the target is linear in them, with the quality bends."""
    a = W.png_assets(spark, folder).withColumn("h", FF.png_header("content")).where(F.col("h").isNotNull())
    pixels = F.col("h.width") * F.col("h.height")
    rows = a.select(
        "p_partkey", F.col("h.has_alpha").cast("double").alias("has_alpha"), F.col("quality").cast("double").alias("quality"),
        F.log10(pixels.cast("double")).alias("log10_orig_pixels"), bits_per_pixel("length", pixels).alias("input_bpp"),
    )
    y = 0.5 + 0.2 * F.col("has_alpha") + 0.01 * F.col("quality") - 0.05 * F.col("log10_orig_pixels") + 0.001 * F.col("input_bpp") + 0.02 * F.greatest(F.col("quality") - 50, F.lit(0.0))
    return rows.withColumn("actual_bpp", y)


@query(
    "model_artifacts",
    f"""SELECT p_partkey, 0.5 + 0.2 * CAST(color_type IN (4, 6) AS DOUBLE) + 0.01 * quality - 0.05 * log10(width * height) + 0.001 * (length * 8.0 / (width * height))
 + 0.02 * greatest(quality - 50, 0) AS predicted_bpp, 'ok' AS load_status, 'missing' AS other_status FROM ({W.PNG}) WHERE valid""",
    rounded="predicted_bpp",
)
def _(spark, folder):
    """Fit, write the artifact, read the folder back, score with the loaded model."""
    rows = M.require_rows(_png_training(spark, folder))
    names = ["has_alpha", "quality", "log10_orig_pixels", "input_bpp"]
    fitted = M.fit_ols(rows, names, "actual_bpp", {"knot_q50_beta": ("quality", 50.0), "knot_q70_beta": ("quality", 70.0)})
    path = scratch_path(spark, "models")
    artifacts.write_models(artifacts.artifact_row(spark, "png_header", fitted, git_sha="0", created_at="2024-01-01T00:00:00Z"), path)
    found = artifacts.scan_models(spark, path)
    model = artifacts.load_model(found, "png_header")
    absent = artifacts.load_status(found, spark.createDataFrame([("absent.json",)], "name string")).select(F.col("load_status").alias("other_status"))
    status = found.select("load_status").join(F.broadcast(absent))  # one row each
    return rows.select("p_partkey", model.predict().alias("predicted_bpp")).join(F.broadcast(status))


_AROUND = "'(?s)(.{0,20}?(?:[/@]|http).{0,20})'"


@query(
    "pii_scan_documents",
    f"""SELECT doc_id, 'text' AS "column", len(regexp_extract_all(text, '[/@]|http')) AS n_matches, regexp_extract(text, '([/@]|http)', 1) AS matched,
 regexp_extract(text, {_AROUND}, 1) AS context FROM documents WHERE regexp_matches(text, '[/@]|http')""",
)
def _(spark, folder):
    return M.pii_scan(read_table(spark, folder, "documents"), ["text"], ["doc_id"])


@query(
    "pii_scan_conversations",
    f"""SELECT conv_id, turn, c AS "column", len(regexp_extract_all(t, '[/@]|http')) AS n_matches, regexp_extract(t, '([/@]|http)', 1) AS matched,
 regexp_extract(t, {_AROUND}, 1) AS context FROM (SELECT conv_id, turn, 'text' AS c, text AS t FROM conversations UNION ALL SELECT conv_id, turn, 'role', role FROM conversations)
 WHERE regexp_matches(t, '[/@]|http')""",
)
def _(spark, folder):
    return M.pii_scan(read_table(spark, folder, "conversations"), ["text", "role"], ["conv_id", "turn"])
