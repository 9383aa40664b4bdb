"""Model artifacts: a folder of versioned JSON files as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.operators.fitting import LinearModel

ARTIFACT = """model_version INT, format STRING, features ARRAY<STRING>,
 scaler STRUCT<mean: ARRAY<DOUBLE>, scale: ARRAY<DOUBLE>>,
 coefficients STRUCT<intercept: DOUBLE, betas: ARRAY<DOUBLE>, knot_beta: DOUBLE, knot_q50_beta: DOUBLE, knot_q70_beta: DOUBLE>,
 knot_log10_unique_colors DOUBLE, knot_q50 DOUBLE, knot_q70 DOUBLE, training_envelope MAP<STRING,ARRAY<DOUBLE>>,
 training_corpus_sha256 STRING, git_sha STRING, fit_environment MAP<STRING,STRING>, created_at STRING"""
#: knot coefficient -> (artifact field with its position, feature it bends)
_KNOTS = {
    "knot_beta": ("knot_log10_unique_colors", "log10_unique_colors"),
    "knot_q50_beta": ("knot_q50", "quality"),
    "knot_q70_beta": ("knot_q70", "quality"),
}
_EXPECTED = {m["format"]: m for m in (K.PNG_HEADER_MODEL, K.PNG_THUMBNAIL_MODEL, K.JPEG_HEADER_MODEL)}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _valid(m: Column) -> Column:
    """Exact features, equal lengths, finite numbers, bounded coefficients, the needed knots."""
    c, s = m["coefficients"], m["scaler"]
    n = F.size(m["features"])
    bounded = lambda b: _finite(b) & (F.abs(b) <= K.MODEL_MAX_BETA)
    ok = F.lit(False)
    for fmt, expected in _EXPECTED.items():
        this = (m["format"] == fmt) & (m["features"] == F.array(*[F.lit(f) for f in expected["features"]]))
        for knot in expected["knots"]:
            this = this & bounded(c[knot]) & m[_KNOTS[knot][0]].isNotNull()
        ok = ok | this
    shapes = (F.size(s["mean"]) == n) & (F.size(s["scale"]) == n) & (F.size(c["betas"]) == n)
    numbers = F.forall(s["mean"], _finite) & F.forall(s["scale"], _finite) & F.forall(c["betas"], bounded)
    intercept = _finite(c["intercept"]) & (F.abs(c["intercept"]) <= K.MODEL_MAX_INTERCEPT)
    return F.coalesce(ok & shapes & numbers & intercept, F.lit(False))


def scan_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, load_status, model): ok, version_mismatch or parse_error."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"),
        F.from_json("value", ARTIFACT, {"mode": "PERMISSIVE"}).alias("model"),
    )
    version = F.col("model.model_version")
    supported = F.lit(False)
    for fmt, want in K.MODEL_VERSIONS.items():
        supported = supported | ((F.col("model.format") == fmt) & (version == want))
    status = (
        F.when(version.isNull() | F.col("model.format").isNull(), "parse_error")
        .when(~supported & F.col("model.format").isin(*K.MODEL_VERSIONS), "version_mismatch")
        .when(_valid(F.col("model")), "ok")
        .otherwise("parse_error")
    )
    return files.select("name", status.alias("load_status"), "model")


def load_status(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of every wanted artifact ``name``; one that does not exist is ``missing``."""
    joined = wanted.join(models.select("name", "load_status"), "name", "left")
    return joined.withColumn("load_status", F.coalesce("load_status", F.lit("missing")))


def load_model(models: DataFrame, fmt: str) -> LinearModel | None:
    """The newest usable model of one format, or None. One artifact row reaches the driver."""
    usable = models.where((F.col("load_status") == "ok") & (F.col("model.format") == fmt))
    row = usable.orderBy(F.col("model.created_at").desc(), "name").select("model.*").first()
    if row is None:
        return None
    expected = _EXPECTED[fmt]["knots"]
    coefficients = row["coefficients"]
    knots = {k: (_KNOTS[k][1], row[_KNOTS[k][0]]) for k in expected}
    return LinearModel(
        list(row["features"]), list(row["scaler"]["mean"]), list(row["scaler"]["scale"]), coefficients["intercept"],
        list(coefficients["betas"]), knots, {k: coefficients[k] for k in knots}, dict(row["training_envelope"] or {}),
    )


def artifact_row(spark: SparkSession, fmt: str, model: LinearModel, **info) -> DataFrame:
    """A fitted model as a one-row artifact frame for ``write_models``."""
    knots = {_KNOTS[k][0]: float(at) for k, (_, at) in model.knots.items()}
    value = {
        "model_version": K.MODEL_VERSIONS[fmt], "format": fmt, "features": model.features,
        "scaler": {"mean": model.mean, "scale": model.scale},
        "coefficients": {"intercept": model.intercept, "betas": model.betas, **model.knot_betas},
        **knots,
        "training_envelope": model.envelope,
        **info,
    }
    return spark.createDataFrame([value], ARTIFACT)


def write_models(df: DataFrame, path: str) -> None:
    """One JSON file per artifact row."""
    df.write.mode("append").option("maxRecordsPerFile", 1).json(path)
