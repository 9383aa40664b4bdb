"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.llm import contamination, exactdedup, lexical, linededup, mixing, neighbours, ngramjoin, packing, periodic, quality, secrets, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least 20 characters in three documents or more stay in the largest doc_id only."""
    out = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = linededup.QUERY_SQL


@query
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's slot in the mix of sources weighted by the 0.9th power of their size."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(docs, exponent=0.9, block=8, until="all")


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = packing.tokenize(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), width=2048)
    return packing.pack(pieces, width=2048)


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), most=20_000)
    return toxicity.scored(docs, model, threshold=0.7)


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labelled ones that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"), most=20_000)
    return quality.scored(docs, model, threshold=0.5)


@query
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of at least 0.85."""
    return ngramjoin.join_components(table(spark, folder, "documents"), size=4, percent=85)


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group and the kept row of every document whose text is equal to others' but for white space."""
    return exactdedup.dedup(table(spark, folder, "documents"))


ORACLES["op6_exact_dedup"] = exactdedup.QUERY_SQL


@query
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest by inner product, found in the tree, of every twentieth vector."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives, repeated payloads as revisits, and read back from them."""
    return warc.round_trip(table(spark, folder, "pages"), min_bytes=0)


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate secret of every document, with the forest's score."""
    return secrets.scan_corpus(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


ORACLES["op11_lexical_search"] = lexical.QUERY_SQL


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items, and which items they are."""
    return contamination.digests(contamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10))


ORACLES["op13_decontamination"] = contamination.QUERY_SQL


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, of which every tenth is made periodic, and what is left without them."""
    found = periodic.collapse_runs(table(spark, folder, "documents"), least=24, order=periodic.planted)
    return periodic.digests(found)
