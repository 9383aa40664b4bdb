"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the columns of documents; the
last one returns the pieces of the packed sequences. ``run`` writes each stage's result as Parquet to
the shared folder and rereads it as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.llm import linededup, mixing, ngramjoin, packing, toxicity
from pixelyard.llm.common import Scratch

#: No SQL: trained scores, token ids and best-fit packing. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is at least 0.7 go. The model learns from the labelled
    documents of the input; scores never read labels. Null and empty texts are scored like others, rows that repeat
    alike; without labels nothing is dropped. Extra columns pass through, whatever their names; no rows give none."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), most=20_000)
    return toxicity.without_toxic(docs, model, threshold=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest doc_id only; n_chars (a
    column of documents, which must be there) follows the text. A null text becomes ''; a row with a null id counts as no
    document; repeated rows are reduced alike. Extra columns pass through; no rows give none."""
    out = linededup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays. Null and
    empty texts link with nothing; rows with a null id stay; of rows that repeat an id one stays. Extra columns pass
    through; no rows give none."""
    return ngramjoin.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix in which a source of n documents weighs n ** 0.9; where a source
    has run out, the others go on in its further phases. A null source is a source of its own; null texts and repeated
    rows keep their places. Extra columns pass through; no rows give none."""
    mixed = mixing.mix(docs, exponent=0.9, block=8, until="all")
    # In as many ranges as the shuffle has partitions, each sorted: the files follow the schedule.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(ranges, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the mix in sequences of at most 2048. A null text counts as empty, which is one end token; repeated
    rows are packed each by itself; other columns are left out; no rows give none."""
    import public_tokenizers

    return packing.pack(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), width=2048), width=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        if before:
            scratch.release(before)
        before = name
    return docs
