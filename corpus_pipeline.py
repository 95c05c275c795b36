"""The corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing and
encoding, each stage written and read back as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``docs``. A null or repeated doc_id, null or empty texts and empty tables pass
through every stage as its operator defines. Extra columns are carried along untouched.

Texts go to the Python workers in Arrow batches bounded by bytes instead of 10,000 rows; the
session keeps that setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope.llm import language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from pagoscope.llm.common import find_package, quoted, written

ORACLE_SQL = None  # learned models and sampled signatures have no SQL form

MIN_ODDS = 1.6  # a language stands out when its odds are so many times those of a blind guess
BATCH_BYTES = "4m"  # of an Arrow batch, which the executor and its Python worker both hold


def prepare(spark: SparkSession) -> None:
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no learned language stands out, go."""
    prepare(spark)
    net = language_id.fit(docs)
    found = language_id.identify(docs, net, keep=True)
    language, score = found.columns[-2:]
    least = MIN_ODDS / (MIN_ODDS + len(net.languages) - 1) if net else 0.0
    return found.where(
        (F.col(language) != language_id.UNDETERMINED) & (F.col(score) >= least)
    ).select(*(F.col(quoted(c)) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines go; a document left without any text goes with them."""
    prepare(spark)
    cleaned = line_dedup.dedup_lines(docs, keep=True, passages=True)
    emptied = (F.col(cleaned.columns[-1]) > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return cleaned.where(~emptied).select(*(F.col(quoted(c)) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as their rate says: often once, some twice or not at all."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(docs, labels)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces, with the scores of their best segmentations."""
    prepare(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
