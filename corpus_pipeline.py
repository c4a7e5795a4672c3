"""A training corpus from documents: filtered, deduplicated, mixed and encoded, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, lines, mixing, simhash, toxicity
from arbora.llm.common import table, temporary


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with the columns of docs, in their order."""
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. It learns from the labels of these documents that aren't held out.

    Null and empty texts score 0 and stay; rows without a doc_id are scored like others and never learned from; repeated rows go or stay
    alike; a table that is empty, or without labels, stays as it is. All columns stay as they are, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _as(docs, toxicity.scored(docs, model).filter("predicted = 0"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in one only; n_chars follows the text where lines went.

    Null and empty texts, and rows without a doc_id, stay as they are; rows that share a doc_id count as one document; an empty table stays
    empty, and all columns stay, whatever their names.
    """
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return _as(docs, out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays.

    Texts without words are alike. Of a group without any doc_id one row stays, and one of rows that repeat doc_id and text. An empty table
    stays empty, and all columns stay, whatever their names.
    """
    return _as(docs, simhash.keep_similar(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, from no times to three.

    A null source is a source; rows without words are taken as often as is sure; equal rows equally often. An empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, their number and digest, and the digest of what they decode to, by doc_id (which may be null or repeat).

    A null text counts as empty; an empty table gives an empty one; further columns are not carried on.
    """
    return bpe.encode_documents(docs, *bpe.standard(), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Scores, fingerprints, chance and token ranks have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one but the last returns is written as Parquet in the shared folder, and read by the next."""
    docs, folder = table(spark, sf_dir, "documents"), temporary(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
