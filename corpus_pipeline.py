"""The corpus pipeline: toxicity, exact dedup, near duplicates, source mixing, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of
documents; the last returns the packed pieces.

Cases: a document with a null or empty text is clean, and one of all such stays after the exact stage; it takes no part in the mix, which is of
words. A null identifier is larger than any other: a copy with an identifier is kept before one without. Rows that are equal in identifier and
text count as copies of each other, so one of them stays; rows that share an identifier but not the text are documents of their own. A source
of null is a source. Columns beyond those of the table documents go through all stages but the last. Without labels nothing is rejected, and
empty tables give an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from loomtext.llm.common import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain's last category rejects go; trained on the labelled ones among docs."""
    chain = toxicity.train(docs, toxicity.labelled(spark, sf_dir), toxicity.CATEGORIES)
    return toxicity.drop_toxic(docs, chain)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the one with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; n_chars follows a text that is taken in part."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of 2048 tokens. A document that comes twice is packed twice."""
    return packing.pack(packing.pieces(docs))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("ngram_join", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Trained models, the tokenizer and the packing plan have no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
