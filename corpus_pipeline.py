"""A corpus pipeline of five stages over ``documents``; part of the training-data subpackage.

Each stage takes all that its predecessor kept.  The stages before the last return the columns of
``documents``; the last returns packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing, pii, quality, simhash, toxicity
from lectern.llm.common import crc32_id, read, staged, unstage, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), where=crc32_id(F.col("doc_id")) % 5 != 0)
    out = unused(docs, "__toxicity")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < 0.5).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely poor than good go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), where=crc32_id(F.col("doc_id")) % 4 != 2)
    out = unused(docs, "__quality")
    return quality.score(docs, model, out=out).filter(F.col(out) >= 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class linked by a Jaccard similarity of 0.8 in five-word shingles the document with the smallest
    id stays.  Rows of one id with different texts are different documents; rows without an id all stay."""
    own = unused(docs, "__id")  # keeps the order of doc_id and tells texts apart
    order = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn(own, F.concat_ws(":", order, F.sha2(F.coalesce("text", F.lit("\1")).cast("binary"), 256)))
    classes = simhash.near_duplicates(known, id_col=own, width=5, similarity=0.8).groupBy(F.col("doc_id").alias(own), "component_id").agg(F.count("*").alias("n"))
    heads = staged(classes.filter(F.col(own) == F.col("component_id")).select(own, "n"), "heads")
    once = known.join(heads.filter("n = 1"), own, "left_semi").select(docs.columns)
    # rows that repeat id and text are one document: the least of them stays
    least = known.join(heads.filter("n > 1"), own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(least).unionByName(docs.filter(F.col("doc_id").isNull()))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers become their kind in brackets; ``n_chars`` follows the text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifiers and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        unstage(before)  # only the last stage's input is still read
    return STAGES[-1][1](spark, docs, sf_dir)
