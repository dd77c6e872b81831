"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again for the next.

Each stage takes (spark, docs, folder of tables). All but the last return the columns of documents; the last
one returns the packed pieces of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import neardup, packing, pii, quality, toxicity
from quillon.llm.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the learned scores and the sketches; tests compare the stages with brute force instead.
ORACLE_SQL = None


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. A null doc_id cannot be judged apart and is judged by its text too."""
    model = toxicity.learn(toxicity.training_rows(docs, _labels(spark, folder)))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule and every certified cutoff keep."""
    featured = materialise(quality.features(docs.select(*COLUMNS)), "quality")
    return quality.judge(featured, _labels(spark, folder)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the least doc_id of each class.

    Rows that share a doc_id are one document, of which the row that sorts first by its values stays, nulls first; rows
    without a doc_id all stay. No documents give none.
    """
    keep = neardup.classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    rest = F.struct(F.xxhash64("text").alias("h"), *COLUMNS[1:])
    known = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("r")).select("doc_id", "r.*")
    return known.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    found = pii.replaced(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
