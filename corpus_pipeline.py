"""A corpus pipeline: toxicity, line dedup, near-dedup, source mixing, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all rows it gets and
returns a DataFrame; all but the last return the columns of documents.  ``run``
writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import common, line_dedup, minhash, mixing, packing, toxicity

#: A document with more boilerplate than this is taken for a copy and left whole to the next stage.
COPY_SHARE = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(common.id_bucket(F.col("doc_id"), 3) != 1))
    return toxicity.drop_toxic(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(spark, docs, most_share=COPY_SHARE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_boilerplate), ("near_dedup", without_copies), ("mixing", mixed), ("packing", packed)]

#: No SQL: toxicity, MinHash and packing are not SQL-expressible; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline", docs)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs, name)
    return docs
